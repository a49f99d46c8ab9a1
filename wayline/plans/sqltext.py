"""Fragments of comparison SQL."""

from wayline.functions.core import WHITE


def quote(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def case_of(key: str, table: dict, other: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {other} END"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def space_tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WHITE}+'), lambda t: t <> '')"


def word_tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9_]+'), lambda t: t <> '')"
