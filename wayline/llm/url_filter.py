"""Verdicts on URLs by a cascade of Bloom filters.

A listing (keys of host and path) is encoded once, over the complete universe of
keys that the corpus can ask for. The first filter holds the listed keys; the
second one holds the unlisted keys of the universe that pass the first by
mistake; the third one the listed keys that pass the second, and so on until a
level lets nothing through by mistake. A key is walked down the levels to the
first filter that does not hold it: exact for every key of the universe, without
joining the rows to the listing. Native column code only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wayline.workspace import written

C = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: most bits of one filter (16 MB); a larger listing is cut into parts that are walked one after another
MAX_BITS = 1 << 27


@dataclass
class Level:
    """One filter: its 64-bit words are the single row of a written table."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> Column:
        """The bits that a key sets (double hashing)."""
        one, two = (F.pmod(F.xxhash64(key, F.lit(2 * self.seed + i)), F.lit(self.bits)) for i in (0, 1))
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda j: (one + j * two) % F.lit(self.bits))

    def holds(self, key: Column, words: Column) -> Column:
        return F.forall(self.positions(key), lambda b: F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1)


def _level(members: DataFrame, bits: int, hashes: int, seed: int) -> Level:
    """Set the bits of all members, as a table of words first, then as one row of bounded size."""
    spark = members.sparkSession
    level = Level(members, bits, hashes, seed)
    at = members.select(F.explode(level.positions(C("key"))).alias("b"))
    ones = at.select(F.shiftright("b", 6).alias("at"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit"))
    blank = spark.range((bits + 63) // 64).select(C("id").alias("at"), F.lit(0).cast("long").alias("bit"))
    words = ones.unionByName(blank).groupBy("at").agg(F.bit_or("bit").alias("bit"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda w: w["bit"]).alias("words"))
    level.words = written(row, "filter")
    return level


def _with_words(df: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """The filters as scalar subqueries, each read once; the optimizer moves them to their single use."""
    return df.select("*", *[v.words.scalar().alias(f"_words{i}") for i, v in enumerate(levels)])


def _member(key: Column, levels: Sequence[Level]) -> Column:
    """Whether a key of the universe is listed."""
    found = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        found = F.when(~levels[i].holds(key, C(f"_words{i}")), F.lit(i % 2 == 1)).otherwise(found)
    return found


def cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level]:
    """Filters that tell the keys marked `listed` from all other keys of a stored universe (key, listed; distinct keys).

    Sizes follow the classical rule: the first level errs with n / (sqrt(2) m)
    for n listed and m other keys, each further one with a half. A filter needs
    more than max_bits only for more than some 3 million listed keys; then
    ValueError (see `parts_for`).
    """
    members, others = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
    n, m = universe.agg(F.count_if("listed"), F.count_if(~C("listed"))).first()
    levels: list[Level] = []
    while n:
        rate = 0.5 if levels else min(0.5, max(n * math.sqrt(0.5) / m, 1e-9) if m else 0.5)
        bits = max(512, math.ceil(n * math.log2(1 / rate) / math.log(2)))
        if bits > max_bits:
            raise ValueError(f"a filter of {bits} bits is over the bound of {max_bits}")
        level = _level(members, bits, max(1, round(math.log2(1 / rate))), len(levels))
        passed = written(_with_words(others, [level]).where(level.holds(C("key"), C("_words0"))).select("key"), "passed")
        levels.append(level)
        members, others, n = passed, members, passed.count()
    return levels


def parts_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Parts of a listing of n keys, so that each part's first filter stays within the bound (at most 44 bits a key)."""
    return max(1, math.ceil(44 * n / max_bits))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://' or for null."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def lookups(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Structs (size, host_size, key) of every key that could cover the URL: each suffix of up to `labels` labels with each path prefix of a listed length."""
    def of(n: int, size: int) -> Column:
        suffix = F.substring_index(host, ".", -n)
        key = F.concat(suffix, F.substring(path, 1, size))
        return F.when((F.length(path) >= size) & ((F.lit(n) == 1) | (suffix != F.substring_index(host, ".", 1 - n))), F.struct(
            F.length(key).alias("size"), F.length(suffix).alias("host_size"), key.alias("key")))

    return F.filter(F.array(*[of(n, size) for n in range(1, labels + 1) for size in lengths]), lambda x: x.isNotNull())


def judge_urls(pages: DataFrame, rules: DataFrame, blocked: DataFrame, keep: Sequence[str] = (), url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per page: the `keep` columns, host, path, rule, listed_key, verdict.

    rules: host, path, verdict ('allow' or 'block'); blocked: host, path. A key
    fits its host and all subdomains, if the URL's path starts with its path. Of
    the fitting rules the longest counts (host and path together; then the longer
    host; a key that is given with both verdicts blocks). Without a rule the URL
    is blocked if a key of `blocked` fits (listed_key: the longest), else allowed.
    Hosts are compared in lower case. Rows with a null URL, or one without '://',
    have an empty host and path. Rules with a null host, path or verdict count
    for nothing; repeated rows, also of pages, stay as they are. Columns other
    than these are ignored, so their names cannot clash; keep must not name
    host, path, rule, listed_key or verdict.
    """
    key = lambda df, *more: df.where("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", *more)
    rules, blocked = key(rules, "verdict").where("verdict IS NOT NULL"), key(blocked)
    spans = rules.select("host", "path").unionByName(blocked).agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    as_key = F.concat("host", "path").alias("key")
    # a key that both blocks and allows blocks
    marks = {"allowed": rules.where("verdict = 'allow'"), "denied": rules.where("verdict <> 'allow'"), "listed": blocked}
    host, path = split_url(C(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    keys = lookups(C("host"), C("path"), spans.labels, spans.lengths) if spans.labels else F.array().cast("array<struct<size:int,host_size:int,key:string>>")
    asked = written(rows.select("*", keys.alias("_keys")), "asked")
    none = {name: F.lit(False).alias(name) for name in marks}
    tagged = asked.select(F.explode("_keys.key").alias("key")).select("key", *none.values())
    for name, table in marks.items():
        tagged = tagged.unionByName(table.select(F.concat("host", "path").alias("key"), *[F.lit(True).alias(x) if x == name else none[x] for x in marks]))
    universe = written(tagged.groupBy("key").agg(*[F.bool_or(name).alias(name) for name in marks]).withColumn("allowed", C("allowed") & ~C("denied")), "universe")
    sizes = universe.agg(*[F.count_if(name).alias(name) for name in marks]).first()
    for name in marks:
        parts = parts_for(sizes[name], max_bits)
        part = lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(parts))
        asked = asked.select("*", F.slice("_keys", 1, 0).alias(f"_{name}"))
        for p in range(parts):
            mine = universe.select("key", C(name).alias("listed"))
            levels = cascade(mine if parts == 1 else mine.where(part(C("key")) == p), max_bits) if sizes[name] else []
            if not levels:
                continue
            test = lambda k: _member(k["key"], levels) if parts == 1 else (part(k["key"]) == p) & _member(k["key"], levels)
            found = F.filter("_keys", test) if parts == 1 else F.concat(f"_{name}", F.filter("_keys", test))
            asked = _with_words(asked, levels).select(*[c for c in asked.columns if c != f"_{name}"], found.alias(f"_{name}"))
            if parts > 1:
                asked = written(asked, "judged")
    best = lambda name: F.array_max(f"_{name}")
    rank = lambda c: F.struct(c["size"], c["host_size"])
    allowed, denied = best("allowed"), best("denied")
    wins = denied.isNotNull() & (allowed.isNull() | (rank(denied) >= rank(allowed)))
    rule = F.when(wins, denied["key"]).otherwise(allowed["key"])
    blocks = wins | (allowed.isNull() & best("listed").isNotNull())
    return asked.select(*keep, "host", "path", rule.alias("rule"), best("listed")["key"].alias("listed_key"), F.when(blocks, "block").otherwise("allow").alias("verdict"))
