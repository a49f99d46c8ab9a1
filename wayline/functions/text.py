"""Overlap measures between two texts, computed inside the row.

Everything except the longest common subsequence stays in the JVM and needs no
shuffle: a bag is sorted, equal neighbours are numbered, and the numbered items
of both sides are intersected as sets.  The work is linear in the text apart
from the sort, so whole documents are fine.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from wayline import fixed
from wayline.functions.core import WHITE, first_present, indices, let, strip


def word_tokens(text: Column) -> Column:
    """Tokenizer T1: lower case, a-z 0-9 _ runs."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+")
    return F.filter(parts, lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Tokenizer T2: lower case, split on white space."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"{WHITE}+")
    return F.filter(parts, lambda t: t != "")


def longer_grams(shorter: str, tokens: str, n: int) -> Column:
    """n-grams from the (n-1)-grams and the tokens of the same text, by column name."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(shorter, F.lit(1), count), F.slice(tokens, F.lit(n), count),
        lambda head, last: F.concat(head, F.lit(" "), last),
    )


def _repeats(items: Column) -> Column:
    """Sorted items without one copy of each."""
    return let(F.sort_array(items), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1)))


def _numbered(items: Column) -> Column:
    """Each item of a sorted list with its occurrence number: a bag as a set."""

    def number(s: Column) -> Column:
        starts = F.filter(
            indices(F.size(s)), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1))
        )
        return let(
            F.concat(starts, F.array(F.size(s))),
            lambda b: F.flatten(
                F.transform(
                    indices(F.size(b) - 1),
                    lambda k: F.transform(
                        F.sequence(F.lit(1), F.get(b, k + 1) - F.get(b, k)),
                        lambda j: F.concat_ws("\u0001", F.get(s, F.get(b, k)), j.cast("string")),
                    ),
                )
            ),
        )

    return let(items, number)


def bag_overlap(a: Column, b: Column) -> Column:
    """Sum over items of the smaller of both counts.

    Once for every item both have, plus the same sum over the further copies;
    only those few are numbered.
    """
    more = F.array_intersect(_numbered(_repeats(a)), _numbered(_repeats(b)))
    return F.size(F.array_intersect(a, b)) + F.size(more)


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token lists.

    Bit-parallel row update (Hyyro 2004): one big-integer step per token of the
    second list, so long texts stay affordable.  A nested ``aggregate`` would
    evaluate one interpreted expression per cell of the table.
    """

    def one(x, y) -> int:
        if x is None or y is None or len(x) == 0 or len(y) == 0:
            return 0
        where: dict = {}
        for i, token in enumerate(x):
            where[token] = where.get(token, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            hit = row & where.get(token, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def f1(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """Harmonic mean of hits/n_pred and hits/n_ref; 0 where undefined."""
    p, r = hits / F.nullif(n_pred, F.lit(0)), hits / F.nullif(n_ref, F.lit(0))
    return F.when(hits > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def with_overlap(
    df: DataFrame, pred: Column, ref: Column, tokens, prefix: str, orders=(1, 2, 3, 4),
    lcs: bool = True,
) -> DataFrame:
    """Add token counts, n-gram overlaps and the LCS length of a text pair.

    Columns: {prefix}np, {prefix}nr, {prefix}m1..m4 and {prefix}lcs.  All
    measures below are arithmetic over these.
    """
    name = lambda side, n: f"{prefix}{side}{n}"
    out = df.withColumns({name("p", 1): tokens(pred), name("r", 1): tokens(ref)})
    out = out.withColumns({f"{prefix}np": F.size(name("p", 1)), f"{prefix}nr": F.size(name("r", 1))})
    for n in range(2, max(orders, default=1) + 1):
        out = out.withColumns(
            {name(s, n): longer_grams(name(s, n - 1), name(s, 1), n) for s in ("p", "r")}
        )
    out = out.withColumns(
        {f"{prefix}m{n}": bag_overlap(F.col(name("p", n)), F.col(name("r", n))) for n in orders}
    )
    if lcs:
        out = out.withColumn(f"{prefix}lcs", lcs_length(name("p", 1), name("r", 1)))
    top = max(orders, default=1)
    return out.drop(*[name(s, n) for s in ("p", "r") for n in range(1, top + 1)])


def rouge_l(prefix: str) -> Column:
    return f1(F.col(f"{prefix}lcs"), F.col(f"{prefix}np"), F.col(f"{prefix}nr"))


def _grams(count: Column, n: int) -> Column:
    return F.greatest(count - (n - 1), F.lit(0))


def rouge_n(prefix: str, n: int) -> Column:
    np_, nr = F.col(f"{prefix}np"), F.col(f"{prefix}nr")
    return F.bround(f1(F.col(f"{prefix}m{n}"), _grams(np_, n), _grams(nr, n)), 4)


def token_f1_rounded(prefix: str) -> Column:
    """Bag F1 where two empty texts agree fully."""
    np_, nr = F.col(f"{prefix}np"), F.col(f"{prefix}nr")
    return F.when((np_ == 0) & (nr == 0), F.lit(1.0)).otherwise(
        F.bround(f1(F.col(f"{prefix}m1"), np_, nr), 4)
    )


def token_f1(prefix: str) -> Column:
    return f1(F.col(f"{prefix}m1"), F.col(f"{prefix}np"), F.col(f"{prefix}nr"))


def bleu(prefix: str, n: int) -> Column:
    """BLEU-n where each log precision is divided by its own order.

    The first order without a match zeroes itself and every higher order: a
    missing match makes the logarithm null, and null adds up to null.
    """
    np_, nr = F.col(f"{prefix}np"), F.col(f"{prefix}nr")
    brevity = F.least(F.lit(1.0), F.exp(1 - nr / F.nullif(np_, F.lit(0))))
    logs = [
        F.log(F.nullif(F.col(f"{prefix}m{i}"), F.lit(0)) / F.nullif(_grams(np_, i), F.lit(0))) / i
        for i in range(1, n + 1)
    ]
    total = logs[0]
    for term in logs[1:]:
        total = total + term
    return F.when(nr == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.bround(brevity * F.exp(total), 4), F.lit(0.0))
    )


def cider_like(prefix: str) -> Column:
    np_, nr = F.col(f"{prefix}np"), F.col(f"{prefix}nr")
    total = F.lit(0.0)
    for n, weight in enumerate(fixed.CIDER_WEIGHTS, start=1):
        total = total + weight * f1(F.col(f"{prefix}m{n}"), _grams(np_, n), _grams(nr, n))
    return F.least(F.lit(1.0), total)


def length_reward(count: Column) -> Column:
    return (
        F.when(count.between(4, 16), F.lit(1.0))
        .when(count.between(1, 20), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def instruction_metrics(df: DataFrame, pred: Column, ref: Column, prefix: str = "_t2") -> DataFrame:
    """The ten instruction scores of a pair; all zero when a side is blank.

    Without a sentence encoder the two semantic scores equal ROUGE-L.
    """
    out = with_overlap(df, pred, ref, space_tokens, prefix)
    blank = (F.col(f"{prefix}np") == 0) | (F.col(f"{prefix}nr") == 0)  # no token on a side
    rl = F.bround(rouge_l(prefix), 4)
    scores = {
        "rouge_1": rouge_n(prefix, 1), "rouge_2": rouge_n(prefix, 2), "rouge_l": rl,
        "bleu_1": bleu(prefix, 1), "bleu_2": bleu(prefix, 2),
        "bleu_3": bleu(prefix, 3), "bleu_4": bleu(prefix, 4),
        "token_f1": token_f1_rounded(prefix), "semantic_similarity": rl, "bertscore_f1": rl,
    }
    return out.withColumns(
        {k: F.when(blank, F.lit(0.0)).otherwise(v) for k, v in scores.items()}
    )


def reference_text(
    label: Column, enhanced: Column, prior: Column, instruction: Column
) -> Column:
    """Label text by fallback; a label text counts even when it is empty."""
    return F.coalesce(label, first_present(enhanced, prior), instruction, F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two normalised vectors."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def embed_similarity(a: Column, b: Column, pred: Column, ref: Column) -> Column:
    p, r = strip(F.coalesce(pred, F.lit(""))), strip(F.coalesce(ref, F.lit("")))
    return (
        F.when((p == "") | (r == ""), F.lit(0.0))
        .when(F.lower(p) == F.lower(r), F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b))))
    )


def clip_similarity(a: Column, b: Column) -> Column:
    mapped = (cosine(a, b) + 1.0) / 2.0
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), mapped))
    )
