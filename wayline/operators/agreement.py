"""Rank agreement between two score columns, exact at any size.

Everything works on distinct values with counts.  No pairs of rows are formed:
concordant pairs are counted along a binary split of the y ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.operators.ordered import dense_ordinal, running_sums, total_before
from wayline.workspace import durable

BIG = "decimal(19,0)"


def value_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Average rank of every distinct value (ties share the mean place)."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    placed = total_before(counts, value, "_n", "_before")
    return placed.select(value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    return df.join(value_ranks(df, value, out), value)


def pearson(df: DataFrame, x: str, y: str) -> Column:
    """Correlation aggregate; 0 for no rows or a constant side."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.coalesce(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def collapsed(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) points with their counts.

    Written once: the rank steps read them several times, and the scores behind
    them are expensive.  The two scores of a row are written before that, too: a
    filter on a score would else be moved down to the scan together with the
    whole expression, each use of a part of it evaluated again.
    """
    scored = durable(df.select(F.col(x).alias("x"), F.col(y).alias("y")))
    points = scored.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.count("*").alias("n"))
    return durable(points)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and the correlation of the average ranks, six decimals."""
    return spearman_of(collapsed(df, x, y))


def spearman_of(pts: DataFrame) -> DataFrame:
    weighted = lambda c: pts.groupBy(c).agg(F.sum("n").alias("_n"))
    rank = lambda c: total_before(weighted(c), c, "_n", "_b").select(
        c, (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(f"r{c}")
    )
    n = F.col("n")
    rows = pts.join(rank("x"), "x").join(rank("y"), "y")
    sums = rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(n * F.col("rx")).alias("sx"), F.sum(n * F.col("ry")).alias("sy"),
        F.sum(n * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(n * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(n * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.nullif(n, F.lit(0))
    var = lambda c: F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.nullif(n, F.lit(0))
    spread = F.sqrt(var("x") * var("y"))
    value = F.when((var("x") > 0) & (var("y") > 0), cov / spread).otherwise(F.lit(0.0))
    return sums.select("n", F.bround(F.coalesce(value, F.lit(0.0)), 6).alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n and Kendall's tau-b, six decimals.

    Two y ranks first differ at exactly one binary digit; below their common
    prefix the smaller one is on the 0 side.  So for every digit and prefix the
    pairs are counted with one running sum over x: n log n rows in place of n
    squared pairs.
    """
    return kendall_of(collapsed(df, x, y))


def kendall_of(pts: DataFrame) -> DataFrame:
    xs = dense_ordinal(pts.select("x").distinct(), ["x"], "xr")
    ys = dense_ordinal(pts.select("y").distinct(), ["y"], "yr")
    ranked = pts.join(xs, "x").join(ys, "y").select("xr", "yr", "n")
    # one number bounds the digits: the count of distinct y values
    top = ys.agg(F.coalesce(F.max("yr"), F.lit(0)).alias("m")).select("m").scalar()
    digit = F.explode(F.sequence(F.lit(0), F.length(F.bin(top)) - 1)).alias("digit")
    shift = lambda by: F.call_function("shiftright", F.col("yr"), by)
    split = ranked.select("xr", "yr", "n", digit).select(
        "digit", shift(F.col("digit") + 1).alias("prefix"), "xr",
        F.when(shift(F.col("digit")) % 2 == 0, F.col("n")).otherwise(0).alias("low"),
        F.when(shift(F.col("digit")) % 2 == 1, F.col("n")).otherwise(0).alias("high"),
    )
    split = split.groupBy("digit", "prefix", "xr").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    walked = running_sums(split, ["digit", "prefix"], "xr", {"before": F.col("low")}, inclusive=False)
    agree = walked.agg(
        F.coalesce(F.sum(F.col("high").cast(BIG) * F.col("before").cast(BIG)), F.lit(0)).alias("v")
    )
    pair_sum = lambda d: d.agg(
        F.coalesce(F.sum(F.col("n").cast(BIG) * (F.col("n") - 1).cast(BIG)), F.lit(0)).alias("v")
    ).select("v").scalar().cast("double") / 2.0
    per = lambda c: pts.groupBy(c).agg(F.sum("n").alias("n"))
    total = pts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    n = F.col("n").cast("double")
    out = total.select(
        "n", (n * (n - 1) / 2.0).alias("pairs"), agree.select("v").scalar().cast("double").alias("c"),
        pair_sum(per("x")).alias("tx"), pair_sum(per("y")).alias("ty"), pair_sum(pts).alias("txy"),
    )
    c = F.col("c")
    d = F.col("pairs") - F.col("tx") - F.col("ty") + F.col("txy") - c
    base = F.sqrt((c + d + F.col("tx") - F.col("txy")) * (c + d + F.col("ty") - F.col("txy")))
    tau = F.coalesce((c - d) / F.nullif(base, F.lit(0.0)), F.lit(0.0))
    return out.select("n", F.bround(tau, 6).alias("kendall"))


def calibration(composite: DataFrame, judge: DataFrame) -> DataFrame:
    """Agreement of composite scores with judge scores and whether to refit.

    ``composite`` has (sample_id, composite_score), ``judge`` the ranking rows;
    the judge score of a sample is its 'prediction' row.
    """
    scores = judge.where(F.col("model") == "prediction").select(
        "sample_id", F.col("total_score").cast("double").alias("judge_score")
    )
    both = composite.join(scores, "sample_id")
    pts = collapsed(both, "composite_score", "judge_score")
    rho = spearman_of(pts)
    tau = kendall_of(pts).select("kendall").scalar()
    some = F.col("n") > 0
    return rho.select(
        F.col("n").alias("successful_judged"),
        F.when(some, F.col("spearman")).alias("spearman"), F.when(some, tau).alias("kendall"),
        (~some | (F.col("spearman") < fixed.REFIT_THRESHOLD)).alias("needs_weight_refit"),
    )
