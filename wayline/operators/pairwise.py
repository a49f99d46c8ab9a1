"""Pairs of models, judge votes, win counts and ratings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions.core import present
from wayline.functions.normalize import company_of_model


def hash_number(*cols: Column) -> Column:
    """0 .. 2**32-1 from a text key; the same on every engine that has MD5."""
    return F.conv(F.left(F.md5(F.concat_ws("|", *cols)), F.lit(8)), 16, 10).cast("bigint")


def cross_company_pairs(
    models: DataFrame, seed: int = 42, blocks: int = 16, ratings: DataFrame | None = None, max_gap: float = 0,
) -> DataFrame:
    """All unordered pairs of models of different companies, with a seeded A side.

    The result is every pair, so the work is split evenly instead of joined
    without a key: models fall into hash blocks, each block pair is one key.
    With ``ratings`` (one row per model) and a gap only pairs within the gap are
    made: ratings fall into bands as wide as the gap and meet the bands beside
    them.  A model without a rating has the start rating; a gap of 0 switches
    the rule off.
    """
    banded = ratings is not None and bool(max_gap)
    one = models.select("model_id").distinct().withColumns(
        {
            "company": company_of_model(F.col("model_id")),
            "_b": (hash_number(F.col("model_id")) % blocks).cast("int"),
        }
    )
    if banded:
        one = one.join(ratings.select("model_id", F.col("rating").alias("_r")), "model_id", "left")
        one = one.withColumn("_r", F.coalesce("_r", F.lit(fixed.START_RATING)).cast("double"))
        one = one.withColumn("_band", F.floor(F.col("_r") / F.lit(float(max_gap))))
    else:
        one = one.withColumns({"_r": F.lit(0.0), "_band": F.lit(0).cast("long")})
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    near = F.array(*[F.col("_band") + d for d in ((-1, 0, 1) if banded else (0,))])
    side = lambda x, lo, hi, bands: one.select(
        F.col("model_id").alias(f"model_{x}"), F.col("company").alias(f"company_{x}"), F.col("_r").alias(f"_r{x}"),
        F.explode(every).alias("_o"), "_b", bands.alias("_bands"),
    ).select(f"model_{x}", f"company_{x}", f"_r{x}", F.col(lo).alias("_i"), F.col(hi).alias("_j"), F.explode("_bands").alias("_band"))
    pairs = side("x", "_b", "_o", near).join(side("y", "_o", "_b", F.array("_band")), ["_i", "_j", "_band"]).where(
        (F.col("model_x") < F.col("model_y")) & (F.col("company_x") != F.col("company_y"))
        & (F.abs(F.col("_rx") - F.col("_ry")) <= float(max_gap) if banded else F.lit(True))
    )
    first = hash_number(F.col("model_x"), F.col("model_y"), F.lit(str(seed))) % 2 == 0
    pick = lambda a, b, c: F.when(first, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}"))
    return pairs.select(
        pick("x", "y", "model").alias("model_a"), pick("y", "x", "model").alias("model_b"),
        pick("x", "y", "company").alias("company_a"), pick("y", "x", "company").alias("company_b"),
    )


def close_pairs(pairs: DataFrame, ratings: DataFrame, max_gap: float = 600) -> DataFrame:
    """Pairs within the rating gap; 0 switches the rule off."""
    if not max_gap:
        return pairs
    side = lambda x: ratings.select(F.col("model_id").alias(f"model_{x}"), F.col("rating").alias(f"_r{x}"))
    start = F.lit(fixed.START_RATING)
    rated = pairs.join(side("a"), "model_a", "left").join(side("b"), "model_b", "left")
    gap = F.abs(F.coalesce("_ra", start) - F.coalesce("_rb", start))
    return rated.where(gap <= max_gap).drop("_ra", "_rb")


def unjudged(comparisons: DataFrame, judged: DataFrame) -> DataFrame:
    """Comparisons nobody has judged yet, whichever side a model was on."""
    low, high = F.least("model_a", "model_b"), F.greatest("model_a", "model_b")
    left = comparisons.withColumns({"_lo": low, "_hi": high})
    seen = judged.select("sample_id", low.alias("_lo"), high.alias("_hi")).distinct()
    return left.join(seen, ["sample_id", "_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def majority(comparisons: DataFrame) -> DataFrame:
    """Adds the winner of at least two thirds of the judges and at least two of them, else a tie.

    Votes sit inside the row; failed votes do not count.
    """
    ok = F.filter("judge_votes", lambda v: present(v["error"]).isNull())
    n = F.size(ok)
    won = lambda side: F.size(F.filter(ok, lambda v: v["winner"] == side))
    wins = lambda side: (won(side) >= 2) & (won(side) * 3 >= n * 2)
    winner = F.when(wins("A"), F.col("model_a")).when(wins("B"), F.col("model_b"))
    return comparisons.withColumn("majority_winner", winner).withColumn(
        "is_tie", F.col("majority_winner").isNull()
    )


def sides(comparisons: DataFrame) -> DataFrame:
    """One row per model and comparison with its outcome."""
    pair = F.array(
        F.struct(F.col("model_a").alias("model_id"), F.col("model_b").alias("opponent")),
        F.struct(F.col("model_b").alias("model_id"), F.col("model_a").alias("opponent")),
    )
    rows = comparisons.withColumn("s", F.explode(pair))
    win = F.col("majority_winner")
    return rows.select(
        "s.model_id", "s.opponent",
        F.when(win.isNull(), "tie").when(win == F.col("s.model_id"), "win").otherwise("loss").alias("outcome"),
    )


def tally(comparisons: DataFrame) -> DataFrame:
    """Wins, losses and ties per model."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return sides(comparisons).groupBy("model_id").agg(
        n("win").alias("wins"), n("loss").alias("losses"), n("tie").alias("ties"),
        F.count("*").alias("total_comparisons"),
    ).withColumn("company", company_of_model(F.col("model_id")))


def ratings(comparisons: DataFrame, prior: float = 1.0, tolerance: float = 1e-10, most_rounds: int = 10_000, most_models: int = 1000) -> DataFrame:
    """Rating per model: a Bradley-Terry fit on the win matrix.

    A serial rating per match cannot run in parallel; this is our replacement.
    The comparisons are summed to one row per ordered pair of models; only that
    matrix, at most ``most_models`` squared, comes to the driver, and more models
    are refused.  ``prior`` adds that many drawn games against an average model,
    which keeps strengths finite; after each round the strengths are scaled to a
    geometric mean of 1.  Rounds go on until no logarithm of a strength changes
    by more than the tolerance; a fit that does not get there is an error.
    """
    spark = comparisons.sparkSession
    score = F.when(F.col("outcome") == "win", 1.0).when(F.col("outcome") == "tie", 0.5).otherwise(0.0)
    rows = sides(comparisons).groupBy("model_id", "opponent").agg(F.sum(score).alias("points"), F.count("*").alias("games"))
    cells = rows.limit(most_models**2 + 1).collect()
    names = sorted({r["model_id"] for r in cells})
    if len(names) > most_models:
        raise ValueError(f"over {most_models} models: raise most_models if the driver can hold the matrix")
    at = {name: i for i, name in enumerate(names)}
    games, points = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in sorted(cells, key=lambda r: (r["model_id"], r["opponent"])):
        games[at[r["model_id"]], at[r["opponent"]]] = r["games"]
        points[at[r["model_id"]]] += r["points"]
    strength = np.ones(len(names))
    for _ in range(most_rounds if names else 0):
        after = (points + prior / 2) / ((games / (strength[:, None] + strength[None, :])).sum(axis=1) + prior / (strength + 1.0))
        after /= np.exp(np.log(after).mean())
        change, strength = np.abs(np.log(after / strength)).max(), after
        if change <= tolerance:
            break
    else:
        if names:
            raise RuntimeError(f"ratings did not settle in {most_rounds} rounds")
    rated = [(name, float(fixed.START_RATING + 400.0 * np.log10(s))) for name, s in zip(names, strength)]
    return spark.createDataFrame(rated, "model_id string, rating double")


def pair_count(models: DataFrame) -> DataFrame:
    """Number of pairs of different companies, without making one: half of N squared less the squares per company."""
    one = models.select("model_id").distinct().select(company_of_model(F.col("model_id")).alias("company"))
    sizes = one.where(F.col("company").isNotNull()).groupBy("company").agg(F.count("*").alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(((n * n - F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))) / 2).cast("long").alias("pairs"))


def benchmark_cost(models: DataFrame, samples: DataFrame, limit: int | None = None) -> DataFrame:
    """Comparisons, judge calls and dollars of judging every pair of models on every sample."""
    n_pairs = pair_count(models)
    n_samples = samples.agg(F.count("*").alias("samples")).select(
        F.col("samples") if limit is None else F.least("samples", F.lit(limit)).alias("samples")
    )
    total = F.col("pairs") * n_samples.select("samples").scalar()
    return n_pairs.select("pairs", total.alias("total_comparisons")).withColumns(
        {
            "total_judge_calls": F.col("total_comparisons") * fixed.JUDGES_PER_COMPARISON,
            "estimated_cost_usd": F.bround(
                F.col("total_comparisons") * fixed.JUDGES_PER_COMPARISON * fixed.JUDGE_USD_PER_CALL, 4
            ),
        }
    )


def ranking_rows(judged: DataFrame) -> DataFrame:
    """Ranking arrays of judge answers as rows; failed answers drop out."""
    return judged.where(present(F.col("error")).isNull()).select(
        "sample_id", F.explode("rankings").alias("r")
    ).select("sample_id", "r.model", "r.total_score")


def ranking_counts(judged: DataFrame) -> DataFrame:
    failed = present(F.col("error")).isNotNull()
    return judged.agg(
        F.count("*").alias("judged"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed")
    )


def seeded_sample(rows: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement by a seeded hash of their key; all when fewer."""
    return rows.withColumn("_h", hash_number(key.cast("string"), F.lit(str(seed)))).orderBy(
        "_h", key
    ).limit(n).drop("_h")


def weighted_sample(rows: DataFrame, key: Column, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows, each ``weight`` times likelier (Efraimidis and Spirakis 2006)."""
    u = (hash_number(key.cast("string"), F.lit(str(seed))) + 1) / float(2**32 + 1)
    return rows.withColumn("_k", -F.log(u) / weight).orderBy("_k", key).limit(n).drop("_k")
