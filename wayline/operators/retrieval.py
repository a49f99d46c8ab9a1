"""Nearest examples by vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.functions.text import cosine
from wayline.operators.ordered import first_rows


def index_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Index content: writing an id again replaces its row; ``order`` is unique per id."""
    return first_rows(rows, [key], order, last=True)


def top_similar(index: DataFrame, query: Column, n: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The n rows most similar to one query vector (a literal or scalar subquery).

    Every task keeps only its own best n; no shuffle of the index.
    """
    scored = index.withColumn("_q", query).withColumn("score", cosine(F.col(vector), F.col("_q")))
    return scored.drop("_q").orderBy(F.desc("score"), key).limit(n)


def diverse_examples(
    index: DataFrame, query: Column, maneuver: Column, k: int = 3, min_reward: float = 0.5,
    vector: str = "embedding", key: str = "vec_id",
) -> DataFrame:
    """Up to k examples: two of the same maneuver, one other, then the rest.

    3k candidates are fetched, so all that follows runs on 3k rows.
    """
    near = top_similar(index.where(F.col("reward") >= min_reward), query, 3 * k, vector, key)
    same = F.coalesce(
        (F.upper("maneuver") == F.upper(maneuver)) & (maneuver != ""), F.lit(False)
    )
    order = W.partitionBy("_same").orderBy(F.desc("score"), key)
    ranked = near.withColumn("_same", same).withColumn("_at", F.row_number().over(order))
    slot = (
        F.when(F.col("_same") & (F.col("_at") <= 2), F.lit(0))
        .when(~F.col("_same") & (F.col("_at") <= 1), F.lit(1))
        .when(F.col("_same"), F.lit(2)).otherwise(F.lit(3))
    )
    return ranked.withColumn("_slot", slot).orderBy("_slot", "_at").limit(k).withColumn(
        "same_maneuver", F.col("_same")
    ).drop("_slot", "_at", "_same")
