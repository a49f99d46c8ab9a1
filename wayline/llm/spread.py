"""Joins and orders that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wayline.workspace import written

C = F.col


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, by: Column, salts: int = 16) -> DataFrame:
    """Join to a table with one row per key; the left rows of a key are dealt over `salts` tasks."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def in_order(df: DataFrame, by: Sequence[str | Column], label: str) -> DataFrame:
    """The rows range-sorted and written, with `part` (range) and `row` (place in it).

    Equal keys may be split between ranges, so no key makes a range large unless
    whole sort keys repeat. The written table fixes the order for later jobs.
    """
    place = F.monotonically_increasing_id()
    return written(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", place), label
    ).withColumn("part", F.shiftright("_at", 33).cast("int")).withColumn("row", C("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
