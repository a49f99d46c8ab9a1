"""Connected components of a table of links, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayline.llm.spread import spread_join
from wayline.workspace import written

C = F.col


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links(a, b); nodes without a link are not listed.

    Alternating stars: every node hangs its larger neighbours, then its smaller
    ones, under the smallest node it knows. Links become stars around the minima
    in a logarithmic number of rounds in practice; each round is written to the
    shared folder. A node with very many links is one key of an aggregate that
    combines before the shuffle, and its links are dealt over several tasks.
    """
    # child > parent
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(C("v").alias("u"), C("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, ["u"], "inner", C("v")).where("v > u").select(C("v").alias("u"), C("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, lower, ["u"], "inner", C("v"))
        after = written(
            small.where("v <> m").select(C("v").alias("u"), C("m").alias("v")).unionByName(lower.select("u", C("m").alias("v"))).where("u <> v").distinct(), "stars")
        edges, now = after, _digest(after)
        if now == before:
            break
        before = now
    return edges.select(C("u").alias("node"), C("v").alias("component")).unionByName(
        edges.select(C("v").alias("node"), C("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number of distinct links and two 64-bit sums over them: equal for equal tables."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64("v", "u"))).first())
