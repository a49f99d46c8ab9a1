"""Mix sources to target weights by fixed-length blocks of tokens.

The documents of a source form one stream of words, cut into blocks. Each output
shard draws how many blocks it takes from each source; the k-th block taken from
a source is found by a pseudorandom permutation of the source's block numbers,
one permutation per pass over the source, and blocks are joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayline.llm import words
from wayline.llm.spread import in_order
from wayline.llm.workers import released
from wayline.workspace import written

C = F.col
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, repeats: float = REPEATS) -> list[float]:
    """Words wanted of each source, in the given order.

    The sources share the sum of all sizes by weight (the weights repeat along
    the order). No target exceeds `repeats` times its source; the excess is
    shared again by weight among the others until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        share = left / sum(w[i] for i in open_)
        above = [i for i in open_ if share * w[i] > repeats * sizes[i]]
        if not above:
            for i in open_:
                target[i] = share * w[i]
            break
        for i in above:
            target[i] = float(repeats * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(above)]
    return target


@dataclass
class Plan:
    """Per source: words, target, blocks, and slots (blocks taken, repeats counted)."""

    sizes: list[int]
    target: list[float]
    blocks: list[int]
    slots: list[int]


def plan_slots(sizes: Sequence[int], block: int, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> Plan:
    """Whole passes over a source while the target allows them, then single blocks up to the target."""
    wanted = targets(sizes, weights, repeats)
    blocks = [-(-s // block) for s in sizes]
    slots = []
    for s, t, n in zip(sizes, wanted, blocks):
        full = min(repeats, int(t / s + 1e-9)) if s else 0
        slots.append(full * n + (min(n, round((t - full * s) / block)) if full < repeats else 0))
    return Plan(list(sizes), wanted, blocks, slots)


def shard_draws(slots: Sequence[int], per_shard: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots) of every draw that is not empty.

    Each shard draws its source counts from a multinomial over what is still
    wanted, so every source reaches its number of slots in the end.
    """
    rng = np.random.default_rng(seed)
    left, first, out, shard = np.array(slots, np.int64), np.zeros(len(slots), np.int64), [], 0
    while left.sum() > 0:
        size = int(min(per_shard, left.sum()))
        take = np.zeros_like(left)
        while size:
            still = left - take
            got = np.minimum(rng.multinomial(size, still / still.sum()), still)
            take += got
            size -= int(got.sum())
        out += [(shard, s, int(first[s]), int(take[s])) for s in np.flatnonzero(take).tolist()]
        first += take
        left -= take
        shard += 1
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 at k, for each row: a Feistel network, walked until the value is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        h, m = half[todo], mask[todo]
        a, b = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            a, b = b, a ^ (words.mix(b + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every whole text; null counts 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                sizes = words.Words(words.texts_of(part)).counts
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])

    d = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(released(count), f"doc_id {d}, source string, size bigint")


def mix(docs: DataFrame, block: int = 64, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 11, per_shard: int = 4096, most_shards: int = 10_000, most_sources: int = 100_000) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs(doc_id, source, text).

    taken is the number of the document's words that the mix takes, repeats
    counted; it never exceeds `repeats` times the size. Sources are ordered by
    code point, null last. The stream of a source is ordered by doc_id, then
    size; rows that repeat are separate documents of the stream. A null or empty
    text has size 0 and takes nothing; an empty table gives an empty result.
    Other columns are ignored. The driver holds one row per source (more than
    most_sources are refused), per draw (at most most_shards x sources) and per
    range of the sorted table.
    """
    spark = docs.sparkSession
    counted = written(word_counts(docs), "sizes")
    per_source = written(counted.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    if per_source.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    totals = sorted(((r["source"], r["size"]) for r in per_source.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    plan = plan_slots([n for _, n in totals], block, weights, repeats)
    per_shard = max(per_shard, -(-sum(plan.slots) // most_shards))
    sources = spark.createDataFrame(
        [(i, name, n, t, b) for i, ((name, n), t, b) in enumerate(zip(totals, plan.target, plan.blocks))],
        "s int, name string, source_size bigint, target double, blocks bigint")
    numbered = counted.join(F.broadcast(sources), C("source").eqNullSafe(C("name"))).select("doc_id", "source", "size", "s", "source_size", "target")
    placed = _word_offsets(in_order(numbered, ["s", "doc_id", "size"], "stream"))
    # blocks that the shards take: the slot number of a source, permuted within its pass
    draws = spark.createDataFrame(shard_draws(plan.slots, per_shard, seed), "shard int, s int, first bigint, n bigint")
    runs = draws.withColumn("piece", F.explode(F.expr("sequence(0L, (n - 1) div 65536)"))).select(
        "shard", "s", (C("first") + C("piece") * 65536).alias("lo"), F.least(C("first") + C("n"), C("first") + (C("piece") + 1) * 65536).alias("hi"))
    # few rows that make many: a fixed number of partitions
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(plan.slots) // 250_000))
    slots = runs.repartition(tasks, "shard", "s").withColumn("slot", F.explode(F.sequence("lo", C("hi") - 1))).join(F.broadcast(sources.select("s", "blocks")), "s")

    @F.pandas_udf("bigint")
    def block_of(s: pd.Series, slot: pd.Series, n: pd.Series) -> pd.Series:
        s, slot, n = (v.to_numpy(np.int64) for v in (s, slot, n))
        key = words.mix((s.astype(np.uint64) << np.uint64(8)) + (slot // n).astype(np.uint64) + (np.uint64(seed) << np.uint64(40)))
        return pd.Series(permuted(slot % n, n, key))

    taken = slots.select("s", block_of("s", "slot", "blocks").alias("block")).groupBy("s", "block").agg(F.count("*").alias("times"))
    # words of each document in each block of its source
    parts = placed.where("size > 0").select(
        "part", "row", "s", "start", (C("start") + C("size")).alias("end"),
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    words_in = F.least(C("end"), (C("block") + 1) * block) - F.greatest(C("start"), C("block") * block)
    per_doc = parts.select("part", "row", "s", "block", words_in.alias("words")).join(taken, ["s", "block"]).groupBy("part", "row").agg(F.sum(C("words") * C("times")).alias("taken"))
    return placed.join(per_doc, ["part", "row"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), "part", "row")


def _word_offsets(ordered: DataFrame) -> DataFrame:
    """Place of each document in its source's stream: sums inside a range, plus what the earlier ranges hold."""
    spark = ordered.sparkSession
    sums = sorted((r["s"], r["part"], r["n"]) for r in ordered.groupBy("s", "part").agg(F.sum("size").alias("n")).collect())
    before, rows = {}, []
    for s, part, n in sums:
        rows.append((s, part, before.get(s, 0)))
        before[s] = before.get(s, 0) + n
    offsets = spark.createDataFrame(rows, "s int, part int, offset bigint")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, s, total = None, None, 0
        for batch in batches:
            parts, ss, sizes = (batch.column(c).to_numpy() for c in ("part", "s", "size"))
            ahead = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            fresh = np.concatenate([[not (len(ss) and ss[0] == s and parts[0] == part)], (ss[1:] != ss[:-1]) | (parts[1:] != parts[:-1])])[: len(ss)]
            base = np.where(fresh, ahead, -1)
            base = np.maximum.accumulate(base) if len(base) else base
            local = ahead - np.maximum(base, 0) + np.where(base < 0, total, 0)
            if len(ss):
                part, s, total = parts[-1], ss[-1], int(local[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "local"])

    # a file of the written table is one range in order; sorting again keeps that where Spark joins several small files
    ranges = ordered.repartition("part").sortWithinPartitions("part", "row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    return ranges.mapInArrow(released(running), f"{fields}, local bigint").join(F.broadcast(offsets), ["s", "part"]).withColumn("start", C("local") + C("offset")).drop("local", "offset")


def mixed_documents(docs: DataFrame, block: int = 64, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 11) -> DataFrame:
    """The mix as whole documents: each row is given as often as the share of it that the mix takes.

    taken / size copies on average: the whole part always, one more with the
    chance of the rest, drawn from a hash of the id. Documents without words
    belong to no block and are left as they are, once. Rows that share an id are
    given as often as the one that is taken most.
    """
    chance = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(C("size") > 0, F.floor(C("taken") / C("size") + chance)).otherwise(1)
    wanted = written(
        mix(docs, block, weights, repeats, seed).withColumn("copies", copies.cast("int")).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0"), "copies")
    # a struct keeps the given columns apart from those added here
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    met = rows.join(wanted, rows["row.doc_id"].eqNullSafe(wanted["doc_id"]))
    return met.select("row", F.explode(F.sequence(F.lit(1), C("copies")))).select("row.*")
