"""Hard negatives by a vertical scan with bounds, dimension by dimension.

Vectors lie in columnar blocks of a few thousand rows. An anchor reads the
dimensions of a block in descending order of its own magnitudes; what the
remaining dimensions can still add, from the block's minimum and maximum of each
dimension, bounds every candidate's score from both sides. Candidates whose
bounds leave the wanted scores are cleared from the bitmap, and only the rest
reads on, until the scores are exact. Positives are such a scan for the highest
scores of the same label, negatives one for the score windows of the positives
over the other labels. Anchors are a stated part of the rows and meet all rows
block by block: each task holds one range of blocks and the anchors stream by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from wayline.llm.spread import spread_join
from wayline.workspace import written

C = F.col
BLOCK_ROWS = 4096
#: dimensions read between two looks at the bounds
STRIDE = 8
BLOCKS = "part int, ids binary, labels binary, low binary, high binary, cells binary"
_BLOCKS = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "low", "high", "cells"))])
_FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND = "anchor_id long, slot int, vec_id long, score long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, dims) in the order of a range, as columnar blocks."""
    held: list[pa.RecordBatch] = []

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        sizes = np.array([len(d) for d in rows.column("dims")], np.int64)
        # shorter vectors go on with zeros
        cells = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
        flat = np.concatenate([np.asarray(d.values, np.int64) for d in rows.column("dims")] or [np.zeros(0, np.int64)])
        cells[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        labels = rows.column("label").to_numpy()
        if cells.size and np.abs(cells).max() < 2**31:
            cells = cells.astype(np.int32)
        out = [rows.column("part")[0].as_py(), rows.column("vec_id").to_numpy().astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(),
               cells.min(0).astype(np.int64).tobytes(), cells.max(0).astype(np.int64).tobytes(), np.ascontiguousarray(cells.T).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, _BLOCKS)], schema=_BLOCKS)

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            yield block(rows.slice(at, BLOCK_ROWS))

    for batch in batches:
        parts = batch.column("part").to_numpy()
        edges = np.flatnonzero(np.diff(parts)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(parts)]):
            if hi == lo:
                continue
            rows = batch.slice(lo, hi - lo)
            if held and held[0].column("part")[0] != rows.column("part")[0]:
                yield from cut(pa.Table.from_batches(held))
                held = []
            held.append(rows)
            if sum(b.num_rows for b in held) >= 4 * BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                whole = table.num_rows // BLOCK_ROWS * BLOCK_ROWS
                yield from cut(table.slice(0, whole))
                held = [b for b in table.slice(whole).to_batches() if b.num_rows]
    if held:
        yield from cut(pa.Table.from_batches(held))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct labels of each block."""
    for batch in batches:
        for part, labels in zip(batch.column("part").to_pylist(), batch.column("labels").to_pylist()):
            values = np.unique(np.frombuffer(labels, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), part, np.int32)), pa.array(values)], names=["part", "label"])


class Block:
    """One columnar block: cells[d] are the values of dimension d of all rows."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.low, self.high = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
        wide = len(row["cells"]) == 8 * len(self.ids) * len(self.low)
        cells = np.frombuffer(row["cells"], np.int64 if wide else np.int32).reshape(len(self.low), len(self.ids))
        biggest = max((max(-int(self.low.min()), int(self.high.max())) if len(self.low) else 0), 1)
        # sums of products stay below 2**53: floating point is exact and fast
        self.cells = cells.astype(np.float64) if biggest * biggest * max(len(self.low), 1) < 2**53 else cells.astype(np.int64)
        self.biggest = biggest

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the dimensions, and the least and most that those from a position on can add."""
        n = min(len(anchor), len(self.low))
        anchor = anchor[:n]
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort(np.stack([anchor * self.low[:n], anchor * self.high[:n]])[:, order], axis=0)
        tail = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), np.int64)], axis=1)
        return order, tail[0], tail[1]


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, low: int, high: int, best: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of those in `alive`) with a score from low to high, and the scores.

    With best, only rows that can be among the `best` highest of them are sure to be there.
    """
    order, least, most = block.bounds(anchor)
    exact = block.cells.dtype == np.int64 or np.abs(anchor).max(initial=0) * block.biggest * max(len(order), 1) < 2**53
    cells = block.cells if exact else block.cells.astype(np.int64)
    weights = anchor.astype(cells.dtype)
    score = np.zeros(len(alive), cells.dtype)
    for at in range(0, len(order) + 1, STRIDE):
        if best and len(alive) > best:
            low = max(low, int(np.partition(score, len(score) - best)[len(score) - best]) + int(least[at]))
        keep = (score + most[at] >= low) & (score + least[at] <= high)
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if not len(alive) or at >= len(order):
            break
        dims = order[at : at + STRIDE]
        part = cells[dims] if len(alive) == cells.shape[1] else cells[np.ix_(dims, alive)]
        score = score + weights[dims] @ part
    else:
        keep = (score >= low) & (score <= high)
        alive, score = alive[keep], score[keep]
    return alive, score.astype(np.int64)


def _top(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _positives(blocks: list[Block], row: dict, n: int) -> Iterator[tuple[int, int, int]]:
    """(slot 0, id, score) of the n highest scores of the anchor's label in these blocks."""
    anchor = np.array(row["dims"], np.int64)
    ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks:
        alive = np.flatnonzero((block.labels == row["label"]) & (block.ids != row["anchor_id"]))
        if len(alive):
            low = int(scores[-1]) if len(scores) == n else -(2**62)
            found, score = scan(block, anchor, alive, low, 2**62, n)
            ids, scores = np.append(ids, block.ids[found]), np.append(scores, score)
            order = _top(ids, scores, n)
            ids, scores = ids[order], scores[order]
    yield from ((0, int(i), int(s)) for i, s in zip(ids, scores))


def _negatives(blocks: list[Block], row: dict, n: int) -> Iterator[tuple[int, int, int]]:
    """(slot, id, score) of the n highest scores of other labels within the window of each slot."""
    anchor = np.array(row["dims"], np.int64)
    windows = [(w["low"], w["high"], w["slot"]) for w in row["windows"] if w["low"] <= w["high"]]
    held = {slot: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for _, _, slot in windows}
    if not windows:
        return
    for block in blocks:
        alive = np.flatnonzero(block.labels != row["label"])
        if not len(alive):
            continue
        # a window that is full takes nothing below its last score
        floor = min(max(low, int(held[slot][1][-1])) if len(held[slot][1]) == n else low for low, _, slot in windows)
        found, score = scan(block, anchor, alive, floor, max(high for _, high, _ in windows))
        for low, high, slot in windows:
            fits = (score >= low) & (score <= high)
            if fits.any():
                ids, scores = np.append(held[slot][0], block.ids[found[fits]]), np.append(held[slot][1], score[fits])
                order = _top(ids, scores, n)
                held[slot] = (ids[order], scores[order])
    for slot, (ids, scores) in held.items():
        yield from ((slot, int(i), int(s)) for i, s in zip(ids, scores))


def _meet(blocks: DataFrame, asked: DataFrame, ranges: int, n: int, way) -> DataFrame:
    """Every asked row (part, anchor_id, label, dims, windows) against the blocks of its part."""
    of = "part int, kind int, block struct<ids: binary, labels: binary, low: binary, high: binary, cells: binary>, asked struct<anchor_id: long, label: long, dims: array<long>, windows: array<struct<slot: int, low: long, high: long>>>"
    empty = lambda name: F.lit(None).cast(of.split(f"{name} ")[1].rsplit(", asked", 1)[0] if name == "block" else of.split("asked ")[1]).alias(name)
    left = blocks.select("part", F.lit(0).alias("kind"), F.struct("ids", "labels", "low", "high", "cells").alias("block"), empty("asked"))
    right = asked.select("part", F.lit(1).alias("kind"), empty("block"), F.struct("anchor_id", "label", "dims", "windows").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], [[], [], [], []]
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column("part")[i].as_py()
                if part != at:
                    at, held = part, []
                if batch.column("kind")[i].as_py() == 0:
                    held.append(Block(batch.column("block")[i].as_py()))
                    continue
                row = batch.column("asked")[i].as_py()
                for found in way(held, row, n):
                    for column, value in zip(out, (row["anchor_id"], *found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)
            out = [[], [], [], []]

    # a fixed number of partitions: the rows are few bytes and much work
    return left.unionByName(right).repartition(ranges, "part").sortWithinPartitions("part", "kind").mapInArrow(run, FOUND)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows_per_part: int = 65_536) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, label (integers), dims (array of integers; a shorter one goes
    on with zeros); other columns are ignored. Rows with a null in any of the
    three or in dims take no part; of rows with the same vec_id the one with the
    smallest (label, dims) counts. is_anchor: a condition on vec_id and label. A
    score is the inner product with the anchor, ties go to the smaller vec_id. Of
    each anchor's `positives` best other rows of its label, the `negatives` best
    rows of other labels with low * positive_score <= 100 * negative_score <= high
    * positive_score are given (percentages, 0 to 100); pairs without any give no
    row. Scores are exact while they fit 63 bits, and wrap beyond. Work is anchors times rows; a task holds at most
    about rows_per_part rows as numbers.
    """
    spark = vectors.sparkSession
    usable = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND dims IS NOT NULL AND forall(dims, x -> x IS NOT NULL)").select(
        C("vec_id").cast("long").alias("vec_id"), C("label").cast("long").alias("label"), C("dims").cast("array<long>").alias("dims"))
    one = written(usable.groupBy("vec_id").agg(F.min(F.struct("label", "dims")).alias("v")).select("vec_id", "v.*"), "vectors")
    total = one.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(min(2 * tasks, math.ceil(total / 256)), math.ceil(total / rows_per_part), 1)
    # rows of a label lie together: then most blocks are of one label, with narrow minima and maxima
    ordered = one.repartitionByRange(ranges, "label", "vec_id").sortWithinPartitions("label", "vec_id").withColumn("part", F.spark_partition_id())
    blocks = written(ordered.select("part", "vec_id", "label", "dims").mapInArrow(_cut, BLOCKS), "blocks")
    anchors = written(one.where(is_anchor).select(C("vec_id").alias("anchor_id"), "label", "dims"), "anchors")
    none = F.array().cast("array<struct<slot: int, low: long, high: long>>").alias("windows")
    # positives: only the parts that hold the anchor's label
    holds = blocks.select("part", "labels").mapInArrow(_labels, "part int, label long").distinct()
    near = spread_join(anchors, holds, ["label"], "inner", C("anchor_id")).select("part", "anchor_id", "label", "dims", none)
    best = lambda found, by, n: found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(C("score").desc(), "vec_id"))).where(C("rank") <= n)
    firsts = written(best(_meet(blocks, near, ranges, positives, _positives), ["anchor_id"], positives).select("anchor_id", C("rank").alias("slot"), C("vec_id").alias("positive_id"), C("score").alias("positive_score")), "positives")
    # 100 * s between low * p and high * p, with p = 100 * q + r: nothing overflows
    q, r = "(positive_score div 100 - IF(positive_score % 100 < 0, 1, 0))", "pmod(positive_score, 100)"
    window = F.struct("slot", F.expr(f"{low} * {q} + ({low} * {r} + 99) div 100").alias("low"), F.expr(f"{high} * {q} + ({high} * {r}) div 100").alias("high"))
    windows = firsts.groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    far = anchors.join(windows, "anchor_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).select("part", "anchor_id", "label", "dims", "windows")
    found = best(_meet(blocks, far, ranges, negatives, _negatives), ["anchor_id", "slot"], negatives)
    return found.join(firsts, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", C("vec_id").alias("negative_id"), "positive_score", C("score").alias("negative_score"))
