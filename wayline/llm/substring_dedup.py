"""Remove words covered by a window of words that occurs earlier.

First pass: every task counts the anchors of its windows (the window's smallest
5-word hash) in a count-min sketch; the partition sketches are merged. A window
cannot occur more often than its anchor, so the merged sketch overestimates every
window's count. Second pass: only windows whose estimate is two or more are
grouped exactly, by 96-bit hashes, to find the first occurrence. Nothing is lost:
an estimate is never too low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from wayline.llm import packets, words
from wayline.workspace import written

C = F.col
WINDOW, GRAM = 20, 5
CHUNK_BITS = 18
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def anchors(grams: np.ndarray, n_windows: int, grams_per_window: int) -> np.ndarray:
    """Per window: position of its smallest gram, the leftmost of equals; depends on the window's words only."""
    out = np.empty(n_windows, np.int64)
    step = 1 << 22
    for lo in range(0, n_windows, step):
        hi = min(n_windows, lo + step)
        part = grams[lo : hi + grams_per_window - 1]
        key = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width < grams_per_window:
            more = min(width, grams_per_window - width)
            key = np.minimum(key[: len(key) - more], key[more:])
            width += more
        out[lo:hi] = (key[: hi - lo] & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    return out


class Windows:
    """Windows of the texts of a slice: text number, start in words, anchor position and hash."""

    def __init__(self, texts: list[bytes | None], window: int, gram: int):
        self.words = words.Words(texts)
        self.counts = self.words.counts
        self.hash = self.words.hashes()
        n = np.maximum(self.counts - window + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), n)
        first = self.words.first[:-1]
        self.start = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.at = np.repeat(first, n) + self.start
        self.grams = words.run_hashes(self.hash, gram)
        if len(self.at):
            self.anchor = anchors(self.grams, int(self.at[-1]) + 1, window - gram + 1)[self.at]
        else:
            self.anchor = np.zeros(0, np.int64)


def cells_of(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for row in _ROWS:
        yield words.mix(grams * row) >> np.uint64(64 - bits)


def sketch(docs: DataFrame, bits: int, window: int = WINDOW, gram: int = GRAM) -> dict[tuple[int, int], np.ndarray]:
    """Merged count-min sketch of the anchors: (row, chunk) -> 2-bit counts, 0, 1 or 2 for more.

    Partition sketches travel as lists of used cells. The merged one has at most
    2 x 2**bits cells, 2 bits each, whatever the input.
    """

    def rows(cells: list[np.ndarray]) -> pa.RecordBatch:
        out = {"row": [], "chunk": [], "once": [], "more": []}
        for r, c in enumerate(cells):
            cell, n = np.unique(c, return_counts=True)
            chunk = (cell >> np.uint64(CHUNK_BITS)).astype(np.int64)
            low = (cell & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint32)
            cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
            for lo, hi in zip(cut, np.append(cut[1:], len(chunk))):
                many = n[lo:hi] > 1
                for k, v in zip(out, (r, int(chunk[lo]), low[lo:hi][~many].tobytes(), low[lo:hi][many].tobytes())):
                    out[k].append(v)
        return pa.RecordBatch.from_pydict(out, schema=PART)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in _ROWS]
        size = 0
        for batch in batches:
            for part in words.slices(batch):
                w = Windows(words.texts_of(part), window, gram)
                g = w.grams[np.unique(w.anchor)]
                for at, c in zip(held, cells_of(g, bits)):
                    at.append(c)
                size += len(g)
                if size > 4_000_000:
                    yield rows([np.concatenate(h) for h in held])
                    held, size = [[] for _ in _ROWS], 0
        if size:
            yield rows([np.concatenate(h) for h in held])

    def merge(key, table):
        total = np.zeros(1 << CHUNK_BITS, np.uint8)
        for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist()):
            total[np.frombuffer(once, np.uint32)] += 1
            np.minimum(total, 2, out=total)
            total[np.frombuffer(more, np.uint32)] = 2
        packed = (total[0::4] | (total[1::4] << 2) | (total[2::4] << 4) | (total[3::4] << 6)).tobytes()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([packed], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "row int, chunk int, once binary, more binary")
    merged = parts.groupBy("row", "chunk").applyInArrow(merge, "row int, chunk int, cells binary")
    return {(r["row"], r["chunk"]): np.frombuffer(bytes(r["cells"]), np.uint8) for r in merged.toLocalIterator()}


PART = pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def estimated_repeated(table: dict[tuple[int, int], np.ndarray], grams: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch counts each gram twice or more in every row."""
    out = np.ones(len(grams), bool)
    for r, cell in enumerate(cells_of(grams, bits)):
        chunk = (cell >> np.uint64(CHUNK_BITS)).astype(np.int64)
        low = (cell & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        cut = np.searchsorted(chunk[order], np.arange((1 << max(0, bits - CHUNK_BITS)) + 1))
        for c in np.flatnonzero(np.diff(cut)):
            at = order[cut[c] : cut[c + 1]]
            have = table.get((r, int(c)))
            out[at] &= ((have[low[at] >> 2] >> ((low[at] & 3) * 2).astype(np.uint8)) & 3) >= 2 if have is not None else False
    return out


def later_windows(docs: DataFrame, bits: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, starts): the windows of each document that also start earlier, as sorted 32-bit numbers.

    Within a task's slice equal windows are settled at once and only the first
    goes on, so a window that a third of the documents share reaches its bucket
    once per slice, not once per document.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(sketch(docs, bits, window, gram))  # at most 2**bits bytes

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                w = Windows(words.texts_of(part), window, gram)
                used, inverse = np.unique(w.anchor, return_inverse=True)
                chosen = np.flatnonzero(estimated_repeated(shared.value, w.grams[used], bits)[inverse]) if len(used) else np.zeros(0, np.int64)
                if not len(chosen):
                    continue
                at, start = w.at[chosen], w.start[chosen].astype(np.uint32)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[w.text[chosen]]
                h1 = words.run_hashes(w.hash, window)[at]
                h2 = (words.run_hashes(w.words.hashes(second=True), window)[at] >> np.uint64(32)).astype(np.uint32)
                first = earliest(h1, h2, ids, start)
                seen = ~first
                yield packets.pack(packets.buckets_of(h1[first], n), ids[first], h1[first], h2[first], start[first])
                if seen.any():
                    yield _settled(ids[seen], start[seen], n)

    def group(ids, h1, h2, start):
        later = ~earliest(h1, h2, ids, start)
        if later.any():
            yield _settled(ids[later], start[later], n)

    def collect(ids, start):
        order = np.lexsort((start, ids))
        ids, start = ids[order], start[order]
        cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[cut], pa.int64()), pa.array([start[lo:hi].tobytes() for lo, hi in zip(cut, np.append(cut[1:], len(ids)))], pa.binary())], ["doc_id", "starts"])

    found = written(docs.select("doc_id", "text").mapInArrow(candidates, packets.SCHEMA), "windows")
    settled = found.where(C("bucket") < 0)
    grouped = packets.per_bucket(found.where(C("bucket") >= 0), (np.uint64, np.uint32, np.uint32), group, packets.SCHEMA)
    return packets.per_bucket(settled.unionByName(grouped), (np.uint32,), collect, "doc_id bigint, starts binary")


def _settled(ids: np.ndarray, start: np.ndarray, n: int) -> pa.RecordBatch:
    """Windows known to start earlier elsewhere, dealt by document; buckets below zero."""
    return packets.pack(-1 - packets.spread_ids(ids, n), ids, start)


def earliest(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries have no equal window with a smaller (document, start)."""
    out = np.ones(len(h1), bool)
    order = np.argsort(h1, kind="stable")
    s = h1[order]
    same = s[1:] == s[:-1]
    among = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(s) else order
    if len(among):
        among = among[np.lexsort((start[among], ids[among], h2[among], h1[among]))]
        a, b = among[1:], among[:-1]
        twin = (h1[a] == h1[b]) & (h2[a] == h2[b])
        lead = np.concatenate([[0], np.where(twin, 0, np.arange(1, len(among)))])
        head = among[np.maximum.accumulate(lead)]
        out[among] = (ids[among] == ids[head]) & (start[among] == start[head])
    return out


def sketch_bits(docs: DataFrame, most_bits: int) -> int:
    """About four cells per anchor (one anchor per 50 bytes of text), at most 2**most_bits."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(most_bits, max(CHUNK_BITS + 2, np.ceil(np.log2(4 * size / 50 + 1)))))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most_bits: int = 27) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs(doc_id, text).

    A word goes when some window of `window` consecutive words that covers it has
    the same words as one that starts earlier: in a smaller doc_id, or earlier in
    the same document. Windows are judged on the input. kept_text is the other
    words joined by one space. Null counts as a text without words. A null id is
    smaller than every other; rows that share an id count as one document given
    several times. Texts shorter than a window lose nothing. Other columns are
    ignored. A sketch of 2**most_bits cells and more anchors than that only means
    that more windows are grouped exactly.
    """
    docs = docs.select(F.coalesce(C("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), "text")
    later = later_windows(docs, sketch_bits(docs, most_bits), window, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                n_words, n_removed, kept = [], [], []
                for text, starts in zip(words.texts_of(part), part.column("starts").to_pylist()):
                    parts = (text or b"").split()
                    n_words.append(len(parts))
                    if starts:
                        edge = np.zeros(len(parts) + 1, np.int64)
                        s = np.frombuffer(starts, np.uint32).astype(np.int64)
                        s = s[s + window <= len(parts)]
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        parts = [p for p, ok in zip(parts, stay.tolist()) if ok]
                    n_removed.append(n_words[-1] - len(parts))
                    kept.append(b" ".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [pc.if_else(pc.equal(part.column("doc_id"), -(2**63)), None, part.column("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.join(written(later, "later"), "doc_id", "left").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
