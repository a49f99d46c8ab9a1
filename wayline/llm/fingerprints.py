"""Fingerprints of improbable byte windows in chained Bloom filters.

Every window of 64 bytes has an entropy. How rare its entropy is in the whole
collection ranks it; in each stretch of 64 neighbouring windows the rarest one
scores a point, and windows with enough points are the features of the text.
Features go into a chain of Bloom filters of bounded load. Two chains are as
alike as their filters' bit overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayline.llm import words

C = F.col
WIDTH = 64
LEVELS = 1000
LOWEST = LEVELS // 6  # windows below one bit per byte say nothing
POINTS = 16
BITS, PROBES, LOAD = 2048, 5, 160
SHORT, SHORT_WIDTH = 192, 8  # texts below SHORT bytes have few wide windows: all their short windows are features
_CHUNK = 1 << 17
_CLOG = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WIDTH + 1)], np.int64)
_EXCLUDED = np.int64(1 << 20)


def entropy_levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS) of every window of WIDTH bytes."""
    n = len(raw) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, behind = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
    same = np.empty(_CHUNK, bool)
    for lo in range(0, len(raw), _CHUNK):
        hi = min(len(raw), lo + _CHUNK)
        for k in range(1, WIDTH):
            # positions lo..hi against those k earlier
            a = max(lo, k)
            if a >= hi:
                continue
            eq = np.equal(raw[a:hi], raw[a - k : hi - k], out=same[: hi - a]).view(np.uint8)
            np.add(before[a:hi], eq, out=before[a:hi])
            np.add(behind[a - k : hi - k], eq, out=behind[a - k : hi - k])
    gain = _CLOG[1:] - _CLOG[:-1]
    # a byte enters with the equal ones among the 63 before it; it leaves with those among the 63 behind it
    change = np.zeros(n, np.int64)
    change[1:] = gain[before[WIDTH:]] - gain[behind[: n - 1]]
    change[0] = _CLOG[np.bincount(raw[:WIDTH])].sum()
    most = WIDTH * 6 * 65536
    return (LEVELS * (most - np.cumsum(change))) // most


class Joined:
    """Texts as one byte array, with the windows that lie inside one text."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.levels = entropy_levels(self.raw)
        inside = np.ones(len(self.levels) + 1, np.int32)
        ends = self.at[1:]
        lo, hi = np.minimum(np.maximum(ends - WIDTH + 1, 0), len(self.levels)), np.minimum(ends, len(self.levels))
        cover = np.zeros(len(self.levels) + 1, np.int32)
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi, -1)
        self.inside = (inside[:-1] > 0) & (np.cumsum(cover[:-1]) == 0)

    def features(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the selected windows and their 64-bit hashes."""
        n = len(self.levels)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rank = np.where(self.inside, ranks[self.levels], _EXCLUDED)
        key = np.full(n + 2 * (WIDTH - 1), _EXCLUDED << 40, np.int64)
        key[WIDTH - 1 : WIDTH - 1 + n] = (rank << 40) + np.arange(n)
        step = 1
        while step < WIDTH:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        key = key[key < (_EXCLUDED << 40)] & ((1 << 40) - 1)
        points = np.bincount(key, minlength=n)
        chosen = np.flatnonzero(points >= POINTS)
        blocks = np.lib.stride_tricks.sliding_window_view(self.raw, WIDTH)[chosen].copy().view(np.uint64)
        h = np.zeros(len(chosen), np.uint64)
        for j in range(WIDTH // 8):
            h = words.mix(h + blocks[:, j])
        return chosen, h


def chains(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """The Bloom filters of each text, one after the other; empty for an empty text."""
    joined = Joined(texts)
    where, hashes = joined.features(ranks)
    bound = np.searchsorted(where, joined.at)
    out = []
    for i, text in enumerate(texts):
        h = hashes[bound[i] : bound[i + 1]]
        if not text:
            out.append(b"")
            continue
        if SHORT_WIDTH <= len(text) < SHORT:
            h = words.mix(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), SHORT_WIDTH).copy().view(np.uint64).ravel())
        elif not len(h):  # no window has a rare entropy: the text is the feature
            h = np.array([int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")], np.uint64)
        _, first = np.unique(h, return_index=True)
        h = h[np.sort(first)]
        bits = np.zeros(-(-len(h) // LOAD) * BITS, np.uint8)
        base = (np.arange(len(h)) // LOAD) * BITS
        for j in range(PROBES):
            bits[base + ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Mean over the shorter chain's filters of the best overlap with the other's, beyond chance; 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if (len(a), a) > (len(b), b):
        a, b = b, a
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).reshape(-1, BITS).astype(np.float32) for v in (a, b))
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    total = 0.0
    for lo in range(0, len(x), 1024):  # blocks of filters keep the memory small for very long texts
        best = np.zeros(min(1024, len(x) - lo), np.float32)
        for at in range(0, len(y), 1024):
            m = nx[lo : lo + 1024, None]
            w = ny[None, at : at + 1024]
            chance = m * w / BITS
            over = (x[lo : lo + 1024] @ y[at : at + 1024].T - chance) / np.maximum(np.minimum(m, w) - chance, 1e-6)
            best = np.maximum(best, over.max(axis=1))
        total += float(np.clip(best, 0, 1).sum())
    return total / len(x)


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of every entropy level, 0 for the rarest in all windows of docs(text); levels below LOWEST are excluded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in words.slices(batch):
                joined = Joined([t or b"" for t in words.texts_of(part)])
                total += np.bincount(joined.levels[joined.inside], minlength=LEVELS + 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["level", "n"])

    seen = np.zeros(LEVELS + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect():
        seen[r["level"]] = r["n"]
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), seen))] = np.arange(LEVELS + 1)
    ranks[:LOWEST] = _EXCLUDED
    return ranks


def fingerprint(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id and fingerprint (base64 of the filters) of every whole text of docs(doc_id, text).

    Equal texts have equal fingerprints under the same ranks; without ranks they
    are learned from the given documents. A null text counts as empty and has an
    empty fingerprint. Repeated rows repeat; other columns are ignored.
    """
    ranks = rarity(docs) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # LEVELS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                made = chains([t or b"" for t in words.texts_of(part)], shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([base64.b64encode(m).decode() for m in made], pa.string())], ["doc_id", "fingerprint"])

    d = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {d}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, k, text) in descending id order, so that each document meets the next one.

    Ids are cut into buckets at quantiles; a bucket's documents come in order,
    then as guest the document that follows its last one (after the very last:
    the first). k is the id, the smallest number for null; equal ids follow in
    descending order of their texts. Only the guests, one id per bucket, are sent
    twice. The driver holds the cuts and one id per bucket.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(C("doc_id").cast("bigint"), F.lit(-(2**63))).alias("k"), C("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in docs.select(C("doc_id").cast("bigint").alias("k")).na.drop().approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.25 / buckets)})
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(len(shared.value) - np.searchsorted(shared.value, k.to_numpy(np.int64), side="right"), dtype=np.int32)

    dealt = keyed.withColumn("bucket", bucket("k"))
    firsts = sorted((r["bucket"], r["k"]) for r in dealt.groupBy("bucket").agg(F.max("k").alias("k")).collect())
    guests = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    visit = F.broadcast(spark.createDataFrame(guests, "guest_k bigint, visits int"))
    places = F.when(C("visits").isNull(), F.array(F.struct("bucket", F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(C("visits").alias("bucket"), F.lit(True).alias("guest"))))
    return dealt.join(visit, C("k") == C("guest_k"), "left").select("doc_id", "k", "text", F.explode(places).alias("at")).select(
        "at.bucket", "at.guest", "k", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "guest", C("k").desc(), C("text").desc())


def edited_pairs(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """Each document beside its edited text and the next document, in descending id order.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many of the next document's. doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ranks = rarity(docs) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def pairs(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (own, doc_id, text), all but the last followed by their next; guests make no row."""
        at = [i for i in range(len(rows) - 1) if rows[i][0]]
        edited = []
        for i in at:
            text, after = rows[i][2], rows[i + 1][2]
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        made = chains([t.encode() for _, _, t in rows] + edited, shared.value)
        own, other = made[: len(rows)], made[len(rows) :]
        code = lambda v: pa.array([base64.b64encode(x).decode() for x in v], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in at], id_type), pa.array([len(rows[i][2]) for i in at], pa.int64()),
             pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), code([own[i] for i in at]), code(other),
             pa.array([likeness(own[i], other[n]) for n, i in enumerate(at)], pa.float64()),
             pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for part in words.slices(batch, size=1_000_000):
                held += list(zip((not g for g in part.column("guest").to_pylist()), part.column("doc_id").to_pylist(), part.column("text").to_pylist()))
                if len(held) > 1:
                    yield pairs(held)
                    held = held[-1:]

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    d = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(d)
    return with_next(docs).select("guest", "doc_id", "text").mapInArrow(
        run, f"doc_id {d.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
