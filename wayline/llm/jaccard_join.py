"""Similarity join of word n-gram sets by vertical partitioning.

N-grams are ordered globally: by fragment of their hash range and, within the
surviving documents, by how many documents have them. Fragments are counted
separately and their counts summed:

1. The first fragments alone tell how many of a document's n-grams occur nowhere
   else. Most documents lose too many there to reach the threshold and are done.
2. Equal sets become one class; only its smallest document goes on.
3. Candidates, first a few per document: the hub of all documents that share a
   minimal n-gram, the one with the most common n-grams. Their overlap is counted
   per fragment and summed per pair. A large group of near copies is joined by
   these links, linear in its size.
4. Candidates, exactly. A document that reached none of its hubs takes the
   closest one, p, as pivot: a partner not smaller than p must share enough
   n-grams with it outside p, else p itself would have reached the threshold.
   Only those are looked up, rarest first; they are few, since a stray copy
   differs from p by what no other copy has. Documents without a pivot meet by
   prefixes of the global order (a pair without a common n-gram there cannot
   reach the threshold). Pairs inside a component need no look: they are
   connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayline.llm import packets, words
from wayline.llm.components import components
from wayline.llm.spread import spread_join
from wayline.llm.workers import released
from wayline.workspace import written

C = F.col
NGRAM = 5
FIRST_SHARE = 0.4
FRAGMENTS = 4
STARS = 4
_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text, A-Z lower-cased; fewer words than n are one n-gram, no words none."""
    w = words.Words(texts, lower=True)
    h = w.hashes()
    grams = words.run_hashes(h, n)
    out = []
    for first, count in zip(w.first[:-1], w.counts):
        if count >= n:
            out.append(np.unique(grams[first : first + count - n + 1]))
        elif count:
            out.append(words.run_hashes(h[first : first + count], count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common n-grams that a set of n can reach the threshold with."""
    return -(-n * percent // 100)


def _flat(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(ids, [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _runs(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)


def shared_counts(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(doc_id, n, t, r): set size, its n-grams in the first fragments, and how many of those may occur elsewhere.

    32 bits of a hash are compared inside each bucket, so r may be a little too
    large, never too small. A slice settles what repeats inside it and sends an
    n-gram once, so a very frequent one costs its bucket one entry per slice.
    """
    limit = np.uint64(int(FIRST_SHARE * 2**64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, size=500_000):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                sets = shingle_sets(words.texts_of(part), n)
                size = np.array([len(s) for s in sets], np.uint32)
                sets = [s[: np.searchsorted(s, limit)] for s in sets]
                t = np.array([len(s) for s in sets], np.uint32)
                yield packets.pack(-1 - packets.spread_ids(ids, buckets), ids, np.zeros(len(ids), np.uint32), size, t)
                owner, gram = _flat(ids, sets)
                order = np.argsort(gram, kind="stable")
                owner, gram = owner[order], gram[order]
                first = _runs(gram)
                count = np.diff(np.append(first, len(gram)))
                twice = np.repeat(count > 1, count)
                d, r = np.unique(owner[twice], return_counts=True)
                if len(d):
                    zero = np.zeros(len(d), np.uint32)
                    yield packets.pack(-1 - packets.spread_ids(d, buckets), d, r.astype(np.uint32), zero, zero)
                g = gram[first]
                within = ((g / np.float64(limit)) * buckets).astype(np.int64).clip(0, buckets - 1)
                mine = np.where(count > 1, np.int64(-1), owner[first])
                yield packets.pack(within, mine, (words.mix(g) & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def repeated(ids, gram):
        order = np.argsort(gram, kind="stable")
        ids, gram = ids[order], gram[order]
        first = _runs(gram)
        count = np.diff(np.append(first, len(gram)))
        again = np.repeat(count > 1, count) & (ids != -1)
        d, r = np.unique(ids[again], return_counts=True)
        if len(d):
            zero = np.zeros(len(d), np.uint32)
            yield packets.pack(-1 - packets.spread_ids(d, buckets), d, r.astype(np.uint32), zero, zero)

    def total(ids, r, size, t):
        order = np.argsort(ids, kind="stable")
        ids, r, size, t = ids[order], r[order].astype(np.int64), size[order], t[order]
        first = _runs(ids)
        if len(first):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first], pa.int64()), pa.array(np.maximum.reduceat(size, first).astype(np.int64)), pa.array(np.maximum.reduceat(t, first).astype(np.int64)),
                 pa.array(np.add.reduceat(r, first))], ["doc_id", "n", "t", "r"])

    found = written(docs.mapInArrow(released(emit), packets.SCHEMA), "fragments")
    more = packets.per_bucket(found.where(C("bucket") >= 0), (np.uint32,), repeated, packets.SCHEMA)
    return packets.per_bucket(found.where(C("bucket") < 0).unionByName(more), (np.uint32,) * 3, total, "doc_id bigint, n bigint, t bigint, r bigint")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, digest, grams): whole sets as sorted 64-bit numbers, with a digest of the set."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, size=500_000):
                raw = [s.tobytes() for s in shingle_sets(words.texts_of(part), n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 8 for x in raw], pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()),
                     pa.array(raw, pa.binary())], ["doc_id", "n", "digest", "grams"])

    return docs.mapInArrow(released(run), "doc_id bigint, n bigint, digest binary, grams binary")


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return batch.column("doc_id").to_numpy(zero_copy_only=False), [np.frombuffer(v, np.uint64) for v in batch.column("grams").to_pylist()]


def ranked(sets: DataFrame, percent: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, weight, grams): the n-grams that also occur in another set, rarest first; and the table of n-grams by bucket.

    weight is the mean logarithm of the document frequencies in the whole set.

    The global order is by document frequency among the given sets, then hash;
    n-grams of one document come first and need not be kept. Documents whose
    other n-grams are too few for any partner are left out.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets_ = _sets(batch)
            owner, gram = _flat(ids, sets_)
            size = np.array([len(s) for s in sets_], np.uint32)
            yield packets.pack(packets.buckets_of(gram, buckets), owner, gram, np.repeat(size, size))
            zero = np.zeros(len(ids), np.uint64)
            yield packets.pack(-1 - packets.spread_ids(ids, buckets), ids, zero, zero.astype(np.uint32), size)

    def frequency(ids, gram, _):
        order = np.argsort(gram, kind="stable")
        ids, gram = ids[order], gram[order]
        first = _runs(gram)
        count = np.diff(np.append(first, len(gram)))
        df = np.repeat(count, count)
        keep = df > 1
        if keep.any():
            ids, gram, df = ids[keep], gram[keep], df[keep].astype(np.uint32)
            yield packets.pack(-1 - packets.spread_ids(ids, buckets), ids, gram, df, np.zeros(len(ids), np.uint32))

    def choose(ids, gram, df, size):
        order = np.lexsort((gram, df, ids))
        ids, gram, df, size = ids[order], gram[order], df[order], size[order]
        first = _runs(ids)
        out: list[tuple] = []
        for lo, hi in zip(first, np.append(first[1:], len(ids))):
            n = int(size[lo:hi].max())
            g = gram[lo:hi][df[lo:hi] > 0]
            if n and len(g) >= int(needed(n, percent)):
                weight = float(np.log2(np.maximum(df[lo:hi], 1)).sum()) / n
                out.append((int(ids[lo]), n, round(weight, 6), g.tobytes()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n", "weight", "grams"), r)) for r in out], schema=pa.schema(
                [("doc_id", pa.int64()), ("n", pa.int64()), ("weight", pa.float64()), ("grams", pa.binary())]))

    found = written(sets.select("doc_id", "grams").mapInArrow(released(emit), packets.SCHEMA), "grams")
    by_gram = found.where(C("bucket") >= 0)
    counted = packets.per_bucket(by_gram, (np.uint64, np.uint32), frequency, packets.SCHEMA)
    out = packets.per_bucket(found.where(C("bucket") < 0).unionByName(counted), (np.uint64, np.uint32, np.uint32), choose, "doc_id bigint, n bigint, weight double, grams binary")
    return written(out, "ranked"), by_gram


def hub_pairs(sets: DataFrame, stars: int) -> DataFrame:
    """(a, b): each document with the weightiest one that has the same minimal n-gram, in `stars` hash orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets_ = _sets(batch)
            keys = [[int(words.mix(s * (_SALT + np.uint64(2 * k))).min().view(np.int64)) for k in range(stars)] for s in sets_]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("weight"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "weight", "keys"])

    keyed = written(sets.select("doc_id", "weight", "grams").mapInArrow(released(run), "doc_id bigint, weight double, keys array<bigint>").select("doc_id", "weight", F.posexplode("keys").alias("k", "key")), "minima")
    hubs = keyed.groupBy("k", "key").agg(F.max(F.struct("weight", (-C("doc_id")).alias("minus"))).alias("hub"), F.count("*").alias("c")).where("c > 1").select("k", "key", (-C("hub.minus")).alias("b"))
    return spread_join(keyed, hubs, ["k", "key"], "inner", C("doc_id")).where("doc_id <> b").select(C("doc_id").alias("a"), "b").distinct()


def cross_pairs(rows: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b), a < b: documents of different components that share a prefix n-gram and are not too different in size.

    rows: doc_id, n, grams (ranked), component.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, comp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "component"))
            sets_ = [np.frombuffer(v, np.uint64) for v in batch.column("grams").to_pylist()]
            sets_ = [s[: len(s) - int(needed(k, percent)) + 1] for s, k in zip(sets_, n)]
            owner, gram = _flat(np.arange(len(ids)), sets_)
            yield packets.pack(packets.buckets_of(gram, buckets), ids[owner], gram, comp[owner], n[owner].astype(np.uint32))

    def meet(ids, gram, comp, n):
        n = n.astype(np.int64)
        order = np.lexsort((comp, gram))
        ids, gram, comp, n = ids[order], gram[order], comp[order], n[order]
        first = _runs(gram)
        a, b, size = [], [], 0
        for lo, hi in zip(first, np.append(first[1:], len(gram))):
            if comp[lo] == comp[hi - 1]:
                continue
            blocks = np.append(lo + _runs(comp[lo:hi]), hi)
            for s, e in zip(blocks[:-2], blocks[1:-1]):
                for i in range(s, e):
                    fits = (100 * n[e:hi] >= percent * n[i]) & (100 * n[i] >= percent * n[e:hi])
                    other = ids[e:hi][fits]
                    a.append(np.full(len(other), ids[i]))
                    b.append(other)
                    size += len(other)
            if size > 1_000_000:
                yield _distinct(a, b)
                a, b, size = [], [], 0
        if size:
            yield _distinct(a, b)

    posted = rows.mapInArrow(released(emit), packets.SCHEMA)
    return packets.per_bucket(posted, (np.uint64, np.int64, np.uint32), meet, "a bigint, b bigint").distinct()


def _distinct(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack([np.concatenate(a), np.concatenate(b)])
    both = np.unique(np.sort(both, axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def probes_of(grams: np.ndarray, pivot: np.ndarray, n: int, n_pivot: int, common: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a document to look up, and the largest partner size that each is needed for.

    Let m be the n-grams that two sets of given sizes must have in common. A
    partner not smaller than the pivot needs m - common of them outside the
    pivot. For a partner smaller by k, leave k common n-grams out of the pivot:
    it still misses the threshold and is not larger than the partner. Of x
    candidates that a partner has g of, any x - g + 1 contain one, so the
    rarest outside come first, then those left out of the pivot.
    """
    at = pivot.searchsorted(grams)
    at[at == len(pivot)] = 0
    inside = pivot[at] == grams if len(pivot) else np.zeros(len(grams), bool)
    out = grams[~inside]
    k = np.arange(max(0, n_pivot - int(needed(np.int64(n), percent))) + 1)
    must = -(-percent * (n + n_pivot - k) // (100 + percent)) - (common - k)
    length = np.maximum.accumulate(np.maximum(0, len(out) + k - must + 1))
    chosen = np.concatenate([out, grams[inside]])[: length[-1]]
    least_k = np.searchsorted(length, np.arange(len(chosen)), side="right")
    return chosen, np.where(least_k == 0, 2**32 - 1, n_pivot - least_k).astype(np.uint32)


def pivot_pairs(pivots: DataFrame, order: DataFrame, sets: DataFrame, by_gram: DataFrame, info: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b), a < b: documents with a pivot and those of other components that share a looked-up n-gram.

    pivots: a, pivot, common (n-grams of both). info: doc_id, component.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "n", "n_pivot", "common", "grams", "pivot_grams")]
            found = [(a, n, *probes_of(np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64), n, m, c, percent)) for a, n, m, c, x, p in zip(*columns)]
            count = [len(f[2]) for f in found]
            owner, size = (np.repeat(np.array([f[i] for f in found], np.int64), count) for i in (0, 1))
            gram, most = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in ((2, np.uint64), (3, np.uint32)))
            yield packets.pack(packets.buckets_of(gram, buckets), owner, gram, most, size.astype(np.uint32), np.zeros(len(gram), np.uint8))

    def look_up(held, asked):
        (ids, gram, n, _), (a, x, most, size) = held, asked
        known, number = np.unique(gram, return_inverse=True)
        key = (number.astype(np.uint64) << np.uint64(32)) + n
        order_ = np.argsort(key, kind="stable")
        ids, key = ids[order_], key[order_]
        at = np.searchsorted(known, x)
        there = np.flatnonzero(at < len(known))
        there = there[known[at[there]] == x[there]]
        a, at, most, size = a[there], at[there].astype(np.uint64) << np.uint64(32), most[there].astype(np.int64), size[there].astype(np.int64)
        low, high = -(-percent * size // 100), np.minimum(most, 100 * size // percent)
        lo = np.searchsorted(key, at + low.astype(np.uint64), "left")
        hi = np.maximum(lo, np.searchsorted(key, at + np.maximum(high, 0).astype(np.uint64), "right"))
        for s in range(0, len(a), 65536):
            c = (hi - lo)[s : s + 65536]
            place = np.repeat(lo[s : s + 65536] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            mine, other = np.repeat(a[s : s + 65536], c), ids[place]
            apart = mine != other
            if apart.any():
                pairs = np.unique(np.stack([mine[apart], other[apart]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    both = pivots.join(order.select(C("doc_id").alias("a"), "n", "grams"), "a").join(
        sets.select(C("doc_id").alias("pivot"), C("n").alias("n_pivot"), C("grams").alias("pivot_grams")), "pivot")
    probes = both.select("a", "n", "n_pivot", "common", "grams", "pivot_grams").mapInArrow(released(ask), packets.SCHEMA)
    found = packets.per_bucket(by_gram.unionByName(probes), (np.uint64, np.uint32, np.uint32), look_up, "a bigint, b bigint", marked=True)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda c: info.select(C("doc_id").alias(c), C("component").alias(f"component_{c}"))
    return found.join(of("a"), "a").join(of("b"), "b").where("component_a <> component_b").select("a", "b")


def overlaps(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """(a, b, size, common) of each pair: n-grams of both sets, and common ones, counted per fragment of the order and summed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([int(2**64 * f / fragments) for f in range(1, fragments)], np.uint64)
        for batch in batches:
            ids, sets_ = _sets(batch)
            rows = []
            for i, s in zip(ids.tolist(), sets_):
                rows += [(i, len(s), f, part.tobytes()) for f, part in enumerate(np.split(s, np.searchsorted(s, edges)))]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "n", "f", "part"), r)) for r in rows], schema=pa.schema(
                [("doc_id", pa.int64()), ("n", pa.int64()), ("f", pa.int32()), ("part", pa.binary())]))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for x, y in zip(batch.column("part_a").to_pylist(), batch.column("part_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = y.searchsorted(x)
                at[at == len(y)] = 0
                common.append(int((y[at] == x).sum()) if len(y) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "size")), pa.array(common, pa.int64())], ["a", "b", "size", "common"])

    parts = sets.select("doc_id", "grams").mapInArrow(released(cut), "doc_id bigint, n bigint, f int, part binary")
    left = parts.select(C("doc_id").alias("a"), C("n").alias("n_a"), "f", C("part").alias("part_a"))
    right = parts.select(C("doc_id").alias("b"), C("n").alias("n_b"), "f", C("part").alias("part_b"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "f"]).select("a", "b", (C("n_a") + C("n_b")).alias("size"), "part_a", "part_b")
    return met.mapInArrow(released(overlap), "a bigint, b bigint, size bigint, common bigint").groupBy("a", "b").agg(F.max("size").alias("size"), F.sum("common").alias("common"))


def similar_groups(docs: DataFrame, n: int = NGRAM, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), one row per document of docs(doc_id, text).

    Documents are linked when 100 * common >= percent * union of their n-gram
    sets; class_id is the smallest document with the same set, component_id the
    smallest reachable over links. A null or blank text has an empty set and
    stands alone. Rows that share an id count as one document and are expected to
    repeat its text; a null id is left out. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.where(C("doc_id").isNotNull()).select(C("doc_id").cast("bigint").alias("doc_id"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the joins below have two sides that grow with the corpus: merge joins at every size
    sizes = written(shared_counts(docs, n, buckets), "counts")
    alive = sizes.where((C("n") > 0) & (100 * (C("n") - C("t") + C("r")) >= percent * C("n"))).select("doc_id")
    sets = written(full_sets(docs.join(alive.hint("merge"), "doc_id", "left_semi"), n), "sets")
    classes = sets.groupBy("n", "digest").agg(F.min("doc_id").alias("class_id"))
    members = written(spread_join(sets.select("doc_id", "n", "digest"), classes, ["n", "digest"], "inner", C("doc_id")).select("doc_id", "class_id").distinct(), "members")
    sets = written(sets.join(members.where("doc_id = class_id").select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "classes")
    order, by_gram = ranked(sets, percent, buckets)
    reached = 100 * C("common") >= percent * (C("size") - C("common"))
    hubs = written(hub_pairs(sets.join(order.select("doc_id", "weight").hint("merge"), "doc_id"), STARS), "hubs")
    counted = written(overlaps(hubs, sets), "hub_overlaps").withColumn("reached", reached)
    stars = counted.where("reached").select("a", "b")
    pivots = counted.groupBy("a").agg(F.max("reached").alias("any"), F.max(F.struct("common", "b")).alias("p")).where("NOT any").select("a", C("p.b").alias("pivot"), "p.common")
    pivots = written(pivots, "pivots")
    info = written(order.select("doc_id").join(components(stars), C("doc_id") == C("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "info")
    others = order.join(pivots, C("doc_id") == C("a"), "left_anti").join(info, "doc_id").select("doc_id", "n", "grams", "component")
    candidates = written(cross_pairs(others, percent, buckets).unionByName(
        pivot_pairs(pivots, order, sets, by_gram, info, percent, buckets)).distinct(), "candidates")
    ends = candidates.select(C("a").alias("doc_id")).unionByName(candidates.select(C("b").alias("doc_id"))).distinct()
    more = overlaps(candidates, sets.join(ends.hint("merge"), "doc_id", "left_semi")).where(reached).select("a", "b")
    final = components(stars.unionByName(more))
    grouped = members.join(final, C("class_id") == C("node"), "left").select(C("doc_id").alias("member"), "class_id", F.coalesce("component", "class_id").alias("component"))
    return sizes.join(grouped, C("doc_id") == C("member"), "left").select(
        "doc_id", C("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = NGRAM, percent: int = 75) -> DataFrame:
    """The smallest document of every group of linked documents, all columns as given."""
    groups = similar_groups(docs, n, percent)
    gone = groups.where("doc_id <> component_id").select(C("doc_id").alias("_id"))
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
