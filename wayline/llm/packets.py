"""Many small numbers per document, moved between tasks as one binary row per bucket.

A packet row holds the entries of one bucket from one task: the documents in
order, how many entries each has, and the entries' columns as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

COLUMNS = 4
SCHEMA = "bucket int, ids binary, counts binary, " + ", ".join(f"c{i} binary" for i in range(COLUMNS))
ARROW = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), *((f"c{i}", pa.binary()) for i in range(COLUMNS))])


def buckets_of(values: np.ndarray, n: int) -> np.ndarray:
    """Range of the 64-bit hash space, 0 to n - 1."""
    return (((values >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def spread_ids(ids: np.ndarray, n: int) -> np.ndarray:
    from wayline.llm.words import mix

    return buckets_of(mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), n)


def pack(bucket: np.ndarray, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket; entries of a document keep their order."""
    order = np.lexsort((ids, bucket))
    bucket, ids, columns = bucket[order], ids[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    out: list[list] = [[] for _ in range(3 + COLUMNS)]
    for lo, hi in zip(cut, np.append(cut[1:], len(bucket))):
        d = ids[lo:hi]
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        out[0].append(int(bucket[lo]))
        out[1].append(d[first].astype(np.int64).tobytes())
        out[2].append(np.diff(np.append(first, hi - lo)).astype(np.uint32).tobytes())
        for i in range(COLUMNS):
            out[3 + i].append(columns[i][lo:hi].tobytes() if i < len(columns) else None)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, ARROW)], schema=ARROW)


def unpack(table: pa.Table | pa.RecordBatch, types: Sequence[type]) -> tuple[np.ndarray, ...]:
    """Ids and columns of all entries of some packet rows."""
    def joined(name, dtype):
        return np.concatenate([np.frombuffer(v, dtype) for v in table.column(name).to_pylist() if v is not None] or [np.zeros(0, dtype)])

    ids = np.repeat(joined("ids", np.int64), joined("counts", np.uint32))
    return ids, *(joined(f"c{i}", t) for i, t in enumerate(types))


def per_bucket(packets: DataFrame, types: Sequence[type], fn: Callable[..., Iterator[pa.RecordBatch] | None], schema: str, marked: bool = False) -> DataFrame:
    """Run fn(ids, *columns) on all entries of each bucket; buckets are hash ranges, so they are even.

    With marked, the entries of rows whose last column is set come apart:
    fn((ids, *columns) without, (ids, *columns) with it).
    """

    def run(table: pa.Table) -> pa.Table:
        if marked:
            has = pc.is_valid(table.column(f"c{COLUMNS - 1}"))
            parts = [unpack(table.filter(pc.invert(has)), types), unpack(table.filter(has), types)]
        else:
            parts = unpack(table, types)
        made = [b for b in fn(*parts) if b is not None]
        return pa.Table.from_batches(made) if made else None

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for number in dict.fromkeys(batch.column("bucket").to_pylist()):
                rows = batch.filter(pc.equal(batch.column("bucket"), number))
                if number != at and held:
                    if (made := run(pa.Table.from_batches(held))) is not None:
                        yield from made.to_batches()
                    held = []
                held, at = held + [rows], number
        if held and (made := run(pa.Table.from_batches(held))) is not None:
            yield from made.to_batches()

    return packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(streamed, schema)
