"""Prefix sums and sorted search inside array columns, linear in the elements.

Native folds copy the array they build at every element. These three work on
whole Arrow batches: the elements of all rows lie in one buffer, and numpy runs
over the part of each row. A row of thousands of points costs as much per point
as a short one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parts(lists: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of all rows, and where each row starts and ends; rows that are null are empty."""
    values = lists.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    offsets = lists.offsets.to_numpy()
    ends = np.where(lists.is_null().to_numpy(zero_copy_only=False), offsets[:-1], offsets[1:])
    return values, offsets[:-1], ends


def _listed(sizes: np.ndarray, values: np.ndarray, type_: pa.DataType, nulls: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type_, from_pandas=True), mask=pa.array(nulls) if nulls.any() else None)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def cumulative(lengths: pa.Array) -> pa.Array:
    """0 and the running totals, summed from left to right; null for null."""
    values, starts, ends = _parts(lengths, np.float64)
    nulls = lengths.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(nulls, 0, ends - starts + 1)
    out, at = np.zeros(sizes.sum()), 0
    for start, end, size in zip(starts.tolist(), ends.tolist(), sizes.tolist()):
        if size > 1:
            np.cumsum(values[start:end], out=out[at + 1 : at + size])
        at += size
    return _listed(sizes, out, pa.float64(), nulls)


@F.arrow_udf(T.ArrayType(T.LongType()))
def pair_totals(deltas: pa.Array) -> pa.Array:
    """Running totals of the elements at even places and, apart from them, at odd places; the number of elements must be even."""
    values, starts, ends = _parts(deltas, np.int64)
    nulls = deltas.is_null().to_numpy(zero_copy_only=False)
    sizes = ends - starts
    out, at = np.zeros(sizes.sum(), np.int64), 0
    for start, end, size in zip(starts.tolist(), ends.tolist(), sizes.tolist()):
        if size:
            out[at : at + size] = np.cumsum(values[start:end].reshape(-1, 2), axis=0).ravel()
        at += size
    return _listed(sizes, out, pa.int64(), nulls)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def reaching(totals: pa.Array, wanted: pa.Array) -> pa.Array:
    """For each wanted value the first segment whose end reaches it, else the last; totals are those of `cumulative`.

    Two ascending halves of an interval merge, as one binary search per value.
    Null where either is null; without a segment the place is -1.
    """
    sums, starts, ends = _parts(totals, np.float64)
    values, first, last = _parts(wanted, np.float64)
    nulls = totals.is_null().to_numpy(zero_copy_only=False) | wanted.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(nulls, 0, last - first)
    out, at = np.zeros(sizes.sum(), np.int32), 0
    for a, b, c, d, size in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), sizes.tolist()):
        if size:
            out[at : at + size] = np.minimum(np.searchsorted(sums[a + 1 : b], values[c:d], side="left"), b - a - 2)
        at += size
    return _listed(sizes, out, pa.int32(), nulls)
