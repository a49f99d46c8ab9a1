"""Ordered work that survives a hot key and a table of any size.

A window over ``partitionBy(route)`` puts a whole route into one task.  Here a
key is cut into blocks of its order column, every block is worked on alone, and
only one summary row per block is ordered over the whole key.  Tables without
any key are range-partitioned instead; only one row per partition is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayline.workspace import durable

WIDTH = 4096
_HIDDEN = "_cut_"
# stands for a null key, so that joins and windows can use plain equality
NO_KEY = {"string": "\u0000", "int": -(1 << 31), "bigint": -(1 << 63)}


def _names(keys: list[str], order: str, width: int) -> list[str]:
    tag = f"{_HIDDEN}{'_'.join(keys)}_{order}_{width}_"
    return [f"{tag}{k}" for k in keys] + [f"{tag}block"]


def cut(df: DataFrame, keys: list[str], order: str, width: int = WIDTH, whole: bool = False) -> DataFrame:
    """Add the hidden block columns once, for several ordered steps in a row.

    Steps that find them neither add nor drop them and share one shuffle; take
    them off with ``uncut``.  ``whole`` is for rows that already lie in one task
    per key: each key is one block, so nothing is summed up over blocks.
    """
    names = _names(keys, order, width)
    if names[-1] in df.columns:
        return df
    types = dict(df.dtypes)
    safe = {n: F.coalesce(k, F.lit(NO_KEY[types[k]]).cast(types[k])) for n, k in zip(names, keys)}
    # block 0 is the first one: no row lies before it
    first = F.lit(0).cast("bigint")
    block = first if whole else F.when(F.col(order).isNotNull(), F.greatest(F.floor(F.col(order) / F.lit(width)), first))
    return df.withColumns(safe | {names[-1]: block})


def uncut(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_HIDDEN)])


def _attach(df: DataFrame, summary: DataFrame, on: list[str], was_cut: bool) -> DataFrame:
    """Left join of one summary row per block; the rows stay where they are."""
    renamed = summary.withColumnsRenamed({k: f"_s{k}" for k in on})
    cond = None
    for k in on:
        part = df[k] == renamed[f"_s{k}"]
        cond = part if cond is None else cond & part
    out = df.join(renamed, cond, "left").drop(*[f"_s{k}" for k in on])
    return out if was_cut else out.drop(*on)


def running_sums(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], *,
    reverse: bool = False, inclusive: bool = True, width: int = WIDTH,
) -> DataFrame:
    """Running sum per key over a unique whole-number order column.

    ``reverse`` sums from this row to the end.  Null values count as zero.  The
    rows are shuffled once; the block totals come from a second, narrow read.
    In reverse the first block is behind no other one, so only rows of later
    blocks are summed up: none, where no key has more than one.
    """
    on = _names(keys, order, width)
    was_cut = on[-1] in df.columns
    base = cut(df, keys, order, width).withColumns(
        {f"_v_{name}": value for name, value in values.items()}
    )
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    inside = (
        W.partitionBy(*on).orderBy(direction(order))
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    by_block = W.partitionBy(*on[:-1]).orderBy(direction(on[-1]))
    summed = lambda rows: rows.groupBy(*on).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    offsets = lambda last: {f"_o_{n}": F.sum(f"_t_{n}").over(by_block.rowsBetween(W.unboundedPreceding, last)) for n in values}
    if reverse:
        # a block and all behind it are the offset of the block before it, which may be the first
        totals = summed(base.where(F.col(on[-1]) > 0)).withColumns(
            offsets(0) | {"_to": F.coalesce(F.lead(on[-1]).over(by_block), F.lit(0).cast("bigint"))}
        ).select(*on[:-1], F.col("_to").alias(on[-1]), *[f"_o_{n}" for n in values])
    else:
        totals = (
            summed(base).withColumns(offsets(-1))
            # the first block of a key needs no offset: usually nothing is left to join
            .where(F.coalesce(*[F.col(f"_o_{n}") for n in values]).isNotNull())
            .select(*on, *[f"_o_{n}" for n in values])
        )
    local = base.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in values})
    joined = _attach(local, totals, on, was_cut)
    zero = F.lit(0)
    return joined.withColumns(
        {n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_o_{n}"), zero) for n in values}
    ).drop(*[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def numbered(
    df: DataFrame, keys: list[str], order: str, out: str, *, width: int = WIDTH
) -> DataFrame:
    """1, 2, ... per key in the order of a unique whole-number column."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("bigint")}, width=width)


def with_neighbour(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], *,
    step: int = 1, width: int = WIDTH,
) -> DataFrame:
    """Values of the next (step=1) or previous (step=-1) row of the same key."""
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    on = _names(keys, order, width)
    was_cut = on[-1] in df.columns
    packed = F.struct(F.col(order).alias("_at"), *[v.alias(n) for n, v in values.items()])
    base = cut(df, keys, order, width).withColumn("_own", packed)
    shift = F.lead if step == 1 else F.lag
    edge = F.min if step == 1 else F.max  # structs compare by _at first
    by_block = W.partitionBy(*on[:-1]).orderBy(on[-1])
    edged = lambda rows: rows.groupBy(*on).agg(edge("_own").alias("_edge"))
    if step == 1:
        # only later blocks have a row that is the next one of another block
        edges = edged(base.where(F.col(on[-1]) > 0)).select(
            *on[:-1], F.coalesce(F.lag(on[-1]).over(by_block), F.lit(0).cast("bigint")).alias(on[-1]), F.col("_edge").alias("_beyond")
        )
    else:
        edges = (
            edged(base).withColumn("_beyond", shift("_edge").over(by_block))
            .where(F.col("_beyond").isNotNull())
            .select(*on, "_beyond")
        )
    inside = W.partitionBy(*on).orderBy(order)
    local = base.withColumn("_near", shift("_own").over(inside))
    joined = _attach(local, edges, on, was_cut)
    other = F.coalesce("_near", "_beyond")
    return joined.withColumns({n: other[n] for n in values}).drop("_own", "_near", "_beyond")


def _range_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in global order with _pid (partition) and _pos (place inside it).

    The result is checkpointed: partition bounds come from a sample, so a
    second evaluation could cut elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = durable(cut.withColumn("_mid", F.monotonically_increasing_id()))
    return kept.select(
        *df.columns,
        F.shiftright("_mid", 33).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def _partition_offsets(sorted_df: DataFrame, value: Column) -> DataFrame:
    """One row per range partition, so ordering them is a bounded job."""
    before = W.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    totals = sorted_df.groupBy("_pid").agg(F.sum(value).alias("_total"))
    return totals.select(
        "_pid", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )


def dense_ordinal(df: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """Number all rows 1..n by columns that identify a row, without one big sort task."""
    placed = _range_sorted(df, order)
    offsets = _partition_offsets(placed, F.lit(1).cast("bigint"))
    # at most one row per shuffle partition: the broadcast has a fixed bound
    return placed.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.col("_offset") + F.col("_pos") + 1).alias(out)
    )


def total_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller (unique) order value."""
    placed = _range_sorted(df, [order])
    offsets = _partition_offsets(placed, F.col(value))
    inside = W.partitionBy("_pid").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.col("_offset") + F.col("_local")).alias(out)
    )


def with_both_neighbours(
    df: DataFrame, order: list[str], value: str, before: str, after: str
) -> DataFrame:
    """Values of the rows before and after, in the order of the whole table."""
    placed = _range_sorted(df, order)
    inside = W.partitionBy("_pid").orderBy("_pos")
    by_part = W.partitionBy(F.lit(0)).orderBy("_pid")
    edges = placed.groupBy("_pid").agg(
        F.min_by(value, "_pos").alias("_first"), F.max_by(value, "_pos").alias("_last")
    ).select(
        "_pid", F.lag("_last").over(by_part).alias("_left"), F.lead("_first").over(by_part).alias("_right")
    )
    local = placed.withColumns(
        {"_near_left": F.lag(value).over(inside), "_near_right": F.lead(value).over(inside)}
    )
    # one row per range partition: bounded
    return local.join(F.broadcast(edges), "_pid").select(
        *df.columns, F.coalesce("_near_left", "_left").alias(before),
        F.coalesce("_near_right", "_right").alias(after),
    )


def first_by(df: DataFrame, keys: list[str], order: Column, *, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    An aggregate, not a window: a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def first_rows(df: DataFrame, keys: list[str], order: str, *, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by a whole-number column that is unique within a key.

    Only keys and order are aggregated, in a hash map; the wide rows then meet
    the chosen ones in a semi-join and are never sorted or folded.  A hot key is
    one chosen row.  Rows without an order drop out; null keys are one key.
    """
    pick = F.max if last else F.min
    best = df.groupBy(*keys).agg(pick(order).alias("_at")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.col(order) == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(best, same, "left_semi")
