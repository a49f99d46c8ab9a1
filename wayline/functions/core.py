"""Small Column helpers the other function modules share."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Unicode text defines it; plain \s covers ASCII only.
WHITE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain reference inside a higher-order function would be evaluated again
    for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(col, f"^{WHITE}+|{WHITE}+$", "")


def present(col: Column) -> Column:
    """The value, or null where it is null or an empty string."""
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def whole(col: Column) -> Column:
    """Round half to even and return a whole number."""
    return F.rint(col.cast("double")).cast("bigint")


def indices(n: Column) -> Column:
    """0, 1, ... n-1; empty for n <= 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def rows_of(df: DataFrame, keep: list, array: str, at: str = "_i", item: str = "_item") -> DataFrame:
    """One row per element of an array column, with its place.

    An inner explode of a column makes the optimizer filter on the size of the
    array below the projection that computes it, so a derived array would be
    computed twice.  The outer form with a null check computes it once.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())


def one_decimal(x: Column) -> Column:
    """Text with one decimal, rounding the exact binary value half to even.

    Valid for 0 <= x < 16: x * 2**52 is then a whole number that fits a long.
    """
    tenths = (x * F.lit(float(1 << 52))).cast("bigint") * F.lit(10).cast("bigint")
    q = F.shiftright(tenths, 52)
    rest = tenths.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & (q % 2 == 1))
    q = q + up.cast("bigint")
    return F.concat(F.floor(q / 10).cast("string"), F.lit("."), (q % 10).cast("string"))
