"""Point tables, road lookup by distance and path texts from point rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline import fixed
from wayline.functions import geo, paths
from wayline.functions.core import lookup, rows_of
from wayline.operators.ordered import WIDTH


def points_of(paths: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """One row per path point."""
    return rows_of(paths, keys, points, "pt_idx", "p").select(*keys, "pt_idx", "p.lat", "p.lng")


def polyline_to_points(steps: DataFrame, keys: list[str], encoded: str, precision: int = 5) -> DataFrame:
    decoded = steps.withColumn("_pts", geo.decode_polyline(F.col(encoded), precision))
    return points_of(decoded, keys, "_pts")


def segments_of(
    paths: DataFrame, keys: list[str], points: str = "points", measures: tuple[str, ...] = ("metres", "bearing", "cum_end")
) -> DataFrame:
    """One row per segment with the measures asked for: length, bearing, distance of its end from the start."""
    path = F.col(points)
    made = {
        "metres": geo.segment_lengths(path), "bearing": geo.segment_bearings(path),
        "cum_end": F.slice(geo.cumulative(geo.segment_lengths(path)), 2, F.greatest(F.size(path) - 1, F.lit(0))),
    }
    own = paths.withColumns({f"_{n}": made[n] for n in measures})
    zipped = own.withColumn("_s", F.arrays_zip(*[F.col(f"_{n}").alias(n) for n in measures]))
    return rows_of(zipped, keys, "_s", "seg_idx", "s").select(*keys, "seg_idx", *[f"s.{n}" for n in measures])


def route_bounds(paths: DataFrame, route: str = "route_id", points: str = "points") -> DataFrame:
    """Corners per route; every row is reduced to its own corners before the shuffle."""
    axis = lambda name: F.transform(points, lambda p: p[name])
    boxed = paths.select(
        route,
        F.array_min(axis("lat")).alias("lat0"), F.array_max(axis("lat")).alias("lat1"),
        F.array_min(axis("lng")).alias("lng0"), F.array_max(axis("lng")).alias("lng1"),
    )
    return boxed.groupBy(route).agg(
        F.min("lat0").alias("min_lat"), F.max("lat1").alias("max_lat"),
        F.min("lng0").alias("min_lng"), F.max("lng1").alias("max_lng"),
    )


def points_to_polyline(
    points: DataFrame, keys: list[str], order: str = "pt_idx", precision: int = 5, width: int = WIDTH
) -> DataFrame:
    """Encoded path per key from point rows; points without coordinates are left out.

    Rows that lie next to one another become pieces of text where they are, at most a block of ``width`` places
    each; only pieces are gathered by key, and joined in order as they stream by.
    """
    rows = points.select(*keys, order, F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    own = [rows.schema[k] for k in keys]
    number = [T.StructField(n, T.LongType()) for n in ("_at", *paths.CELLS)]
    text = lambda name: T.StructField(name, T.StringType())
    cut = rows.mapInArrow(paths.pieces(keys, order, float(10**precision), width), T.StructType([*own, *number, text("_t")]))
    placed = cut.repartition(*keys).sortWithinPartitions(*keys, "_at")
    return placed.mapInArrow(paths.linked(keys, "encoded"), T.StructType([*own, text("encoded")]))


# --- roads near a point -------------------------------------------------------

METRES_PER_DEGREE = 111_194.92  # earth radius times one degree


CELL_IN_RADII = 3.0  # a point then meets 1 to 4 cells, under three on average


def _grid(radius_m: float):
    """Cells of roads and the cells a search around a point must visit.

    Rows are latitude bands; every band has its own number of columns, which
    wrap around the earth.  A cell is at least three radii high and wide.
    """
    reach = max(radius_m, 1.0) / METRES_PER_DEGREE * 1.0001
    step = reach * CELL_IN_RADII
    row = lambda lat: F.floor(lat / step)

    def edge(r: Column) -> Column:
        """Latitude of the band edge far from the equator, one band further out."""
        return F.greatest(F.abs(r - 1), F.abs(r + 2)) * step

    def count(r: Column) -> Column:
        across = F.floor(360.0 * F.cos(F.radians(edge(r))) / step)
        return F.when(edge(r) < 89.9, F.greatest(across, F.lit(1))).otherwise(F.lit(1))

    def column(lng: Column, r: Column) -> Column:
        """Column number, not yet wrapped."""
        return F.floor((lng + 180.0) / 360.0 * count(r))

    def rows_around(lat: Column) -> Column:
        return F.sequence(row(lat - reach), row(lat + reach))

    def columns_around(lng: Column, r: Column) -> Column:
        wide = reach / F.cos(F.radians(F.least(edge(r), F.lit(89.9))))
        span = F.sequence(column(lng - wide, r), column(lng + wide, r))
        return F.array_distinct(F.transform(span, lambda c: F.pmod(c, count(r))))

    return row, column, count, rows_around, columns_around


def roads_near(
    points: DataFrame, roads: DataFrame, radius_m: float = 20.0, salts: int = 4
) -> DataFrame:
    """For each distinct point (5 decimals) the best road within the radius.

    Highest road class wins, the first road on ties; when no class is ranked
    the first road is taken.  Points are rounded and made distinct first, so a
    crowded place asks once.  Roads are salted, and the few points of a cell are
    copied to every salt; the best road is an aggregate, never a collected group.
    """
    asked = points.select(
        F.bround("lat", 5).alias("lat"), F.bround("lng", 5).alias("lng")
    ).where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).distinct()
    row, column, count, rows_around, columns_around = _grid(radius_m)
    p = asked.withColumn("_r", F.explode(rows_around(F.col("lat"))))
    p = p.withColumn("_c", F.explode(columns_around(F.col("lng"), F.col("_r"))))
    p = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    r = roads.withColumn("_row", row(F.col("lat"))).withColumns(
        {
            "_c": F.pmod(column(F.col("lng"), F.col("_row")), count(F.col("_row"))),
            "_salt": F.pmod(F.xxhash64("road_id"), F.lit(salts)).cast("int"),
        }
    )
    r = r.select(
        F.col("_row").alias("_r"), "_c", "_salt", F.col("lat").alias("rlat"), F.col("lng").alias("rlng"),
        "road_id", "highway",
        F.struct(*[c for c in roads.columns if c not in ("lat", "lng")]).alias("road"),
    )
    near = p.join(r, ["_r", "_c", "_salt"]).where(
        geo.haversine_m(F.col("lat"), F.col("lng"), F.col("rlat"), F.col("rlng")) <= radius_m
    )
    rank = F.struct(
        F.coalesce(lookup(fixed.ROAD_CLASS_PRIORITY, F.col("highway")), F.lit(-1)).alias("rank"),
        (-F.col("road_id")).alias("first"),
    )
    return near.groupBy("lat", "lng").agg(F.max_by("road", rank).alias("road"))


def road_info(road: Column) -> Column:
    """Road attributes as they are stored with a step; flags hold where the tag says yes."""
    tag = lambda n: road[n].alias(n)
    yes = lambda n: F.coalesce(road[n] == "yes", F.lit(False)).alias(n)
    return F.struct(
        tag("highway"), tag("name"), tag("ref"), tag("maxspeed"), road["lanes"].try_cast("int").alias("lanes"), tag("surface"),
        yes("oneway"), yes("lit"), tag("sidewalk"), tag("cycleway"), yes("bridge"), yes("tunnel"), yes("toll"),
    )


def attach_roads(points: DataFrame, roads: DataFrame, radius_m: float = 20.0, asked: DataFrame | None = None) -> DataFrame:
    """Every point row with the road of its rounded place (null without one); ``asked`` are rows with the places of all points."""
    found = roads_near(points if asked is None else asked, roads, radius_m)
    keyed = points.withColumns({"_la": F.bround("lat", 5), "_ln": F.bround("lng", 5)})
    found = found.withColumnsRenamed({"lat": "_la", "lng": "_ln"})
    return keyed.join(found, ["_la", "_ln"], "left").drop("_la", "_ln")
