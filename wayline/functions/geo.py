"""Path geometry on arrays of struct(lat, lng), computed inside the row.

A step carries its own path, so decoding, lengths, bearings and camera poses
need neither a join nor a shuffle however many steps there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import paths
from wayline.functions.core import indices, let

POINTS = "array<struct<lat:double,lng:double>>"


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 2.0 * fixed.EARTH_RADIUS_M * F.asin(F.sqrt(h))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def _between(measure, a: Column, b: Column) -> Column:
    return measure(a["lat"], a["lng"], b["lat"], b["lng"])


def _pairs(points: Column, body) -> Column:
    """body(a, b) for every two neighbouring points."""
    return let(
        points,
        lambda p: F.transform(
            indices(F.size(p) - 1), lambda i: body(F.get(p, i), F.get(p, i + 1))
        ),
    )


def segment_lengths(points: Column) -> Column:
    return _pairs(points, lambda a, b: _between(haversine_m, a, b))


def segment_bearings(points: Column) -> Column:
    return _pairs(points, lambda a, b: _between(bearing_deg, a, b))


def cumulative(lengths: Column) -> Column:
    """0 and the running totals: the distance of every vertex from the start."""
    start = F.struct(F.lit(0.0).alias("d"), F.array(F.lit(0.0)).alias("all"))
    return F.aggregate(
        lengths,
        start,
        lambda acc, x: F.struct(
            (acc["d"] + x).alias("d"), F.array_append(acc["all"], acc["d"] + x).alias("all")
        ),
        lambda acc: acc["all"],
    )


def path_length(points: Column) -> Column:
    return F.aggregate(segment_lengths(points), F.lit(0.0), lambda acc, x: acc + x)


# --- encoded paths ----------------------------------------------------------


def decode_polyline(encoded: Column, precision: int = 5) -> Column:
    """Points of an encoded path; no points where the text is malformed.

    A number of more than ``paths.MOST_DIGITS`` digits is no coordinate.  Works
    on batches, so it cannot stand inside a higher-order function.
    """
    return paths.decoder(float(10**precision))(encoded)


def encode_polyline(points: Column, precision: int = 5) -> Column:
    """Encoded path, on batches: not inside a higher-order function."""
    return paths.encoder(float(10**precision))(points)


# --- poses ------------------------------------------------------------------


def _pose(lat: Column, lng: Column, heading: Column) -> Column:
    return F.struct(lat.alias("lat"), lng.alias("lng"), heading.alias("heading"))


def poses_at_remaining(points: Column, step_len: Column, targets: Column) -> Column:
    """array of struct(remaining_m, lat, lng, heading), one per target.

    A target exactly on a vertex belongs to the segment that ends there.  The
    poses of a batch are placed at once: not inside a higher-order function.
    """
    placed = paths.poses(points, step_len.cast("double"), targets.cast("array<double>"))
    return F.zip_with(
        targets, placed,
        lambda rem, q: F.struct(
            rem.alias("remaining_m"), q["lat"].alias("lat"), q["lng"].alias("lng"), q["heading"].alias("heading")
        ),
    )


def pose_at_remaining(points: Column, step_len: Column, remaining: Column) -> Column:
    return F.get(poses_at_remaining(points, step_len, F.array(remaining)), F.lit(0))


def pose_from_points(points: Column, remaining: Column) -> Column:
    """Pose measured along the path itself; null below two points."""
    return F.when(F.size(points) >= 2, pose_at_remaining(points, F.lit(0.0), remaining))


def map_pose(
    points: Column, start_lat: Column, start_lng: Column, end_lat: Column, end_lng: Column,
    fallback_heading: Column,
) -> Column:
    """Car pose on a map: 20 m before the end, the midpoint of a short path."""

    total = paths.length(points)
    near = pose_at_remaining(points, F.lit(0.0), F.when(total < 40.0, total / 2.0).otherwise(F.lit(20.0)))

    def standing(p: Column, lens: Column) -> Column:
        moving = F.get(F.filter(indices(F.size(lens)), lambda i: F.get(lens, i) > 0.05), F.lit(0))
        first = F.get(p, F.lit(0))
        heading = F.coalesce(
            let(moving, lambda i: _between(bearing_deg, F.get(p, i), F.get(p, i + 1))),
            bearing_deg(start_lat, start_lng, end_lat, end_lng),
            fallback_heading.cast("double"),
            F.lit(0.0),
        )
        return _pose(
            F.coalesce(start_lat, first["lat"], F.lit(0.0)), F.coalesce(start_lng, first["lng"], F.lit(0.0)), heading
        )

    fallback = let(points, lambda p: let(segment_lengths(p), lambda lens: standing(p, lens)))
    return F.when(total > 0, _pose(near["lat"], near["lng"], near["heading"])).otherwise(fallback)


def map_pose_40(
    points: Column, step_len: Column, start_lat: Column, start_lng: Column, heading: Column
) -> Column:
    """Car pose of re-rendered maps: 40 m before the end, or half a short step."""
    d = step_len.cast("double")
    back = F.when(d < 80.0, F.least(F.lit(40.0), d / 2.0)).otherwise(F.lit(40.0))
    fallback = _pose(start_lat, start_lng, F.coalesce(heading.cast("double"), F.lit(0.0)))
    near = F.when((d > 0) & (F.size(points) >= 2), pose_from_points(points, back))
    return let(
        near,
        lambda q: F.when(q.isNull(), fallback).otherwise(_pose(q["lat"], q["lng"], q["heading"])),
    )
