"""Sample rows put together from steps, paths, frames, roads and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.functions import normalize as N
from wayline.operators import frames, geometry, routes
from wayline.operators.ordered import cut, uncut

VERSION, SPLIT = "v1.0", "train"


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def nested_rows(steps: DataFrame, source: str, created_at: Column, instruction: str = "instruction", frame_paths: Column | None = None) -> DataFrame:
    """The stored form of a sample from a step with all its parts as columns.

    Expects route_id, step_index, maneuver, distance_m, remaining_distance_m and
    the instruction; polyline, start and end, heading, osm_road, map_filename and
    frames (with filename) where they are known, else those fields are null.
    """
    double = lambda n: _or_null(steps, n, "double").alias(n)
    paths = frame_paths if frame_paths is not None else F.transform(
        F.coalesce("frames", F.array()), lambda f: F.concat(F.lit("frames/"), f["filename"])
    )
    overhead = F.concat(F.lit("maps/"), _or_null(steps, "map_filename", "string"))
    return steps.select(
        N.sample_id(F.col("route_id"), F.col("step_index")).alias("id"), "route_id", "step_index",
        F.lit(VERSION).alias("dataset_version"), F.lit(SPLIT).alias("split"), "maneuver",
        F.struct(F.col(instruction).alias("instruction")).alias("prior"),
        F.struct(overhead.alias("overhead"), paths.alias("frames")).alias("images"),
        F.struct(
            _or_null(steps, "polyline", "string").alias("step_polyline"),
            *[double(n) for n in ("start_lat", "start_lng", "end_lat", "end_lng", "heading")],
        ).alias("geometry"),
        F.struct(F.coalesce("distance_m", F.lit(0)).alias("step_distance_m"), "remaining_distance_m").alias("distances"),
        _or_null(steps, "osm_road", "map<string,string>").alias("osm_road"),
        F.struct(F.lit(source).alias("source"), created_at.alias("created_at")).alias("metadata"),
    )


ROAD_FIELDS = ["highway", "ref", "maxspeed", "lanes", "surface", "oneway", "lit", "bridge", "tunnel", "toll"]


def build_samples(
    steps: DataFrame, roads: DataFrame, created_at: Column, profile: str = "sparse4", radius_m: float = 20.0,
    whole: Callable[[DataFrame], DataFrame] | None = None, places: DataFrame | None = None,
) -> DataFrame:
    """One nested sample row per step of the routes.

    steps: route_id, step_index, instruction, maneuver, distance_m, points (the
    path), start_lat, start_lng, end_lat, end_lng, heading and frames (stored
    ones, or null). The instruction is that of the next step, distances are summed
    to the end of the route, frames are those of the profile and their first one
    gives the heading (null without frames), and the road is the best one within
    radius_m of the start: by distance, so a step far from any road has only the
    name its instruction gives. One order of the route serves instruction and
    distances; the road is one join by rounded place.

    Rows move for the order and for the road. ``whole`` gives rows the columns of a
    step that can be made in the row, after they have moved; before, only route_id,
    step_index, instruction, distance_m, start_lat and start_lng are asked for.
    ``places`` are rows with the starts of all steps, where those are read with less
    work than the steps.
    """
    ordered = uncut(routes.remaining_distance(routes.next_step_text(cut(steps, ["route_id"], "step_index"))))
    at = {"lat": F.col("start_lat"), "lng": F.col("start_lng")}
    asked = None if places is None else places.withColumns(at)
    near = geometry.attach_roads(ordered.withColumns(at), roads, radius_m, asked)
    framed = frames.resolve_step_frames(near if whole is None else whole(near), profile)
    # the only row of an array: made once, where a plain column would be made again in each field that uses it
    parts = F.struct(
        F.transform("resolved", lambda f: F.concat(F.lit("frames/"), f["filename"])).alias("_paths"),
        F.get("resolved", F.lit(0))["heading"].alias("heading"), N.street_names(F.coalesce("instruction", F.lit(""))).alias("_streets"),
    )
    info = framed.withColumn("_road", F.when(F.col("road").isNotNull(), geometry.road_info(F.col("road"))))
    info = info.drop("heading").select("*", F.inline(F.array(parts)))
    filled = info.withColumns({
        "osm_road": F.struct(
            *[F.col(f"_road.{n}").alias(n) for n in ROAD_FIELDS],
            N.road_name(F.col("_road.name"), F.col("_streets"), F.col("instruction")).alias("name"), F.col("_streets").alias("street_names"),
        ),
        "polyline": geo.encode_polyline(F.col("points")),
    })
    return nested_rows(filled, "google", created_at, "effective_instruction", F.col("_paths"))
