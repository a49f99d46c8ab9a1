"""Steps of routes: normalised steps, next-step text, remaining distance, ETA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import geo
from wayline.functions import normalize as N
from wayline.functions.core import present, rows_of
from wayline.operators.ordered import numbered, running_sums, with_neighbour


def fill_step_defaults(steps: DataFrame) -> DataFrame:
    """Give every step a path, an instruction (type 8) and locations."""
    nowhere = F.struct(
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude")
    )
    defaults = {
        "polyline": F.struct(F.lit("").alias("encodedPolyline")),
        "navigationInstruction": F.struct(F.lit("").alias("instruction"), F.lit(8).alias("type")),
        "startLocation": nowhere,
        "endLocation": nowhere,
    }
    have = {n: F.coalesce(F.col(n), d) for n, d in defaults.items() if n in steps.columns}
    return steps.withColumns(have)


def explode_directions(directions: DataFrame) -> DataFrame:
    """Stored directions (routes -> legs -> steps) to one row per step.

    Steps of all legs keep their leg and their place in it.
    """
    legs = directions.select(
        "route_id", F.posexplode(F.col("routes")[0]["legs"]).alias("leg_index", "leg")
    )
    steps = legs.select("route_id", "leg_index", F.posexplode("leg.steps").alias("step_index", "s"))
    return steps.select(
        "route_id", "leg_index", "step_index",
        F.coalesce("s.html_instructions", F.lit("")).alias("html_instructions"),
        F.coalesce("s.maneuver", F.lit("")).alias("maneuver"),
        F.coalesce("s.distance.value", F.lit(0)).alias("distance_m"),
        F.coalesce("s.duration.value", F.lit(0)).alias("duration_s"),
        F.coalesce("s.polyline.points", F.lit("")).alias("encoded"),
        F.col("s.start_location.lat").alias("start_lat"), F.col("s.start_location.lng").alias("start_lng"),
        F.col("s.end_location.lat").alias("end_lat"), F.col("s.end_location.lng").alias("end_lng"),
    )


def normalise_steps(steps: DataFrame) -> DataFrame:
    """Clean columns of a step row; nothing leaves the row, so nothing shuffles."""
    instruction = N.strip_html(F.col("html_instructions"))
    out = steps.withColumn("instruction", instruction).withColumn(
        "points", geo.decode_polyline(F.col("encoded"))
    )
    # only the first and the last segment are asked for
    bearing = lambda a, b: F.coalesce(F.floor(geo.bearing_deg(a["lat"], a["lng"], b["lat"], b["lng"])).cast("int"), F.lit(0))
    at = lambda i: F.try_element_at("points", F.lit(i))
    return out.withColumns(
        {
            "street_names": N.street_names(F.col("instruction")),
            "maneuver_code": N.maneuver_code(F.coalesce("maneuver", F.lit(""))),
            "highway": N.highway_flag(F.col("instruction"), F.col("maneuver")),
            "static_duration": F.concat(F.col("duration_s").cast("string"), F.lit("s")),
            "length_km": F.col("distance_m") / 1000.0,
            "continue_text": N.continue_text(F.col("distance_m")),
            "bearing_after": bearing(at(1), at(2)),
            "bearing_before": bearing(at(-2), at(-1)),
        }
    )


def route_totals(steps: DataFrame) -> DataFrame:
    """Distance, duration, step and frame counts and text flags per route."""
    text = F.lower("instruction")
    has = lambda word: F.bool_or(F.coalesce(F.contains(text, F.lit(word)), F.lit(False)))
    highway = N.highway_flag(F.col("instruction"), F.col("maneuver_raw"))
    return steps.groupBy("route_id").agg(
        F.sum("distance_m").alias("total_distance_m"),
        F.sum("duration_s").alias("total_duration_s"),
        F.count("*").alias("steps_count"),
        F.sum("n_frames").cast("bigint").alias("frames_count"),
        F.bool_or(F.coalesce(highway, F.lit(False))).alias("has_highway"),
        has("toll").alias("has_toll"),
        has("ferry").alias("has_ferry"),
    )


def next_step_text(steps: DataFrame, keys=("route_id",), order: str = "step_index") -> DataFrame:
    """Effective instruction: what the driver does at the end of the step."""
    own = F.coalesce("instruction", F.lit(""))
    near = with_neighbour(
        steps, list(keys), order, {"next_instruction": own, "_more": F.lit(True)}
    )
    last = F.col("_more").isNull()
    return near.withColumns(
        {
            "effective_instruction": F.when(
                last, F.coalesce(present(own), F.lit("Arrive at destination"))
            ).otherwise(F.coalesce(present(F.col("next_instruction")), own)),
            "instruction_policy": F.when(last, "arrival").otherwise("n_plus_one"),
        }
    ).drop("_more")


def remaining(steps: DataFrame) -> DataFrame:
    """Metres and seconds from the start of each step to the end of its route.

    Seconds are null where no step from here on has a duration.
    """
    out = running_sums(
        steps, ["route_id"], "step_index",
        {
            "remaining_distance_m": F.col("distance_m").cast("bigint"),
            "_seconds": F.col("duration_s").cast("bigint"),
            "_timed": (F.col("duration_s") > 0).cast("bigint"),
        },
        reverse=True,
    )
    return out.withColumn(
        "remaining_duration_s", F.when(F.col("_timed") > 0, F.col("_seconds"))
    ).drop("_seconds", "_timed")


def remaining_distance(steps: DataFrame) -> DataFrame:
    return running_sums(
        steps, ["route_id"], "step_index",
        {"remaining_distance_m": F.col("distance_m").cast("bigint")}, reverse=True,
    )


def eta(remaining_m: Column, total_m: Column, total_s: Column) -> dict[str, Column]:
    """Seconds, minutes and km to go, by route speed or 40 km/h without one."""
    r = remaining_m.cast("double")
    timed = (total_m > 0) & (total_s > 0)
    seconds = F.when(timed, total_s.cast("double") * (r / F.nullif(total_m, F.lit(0)).cast("double"))).otherwise(
        r / 1000.0 / fixed.FALLBACK_SPEED_KMH * 3600.0
    )
    ok = r >= 0
    return {
        "remaining_s": F.when(ok, seconds),
        "minutes_remaining": F.when(ok, seconds / 60.0),
        "distance_km": F.when(ok, r / 1000.0),
    }


def arrival_text(as_of: Column, seconds: Column) -> Column:
    """Clock time of arrival, 12 hours, without the leading zero."""
    at = F.timestamp_micros(F.unix_micros(as_of) + F.floor(seconds * 1000000).cast("bigint"))
    return F.ltrim(F.date_format(at, "hh:mm"), F.lit("0"))


def eta_table(steps: DataFrame, totals: DataFrame, as_of: Column) -> DataFrame:
    """ETA of every step; totals is one row per route."""
    rest = remaining_distance(steps)
    out = rest.join(totals.select("route_id", "total_distance_m", "total_duration_s"), "route_id", "left")
    out = out.withColumns(
        eta(F.col("remaining_distance_m"), F.col("total_distance_m"), F.col("total_duration_s"))
    )
    return out.withColumn("arrival", arrival_text(as_of, F.col("remaining_s")))


def eta_in_step(steps: DataFrame, into_m: Column) -> DataFrame:
    """ETA with the metres already driven in the step taken off."""
    out = running_sums(
        steps.withColumn("_into", into_m), ["route_id"], "step_index",
        {
            "_later_m": F.col("distance_m").cast("bigint"),
            "_later_s": F.col("duration_s").cast("bigint"),
            "_timed": (F.col("duration_s") > 0).cast("bigint"),
        },
        reverse=True, inclusive=False,
    )
    d, own_s = F.col("distance_m").cast("double"), F.coalesce("duration_s", F.lit(0))
    metres = F.greatest(F.lit(0.0), d - F.col("_into")) + F.col("_later_m")
    done = F.when(d > 0, F.col("_into") / F.nullif(d, F.lit(0.0))).otherwise(F.lit(0.0))
    by_time = own_s * (1.0 - done) + F.when(F.col("_timed") > 0, F.col("_later_s")).otherwise(F.lit(0))
    known = (F.col("_timed") > 0) | (own_s > 0)
    seconds = F.when(known, by_time).otherwise(metres / 1000.0 / fixed.FALLBACK_SPEED_KMH * 3600.0)
    return out.withColumns(
        {"remaining_m": metres, "minutes_remaining": seconds / 60.0}
    ).drop("_into", "_later_m", "_later_s", "_timed")


def shape_index(paths: DataFrame, n_points: Column) -> DataFrame:
    """Vertex numbers of each step on the whole route; neighbours share a vertex."""
    grown = F.greatest(n_points - 1, F.lit(0)).cast("bigint")
    out = running_sums(
        paths.withColumn("_grown", grown), ["route_id"], "step_index", {"end_shape_index": F.col("_grown")}
    )
    return out.withColumn("begin_shape_index", F.col("end_shape_index") - F.col("_grown")).drop("_grown")


def step_places(samples: DataFrame, route: str = "route_id", order: str = "step_index") -> DataFrame:
    """Place k of n of every step on its route; a missing index counts as 0."""
    ordered = samples.withColumn(order, F.coalesce(F.col(order), F.lit(0)))
    totals = ordered.groupBy(route).agg(F.count("*").alias("steps_total"))
    return numbered(ordered, [route], order, "step_no").join(totals, route)


def concat_paths(paths: DataFrame) -> DataFrame:
    """Points of whole routes: (route_id, path_idx, lat, lng), step after step."""
    before = running_sums(
        paths.withColumn("_n", F.size("points").cast("bigint")), ["route_id"], "step_index",
        {"_before": F.col("_n")}, inclusive=False,
    )
    return rows_of(before, ["route_id", "step_index", "_before"], "points", "pt_idx", "p").select(
        "route_id", "step_index", "pt_idx", (F.col("_before") + F.col("pt_idx")).alias("path_idx"),
        "p.lat", "p.lng",
    )
