"""Frame rows: sampling, manifest frames, duplicates, regeneration, augments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import frames as fr
from wayline.functions import geo
from wayline.functions import normalize as N
from wayline.functions.core import present
from wayline.operators.joins import PATH_HASH
from wayline.operators.ordered import first_by


def camera() -> dict[str, Column]:
    return {
        "pitch": F.lit(fixed.FRAME_PITCH), "fov": F.lit(fixed.FRAME_FOV), "size": F.lit(fixed.FRAME_SIZE),
    }


def sample_frames(
    steps: DataFrame, keys: list[str], step_len: Column, profile: Column,
    spacing: Column | float = 20.0, start: Column | None = None, end: Column | float = 0.0,
) -> DataFrame:
    """One row per frame of a step with its camera pose.

    Steps with fewer than two points give no rows; a missing step length is
    measured along the path.  All targets of a step are placed in its own row.
    """
    length = F.coalesce(F.nullif(step_len.cast("double"), F.lit(0.0)), geo.path_length(F.col("points")))
    known = steps.where(F.size("points") >= 2).withColumn("_len", length)
    targets = F.filter(
        fr.profile_distances(F.col("_len"), profile, spacing, start, end), lambda t: t <= F.col("_len")
    )
    placed = known.withColumn("_t", targets).withColumn(
        "_q", F.explode(geo.poses_at_remaining(F.col("points"), F.col("_len"), F.col("_t")))
    )
    return placed.select(
        *keys, F.col("_q.remaining_m").cast("int").alias("remaining_m"),
        "_q.lat", "_q.lng", "_q.heading", *[c.alias(n) for n, c in camera().items()],
    )


FRAME = (
    "struct<filename:string,distance_into_step_m:int,remaining_m:int,lat:double,lng:double,heading:double>"
)


def resolve_step_frames(
    steps: DataFrame, profile: str, spacing: float = 5.0,
    start: float | None = None, end: float | None = None,
) -> DataFrame:
    """Adds ``resolved``: the frames one download run would fetch per step.

    Steps carry ``frames`` (stored frames) and ``points`` (their path).
    """
    stored = F.coalesce("frames", F.array().cast(f"array<{FRAME}>"))
    if profile == "manifest":
        only = fr.closest_frame(stored)
        return steps.withColumn(
            "resolved", F.when(F.size(stored) > 0, F.array(only)).otherwise(F.array().cast(f"array<{FRAME}>"))
        )
    targets = fr.profile_distances(
        F.col("distance_m"), F.lit(profile), spacing, None if start is None else F.lit(start), end or 0.0
    )
    out = steps.withColumn("_t", targets).withColumn(
        "_q", geo.poses_at_remaining(F.col("points"), F.lit(0.0), F.col("_t"))
    )
    located = F.size("points") >= 2

    def frame(q: Column) -> Column:
        rem = q["remaining_m"]
        return F.struct(
            N.frame_filename(F.col("route_id"), F.col("step_index"), rem, F.col("distance_m")).alias("filename"),
            F.greatest(F.lit(0), F.col("distance_m") - rem).cast("int").alias("distance_into_step_m"),
            rem.cast("int").alias("remaining_m"),
            F.when(located, q["lat"]).otherwise(F.col("start_lat")).alias("lat"),
            F.when(located, q["lng"]).otherwise(F.col("start_lng")).alias("lng"),
            F.when(located, q["heading"]).otherwise(F.col("heading")).alias("heading"),
        )

    made = F.transform("_q", frame)
    if profile == "sparse4":
        made = F.when(F.size(stored) > 0, stored).otherwise(made)
    return out.withColumn("resolved", made).drop("_t", "_q")


def step_frame_names(
    steps: DataFrame, profile: str, spacing: float = 5.0,
    start: float | None = None, end: float | None = None,
) -> DataFrame:
    """Adds ``names``: the file names of ``resolve_step_frames`` without any pose."""
    names = lambda frames: frames["filename"]
    stored = F.coalesce("frames", F.array().cast(f"array<{FRAME}>"))
    if profile == "manifest":
        closest = F.array(fr.closest_frame(stored))
        none = F.array().cast("array<string>")
        return steps.withColumn("names", F.when(F.size(stored) > 0, names(closest)).otherwise(none))
    targets = fr.profile_distances(
        F.col("distance_m"), F.lit(profile), spacing, None if start is None else F.lit(start), end or 0.0
    )
    made = F.transform(
        targets, lambda t: N.frame_filename(F.col("route_id"), F.col("step_index"), t, F.col("distance_m"))
    )
    if profile == "sparse4":
        made = F.when(F.size(stored) > 0, names(stored)).otherwise(made)
    return steps.withColumn("names", made)


def backfill_params(frames: DataFrame) -> DataFrame:
    """Fill lat, lng and heading of frames: own, else along the path, else the step start.

    The path is used only when one of the three is missing, and then for all.
    """
    pose = geo.pose_from_points(F.col("points"), F.col("remaining_m").cast("double"))
    out = frames.withColumn("_q", pose)
    incomplete = F.col("lat").isNull() | F.col("lng").isNull() | F.col("heading").isNull()
    placed = incomplete & F.col("_q").isNotNull()
    pick = lambda n: F.when(placed, F.col(f"_q.{n}")).otherwise(F.col(n))
    out = out.withColumns({f"_{n}": pick(n) for n in ("lat", "lng", "heading")})
    astray = F.col("_lat").isNull() | F.col("_lng").isNull()
    return out.withColumns(
        {
            "lat": F.when(astray, F.col("start_lat")).otherwise(F.col("_lat")),
            "lng": F.when(astray, F.col("start_lng")).otherwise(F.col("_lng")),
            "heading": F.coalesce("_heading", "step_heading", F.lit(0.0)),
        }
    ).drop("_q", "_lat", "_lng", "_heading")


def distinct_panoramas(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Covered frames, each panorama once per step; unnamed panoramas all stay."""
    covered = frames.where(F.col("status") == "OK")
    named = present(F.col("pano_id")).isNotNull()
    return covered.where(~named).unionByName(
        first_by(covered.where(named), [*keys, "pano_id"], F.col(order))
    )


def distinct_content(frames: DataFrame, keys: list[str], order: str, digest: str = "digest") -> DataFrame:
    """First frame per path, then per content; frames without content stay."""
    by_path = first_by(frames, [*keys, "path"], F.col(order))
    readable = F.col(digest).isNotNull()
    return by_path.where(~readable).unionByName(
        first_by(by_path.where(readable), [*keys, digest], F.col(order))
    )


def regenerate_plan(
    desired: DataFrame, stored: DataFrame, files: DataFrame, replace: bool = False
) -> DataFrame:
    """What to do with every frame path of a sample: skip, download or stale.

    ``desired`` and ``stored`` hold (sample_id, path) of wanted and listed
    frames, ``files`` the paths that exist.
    """
    side = lambda df, wanted: df.select("sample_id", "path", F.lit(wanted).alias("wanted"))
    return plan_of_listed(side(desired, True).unionByName(side(stored, False)), files, replace)


def plan_of_listed(listed: DataFrame, files: DataFrame, replace: bool = False, route: str | None = None) -> DataFrame:
    """``regenerate_plan`` over one table of (sample_id, path, wanted).

    A frame that is both wanted and listed counts as wanted.  Frames and files are one table, sorted once by a hash
    before the path: for the first row of a frame and for the file next to it.  ``route`` names the column with the
    route in the name of each frame (``normalize.route_of_frame``), where the rows lie by it: then only files move.
    """
    ids = ["sample_id", "path", "wanted"]
    placed = F.when(F.col("path").isNull(), F.xxhash64(*ids)).otherwise(F.xxhash64("path"))
    rows = listed.select(*ids, *([route] if route else [])).withColumns({PATH_HASH: placed, "_file": F.lit(False)})
    there = files.select("path").where(F.col("path").isNotNull())
    if route:
        cut = there.select(N.route_of_frame(F.col("path")).alias(route), "path").withColumn("_rest", F.substr("path", F.length(route) + 1))
        there = cut.select(route, "_rest").repartition(route).select(route, F.concat(route, "_rest").alias("path"))
    there = there.withColumns({
        "sample_id": F.lit(None).cast(listed.schema["sample_id"].dataType), "wanted": F.lit(False), PATH_HASH: F.xxhash64("path"), "_file": F.lit(True)})
    both = rows.unionByName(there)
    if not route:
        both = both.repartition(PATH_HASH, "path")
    path = [PATH_HASH, *([route] if route else []), "path"]
    own = Window.partitionBy(*path, "sample_id", "_file").orderBy(F.col("wanted").desc())
    first = both.withColumn("_before", F.lag(F.lit(True)).over(own)).where(F.col("_before").isNull())
    found = first.withColumn("_there", F.max("_file").over(Window.partitionBy(*path))).where(~F.col("_file"))
    action = (
        F.when(F.col("wanted") & F.lit(not replace) & F.col("_there"), "skip").when(F.col("wanted"), "download")
        .when(F.col("_there"), "stale").otherwise("gone")
    )
    return found.select("sample_id", "path", action.alias("action"))


def regenerate_totals(plan: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    per_sample = plan.groupBy("sample_id").agg(
        n("skip").alias("skip"), n("download").alias("download"), n("stale").alias("stale")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_sample.agg(
        F.count("*").alias("samples_total"),
        F.count_if(F.col("skip") + F.col("download") > 0).alias("samples_updated"),
        total("skip").alias("skipped_existing"), total("download").alias("to_download"),
        total("stale").alias("removed_old"),
    )


def augment_plan(frames: DataFrame, augments: list[str], path: str = "path") -> DataFrame:
    """Output path of every frame under every augment."""
    unknown = [a for a in augments if a not in fixed.AUGMENTS]
    if unknown:
        raise ValueError(f"unknown augments: {unknown}")
    each = F.explode(F.array(*[F.lit(a) for a in augments])).alias("augment")
    return frames.select(F.col(path).alias("source"), each).withColumn(
        "output", F.concat(F.lit("frames_"), F.col("augment"), F.lit("/"), N.base_name(F.col("source")))
    )
