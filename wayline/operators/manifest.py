"""Manifests: routes with nested steps and frames, in rows of bounded size.

One manifest row holds at most ``STEPS_PER_ROW`` steps of one route.  A usual
route is exactly one row; a huge one is cut into several with rising ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import frames as fr
from wayline.functions import normalize as N
from wayline.operators.samples import nested_rows
from wayline.operators.ordered import running_sums

STEPS_PER_ROW = 1000
STEP_FIELDS = ["step_index", "maneuver", "instruction", "polyline", "distance_m",
               "start_lat", "start_lng", "end_lat", "end_lng", "heading", "frames", "osm_road"]


def fill_legacy_frames(steps: DataFrame) -> DataFrame:
    """``frames``, else ``sparse4_frames``, else the single ``frame``."""
    have = F.coalesce(F.size("frames"), F.lit(0)) > 0
    many = F.coalesce(F.size("sparse4_frames"), F.lit(0)) > 0
    return steps.withColumn(
        "frames",
        F.when(have, F.col("frames")).when(many, F.col("sparse4_frames"))
        .when(F.col("frame").isNotNull(), F.array("frame")).otherwise(F.col("frames")),
    )


def steps_with_frames(samples: DataFrame, profile: str = "sparse4") -> DataFrame:
    """Manifest steps of sample rows: frame paths become frame structs."""
    parsed = F.transform(
        F.filter(F.coalesce("frame_paths", F.array().cast("array<string>")), lambda p: p != ""),
        lambda p: F.struct(N.base_name(p).alias("filename"), N.parse_frame_filename(p).alias("d")),
    )
    flat = F.transform(
        parsed,
        lambda f: F.struct(
            f["filename"].alias("filename"), f["d"]["distance_into_step_m"].alias("distance_into_step_m"),
            f["d"]["remaining_m"].alias("remaining_m"),
        ),
    )
    out = samples.withColumn("frames", flat)
    return out.withColumn("frames", fr.frames_in_profile(F.col("frames"), F.col("distance_m"), profile))


def build_manifest(steps: DataFrame, route_metadata: DataFrame | None = None) -> DataFrame:
    """Nested manifest rows: route_id, part, counts and the steps in order."""
    fields = [c for c in STEP_FIELDS if c in steps.columns]
    packed = F.struct(*fields)  # step_index comes first, so structs sort by it
    rows = steps.withColumn("part", F.floor(F.col("step_index") / STEPS_PER_ROW)).groupBy(
        "route_id", "part"
    ).agg(
        F.count("*").alias("steps_count"),
        F.sum(F.coalesce(F.size("frames"), F.lit(0))).cast("bigint").alias("frames_count"),
        F.array_sort(F.collect_list(packed), _by_index).alias("steps"),
    )
    if route_metadata is not None:
        rows = rows.join(route_metadata, "route_id", "left")
    return rows


def _by_index(a, b):
    return F.when(a["step_index"] < b["step_index"], F.lit(-1)).when(
        a["step_index"] > b["step_index"], F.lit(1)
    ).otherwise(F.lit(0))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count_distinct("route_id").alias("routes_count"),
        F.sum("steps_count").alias("samples_count"), F.sum("frames_count").alias("total_frames"),
    )


def manifest_steps(manifest: DataFrame) -> DataFrame:
    """One row per step of nested manifest rows."""
    return manifest.select("route_id", F.explode("steps").alias("s")).select("route_id", "s.*")


def manifest_to_samples(manifest: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Nested sample rows of a manifest, with the metres left on the route; created_at is that of the manifest."""
    steps = manifest_steps(manifest).withColumn("distance_m", F.coalesce("distance_m", F.lit(0)))
    rest = running_sums(
        steps, ["route_id"], "step_index",
        {"remaining_distance_m": F.col("distance_m").cast("bigint")}, reverse=True,
    )
    return nested_rows(rest, "manifest_download", created_at if created_at is not None else F.lit(None).cast("string"))


def manifest_routes(manifest: DataFrame) -> DataFrame:
    """Route metadata rows of a manifest."""
    return manifest.groupBy("route_id").agg(
        F.sum("steps_count").alias("steps_count"), F.sum("frames_count").alias("frames_count")
    )


def attach_labels(manifest: DataFrame) -> DataFrame:
    """Embedded labels (map of sample id to label) as rows."""
    return manifest.select(F.explode("gt_labels").alias("sample_id", "label")).select(
        "sample_id", "label.*"
    )
