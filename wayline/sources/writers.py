"""Sinks. Nothing is rewritten in place: a changed dataset goes to a new path.

Whole datasets are written as gzip lines by default, since the same names stand
in every line; Spark reads them as they are. ``compression="none"`` gives plain lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Ids of a score row next to one object with all its scores."""
    ids = ["sample_id", "model_id", "gt_model"]
    packed = F.struct(*[c for c in scores.columns if c not in ids]).alias("scores")
    scores.select(*ids, packed).write.mode("errorifexists").json(path)


def write_samples(samples: DataFrame, path: str, compression: str = "gzip") -> None:
    """Sample rows, one JSON object per line."""
    samples.write.mode("errorifexists").json(path, compression=compression)


def write_manifest(manifest: DataFrame, path: str, compression: str = "gzip") -> None:
    """Manifest rows, one JSON object per line; several files when it is large."""
    manifest.write.mode("errorifexists").json(path, compression=compression)


def write_rewritten(samples: DataFrame, path: str, compression: str = "gzip") -> None:
    """A full new version of the samples; the old files stay as the backup."""
    write_samples(samples, path, compression)


def with_new_frames(
    samples: DataFrame, frames: DataFrame, key: str = "id", whole: Callable[[DataFrame], DataFrame] | None = None, place: str | None = None
) -> DataFrame:
    """Samples with replaced frame lists; a sample without new frames keeps its own.

    ``frames`` is one row per sample with ``new_frames``.  ``whole`` makes the stored form of samples in the row,
    behind the join, and keeps that column: then narrow rows with the key are joined.  ``place`` names a column that
    rows of the same key agree in and both tables lie by: then they meet where they are, as one sorted table.
    """
    out = samples.join(frames.select(key, "new_frames"), key, "left") if place is None else _met(samples, frames, key, place)
    out = out if whole is None else whole(out)
    kept = F.coalesce(F.col("new_frames"), F.col("images.frames"))
    return out.withColumn("images", F.col("images").withField("frames", kept)).drop("new_frames")


def _met(samples: DataFrame, frames: DataFrame, key: str, place: str) -> DataFrame:
    """The left join of both by key, as one table ordered by place and key; a null key meets nothing."""
    new = frames.where(F.col(key).isNotNull()).select(place, key, F.struct("new_frames").alias("_new"))
    own = Window.partitionBy(place, key)
    both = samples.withColumn("_own", F.lit(True)).unionByName(new, allowMissingColumns=True)
    found = both.withColumn("_found", F.collect_list("_new").over(own)).where(F.col("_own"))
    return found.select(*samples.columns, F.explode_outer("_found").alias("_new")).select(*samples.columns, "_new.new_frames")
