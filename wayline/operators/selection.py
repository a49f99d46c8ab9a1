"""Row selection: validity, routes, files, search, runnable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions.core import present, rows_of
from wayline.functions.normalize import city_of_sample
from wayline.operators.joins import with_existence, with_path_hash
from wayline.operators.ordered import dense_ordinal


def invalid_results(results: DataFrame) -> DataFrame:
    """Rows that break a rule of the result format, with one flag per rule."""
    aug, mod, conf = F.col("augment"), F.col("modality"), F.col("confidence")
    no = F.lit(False)
    flags = {
        "bad_augment": F.coalesce(~aug.isin(fixed.AUGMENTS), no),
        "augment_with_prior": F.coalesce((aug != "") & (mod == "prior"), no),
        "bad_confidence": F.coalesce((conf < 0) | (conf > 1), no),
        "bad_modality": F.coalesce(~mod.isin(fixed.MODALITIES), no),
    }
    any_bad = None
    for name in flags:
        any_bad = F.col(name) if any_bad is None else any_bad | F.col(name)
    return results.withColumns(flags).where(any_bad)


def in_routes(samples: DataFrame, routes: list[str], id_col: str = "id") -> DataFrame:
    """Samples of the routes; an id that starts with a route counts too."""
    cond = F.col("route_id").isin(routes)
    for route in routes:
        cond = cond | F.col(id_col).startswith(route)
    return samples.where(cond)


def in_ids(samples: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return samples.join(ids.select(id_col).distinct(), id_col, "left_semi")


def files_of_modality(
    rows: DataFrame, modality: str, file: str = "file", order: str = "ordinal"
) -> DataFrame:
    """All rows of the files whose first row has the modality."""
    first = rows.groupBy(file).agg(F.min_by("modality", order).alias("_first"))
    keep = first.where(F.col("_first") == modality).select(file)
    return rows.join(keep, file, "left_semi")


def search(
    samples: DataFrame, city: str | None = None, maneuver: str | None = None,
    text: str | None = None, id_col: str = "id",
) -> DataFrame:
    out = samples
    if city is not None:
        out = out.where(city_of_sample(F.col("city"), F.col(id_col)) == city)
    if maneuver is not None:
        out = out.where(F.col("maneuver") == maneuver)
    if text:
        needle = F.lit(text.lower())
        out = out.where(
            F.contains(F.lower(id_col), needle) | F.contains(F.lower("instruction"), needle)
        )
    return out


def without_arrivals(samples: DataFrame) -> DataFrame:
    return samples.where(F.coalesce(F.upper("maneuver"), F.lit("")) != "ARRIVE")


def lookup_samples(
    samples: DataFrame, results: DataFrame, gt: DataFrame, ids: DataFrame
) -> DataFrame:
    """Detail rows of the wanted samples with their result count and label."""
    wanted = ids.select("sample_id").distinct()
    only = lambda df: df.join(wanted, "sample_id", "left_semi")
    counts = only(results).groupBy("sample_id").agg(F.count("*").alias("n_results"))
    labels = gt.select("sample_id", F.col("instruction").alias("gt_instruction"))
    return (
        only(samples).join(counts, "sample_id", "left").join(only(labels), "sample_id", "left")
    )


def select_frames(samples: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Frames one run would send, and whether enough of them exist.

    One frame (the last) for the image modality or any augment, none for the
    prior-only modality, else all.  ``files`` is the inventory of paths.
    """
    single = (F.col("modality") == "image + prior") | present(F.col("augment")).isNotNull()
    chosen = (
        F.when(F.col("modality") == "prior", F.array().cast("array<string>"))
        .when(single & (F.size("frames") > 1), F.slice("frames", -1, 1))
        .otherwise(F.col("frames"))
    )
    base = samples.withColumn("selected", chosen).withColumn("n_selected", F.size("selected").cast("bigint"))
    # frames and map of a sample ask for their paths in one table, the map behind the frames
    asked = F.concat(F.coalesce("selected", F.array().cast("array<string>")), F.array("overhead"))
    rows = rows_of(base.withColumn("_asked", asked), [*keys, "n_selected"], "_asked", item="path")
    is_map = F.col("_i") == F.coalesce("n_selected", F.lit(0))
    wanted = with_path_hash(rows.select(*keys, "path", is_map.alias("_map")).where(F.col("path").isNotNull()))
    existing = with_existence(wanted, files, "_there").where("_there").groupBy(*keys).agg(
        F.count_if(~F.col("_map")).alias("n_existing"), F.bool_or("_map").alias("has_map")
    )
    need = F.when((F.col("modality") == "video + prior") & present(F.col("augment")).isNull(), 2).otherwise(1)
    out = base.join(existing, keys, "left")
    n, has_map = F.coalesce("n_existing", F.lit(0)).cast("bigint"), F.coalesce("has_map", F.lit(False))
    return out.withColumn("n_existing", n).withColumn("has_map", has_map).withColumn(
        "runnable", F.col("has_map") & ((F.col("modality") == "prior") | (F.col("n_existing") >= need))
    )


def limit_matched(samples: DataFrame, matched: Column, limit: int, keep: Column, order: list[str]) -> DataFrame:
    """First ``limit`` rows that match, then the skip rules; skipped rows use up the limit.

    Only the ``order`` columns, which identify a row, are numbered.
    """
    rows = samples.where(matched)
    first = dense_ordinal(rows.select(*order), order, "matched_no").where(F.col("matched_no") <= limit)
    return rows.join(first, order).where(keep)


def page(samples: DataFrame, order: list[str], number: int, size: int = 25) -> DataFrame:
    """One page (from 0) in dataset order.

    Only the ``order`` columns, which identify a row, are numbered; the rows of
    the page are then looked up.
    """
    placed = dense_ordinal(samples.select(*order), order, "row_no")
    wanted = placed.where((F.col("row_no") > number * size) & (F.col("row_no") <= (number + 1) * size))
    return samples.join(wanted, order)
