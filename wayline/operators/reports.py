"""Counts, accuracies, costs and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import frames as fr
from wayline.functions import normalize as N
from wayline.functions.core import first_present, present
from wayline.operators.joins import with_registry


def share_of(counts: DataFrame, n: str = "n") -> Column:
    """Percent of the column total, by a scalar subquery over the counts."""
    total = counts.agg(F.sum(n).alias("t")).select("t").scalar()
    return F.col(n) * 100.0 / total


def maneuver_distribution(samples: DataFrame) -> DataFrame:
    counts = samples.groupBy(F.coalesce("maneuver", F.lit("UNKNOWN")).alias("maneuver")).agg(
        F.count("*").alias("n")
    )
    return counts.withColumn("percent", F.bround(share_of(counts), 4)).orderBy(F.desc("n"), "maneuver")


def dataset_stats(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Routes, samples, frames, maps and augmented frames of a dataset."""
    kind = F.col("kind")
    inventory = file_kinds(files).agg(
        F.count_if(kind == "frame").alias("frames"), F.count_if(kind == "map").alias("maps"),
        F.count_if(kind == "augment").alias("augmented_frames"),
    )
    counts = samples.agg(F.count_distinct("route_id").alias("routes"), F.count("*").alias("samples"))
    # one struct, so that the inventory is counted by one subquery
    found = inventory.select(F.struct("frames", "maps", "augmented_frames").alias("s")).scalar()
    pick = lambda c: found.getField(c).alias(c)
    return counts.select("routes", "samples", pick("frames"), pick("maps"), pick("augmented_frames"))


def file_kinds(files: DataFrame) -> DataFrame:
    """frame, map or augment by directory, with the augment of both layouts."""
    image = F.lower("path").rlike(r"\.(jpg|png)$")
    augment = first_present(
        F.regexp_extract("folder", r"(?:^|/)frames_(night|fog|rain|motion_blur)$", 1),
        F.regexp_extract("folder", r"(?:^|/)augments/(night|fog|rain|motion_blur)$", 1),
    )
    kind = (
        F.when(~image, F.lit(None)).when(augment.isNotNull(), "augment")
        .when(F.col("folder").rlike(r"(^|/)frames$"), "frame")
        .when(F.col("folder").rlike(r"(^|/)(osm_)?maps$"), "map")
    )
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    return files.withColumn("folder", folder).withColumns({"kind": kind, "augment": augment})


def augment_counts(files: DataFrame) -> DataFrame:
    return file_kinds(files).where(F.col("kind") == "augment").groupBy("augment").agg(F.count("*").alias("n"))


def viewer_stats(samples: DataFrame, results: DataFrame, id_col: str = "id") -> DataFrame:
    """Samples per city next to the totals of the dataset."""
    city = N.city_of_sample(F.col("city"), F.col(id_col)).alias("name")
    per_city = samples.groupBy(city).agg(F.count("*").alias("count"))
    totals = results.agg(
        F.count_distinct("model_id").alias("total_models"), F.count("*").alias("total_results")
    )
    all_samples = per_city.agg(F.sum("count").alias("s")).select("s").scalar()
    both = totals.select(F.struct("total_models", "total_results").alias("s")).scalar()
    return per_city.select(
        "name", "count", all_samples.alias("total_samples"),
        both.getField("total_models").alias("total_models"),
        both.getField("total_results").alias("total_results"),
    ).orderBy("name")


def predicted_maneuver() -> Column:
    return first_present(F.col("predicted_maneuver"), F.col("maneuver"), F.col("next_action"))


def confusion(matched: DataFrame) -> DataFrame:
    """Counts of true maneuver against predicted, for rows with a prediction."""
    rows = matched.where(F.col("predicted").isNotNull())
    return rows.groupBy(F.col("true_maneuver"), F.upper("predicted").alias("predicted")).agg(
        F.count("*").alias("n")
    )


def maneuver_accuracy(matched: DataFrame) -> DataFrame:
    """Case-insensitive hits over all matched rows, with or without a prediction."""
    hit = F.coalesce(F.upper("predicted") == F.upper("true_maneuver"), F.lit(False))
    return matched.agg(
        F.count("*").alias("matched"), F.count_if(hit).alias("correct"),
        F.avg(hit.cast("double")).alias("maneuver_accuracy"),
    )


def lane_change_prf(scored: DataFrame, pred: str = "pred_change", gt: str = "gt_change") -> DataFrame:
    """Precision, recall and F1 per model; open labels stay out."""
    p, g = F.coalesce(F.col(pred), F.lit(False)), F.col(gt)
    counts = scored.where(g.isNotNull()).groupBy("model_id").agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": F.bround(ratio(tp, tp + fp), 4), "recall": F.bround(ratio(tp, tp + fn), 4),
            "f1": F.bround(ratio(2 * tp, 2 * tp + fp + fn), 4),
        }
    )


def lanes_error(rows: DataFrame, pred: str = "lanes_count", gt: str = "gt_lanes") -> DataFrame:
    """Mean absolute lane error and exact rate where both sides are known."""
    gap = F.abs(F.col(pred) - F.col(gt))
    return rows.where(gap.isNotNull()).groupBy("model_id").agg(
        F.count("*").alias("n"), F.bround(F.avg(gap), 6).alias("mae"),
        F.bround(F.avg((gap == 0).cast("double")), 6).alias("exact_rate"),
    )


MODALITY_SHORT = {"image + prior": "ip", "video + prior": "vp", "prior": "p", "augment + prior": "ap"}


def leaderboard(scored: DataFrame) -> DataFrame:
    """One wide row per model: scores per modality, mean latency and mean words."""
    short = F.create_map(*[F.lit(x) for kv in MODALITY_SHORT.items() for x in kv])
    rows = scored.withColumn("_m", F.try_element_at(short, F.col("modality")))
    over = lambda m, c: F.bround(F.avg(F.when(F.col("_m") == m, F.col(c))), 3)
    cells = {}
    for m in MODALITY_SHORT.values():
        cells |= {m: over(m, "text_score"), f"{m}_act": over(m, "action"),
                  f"{m}_lc": over(m, "lane_change"), f"{m}_ln": over(m, "lanes")}
    # conditional averages read the rows once; a pivot would shuffle the same
    return rows.groupBy("model_id").agg(
        *[c.alias(n) for n, c in cells.items()],
        F.bround(F.avg(F.col("latency_ms") / 1000.0), 1).alias("lat"),
        F.bround(F.avg("words"), 1).alias("len"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run; a missing latency counts as 0 and failures count too."""
    failed = present(F.col("error")).isNotNull()
    return results.agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed"),
        F.avg(F.coalesce("latency_ms", F.lit(0))).alias("mean_latency_ms"),
    )


def download_estimate(targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Images a manifest run would fetch and their price; targets carry ``exists``."""
    per_step = targets.groupBy("route_id", "step_index").agg(
        F.count("filename").alias("t"), F.count_if("exists").alias("e")
    )
    out = per_step.agg(
        F.count_distinct("route_id").alias("routes"), F.count("*").alias("steps"),
        F.sum("t").alias("total_targets"), F.sum("e").alias("existing"),
    )
    left = F.greatest(F.col("total_targets") - F.col("existing"), F.lit(0))
    out = out.withColumn("to_download", left)
    asked = F.col("to_download") if limit is None else F.least(F.col("to_download"), F.lit(limit).cast("bigint"))
    return out.withColumn("estimated_requests", asked).withColumn(
        "estimated_cost_usd", F.bround(F.col("estimated_requests") / 1000.0 * fixed.IMAGE_USD_PER_1000, 4)
    )


def preflight(
    steps: DataFrame, profile: Column, skip_images: bool = False, google_maps: bool = False
) -> DataFrame:
    """Frames, calls and dollars per route before anything is fetched."""
    n = F.size(fr.profile_distances(F.col("distance_m"), profile)).cast("bigint")
    out = steps.withColumn("_n", n).groupBy("route_id").agg(
        F.count("*").alias("steps_count"), F.sum("_n").alias("total_frames")
    )
    images = F.lit(0).cast("bigint") if skip_images else F.col("total_frames")
    maps = F.col("steps_count") if google_maps else F.lit(0).cast("bigint")
    usd = lambda k: k / 1000.0 * fixed.IMAGE_USD_PER_1000
    return out.withColumns({"streetview_images": images, "static_maps": maps}).withColumns(
        {
            "streetview_cost": F.bround(usd(F.col("streetview_images")), 4),
            "maps_cost": F.bround(usd(F.col("static_maps")), 4),
            "estimated_cost_usd": F.bround(usd(F.col("streetview_images")) + usd(F.col("static_maps")), 4),
        }
    )


def token_cost(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Tokens and dollars per model; tokens are summed before the prices join."""
    used = results.groupBy("model_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )
    usd = (
        F.coalesce("tokens_in", F.lit(0)) * F.col("input_cost_per_mtok")
        + F.coalesce("tokens_out", F.lit(0)) * F.col("output_cost_per_mtok")
    ) / 1e6
    return with_registry(used, registry).select(
        "model_id", "tokens_in", "tokens_out", F.bround(usd, 8).alias("cost_usd")
    )


def prompt_images(results: DataFrame) -> DataFrame:
    """Images sent per answer, summed per modality: frames and the map."""
    n = F.coalesce(F.size("frame_paths"), F.lit(0)) + F.col("overhead_path").isNotNull().cast("int")
    return results.groupBy("modality").agg(
        F.count("*").alias("results"), F.sum(n).alias("images"), F.max(n).alias("most_images")
    )


def counts_per_modality(results: DataFrame) -> DataFrame:
    return results.groupBy("sample_id", "modality").agg(F.count("*").alias("n"))


def answers_per_model(results: DataFrame, modality: str | None = None, company: str | None = None) -> DataFrame:
    """Answers per sample and model after the filters of the viewer."""
    out = results
    if modality is not None:
        out = out.where(F.col("modality") == modality)
    if company is not None:
        out = out.where(N.company_of_model(F.col("model_id")) == company)
    return out.groupBy("sample_id", "model_id").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal")
    )


def distinct_values(samples: DataFrame, col: Column, name: str) -> DataFrame:
    return samples.select(col.alias(name)).distinct().orderBy(name)


def list_routes(steps: DataFrame) -> DataFrame:
    """Every route with the totals of its steps."""
    return steps.groupBy("route_id").agg(
        F.count("*").alias("steps_count"), F.sum("distance_m").alias("total_distance_m"), F.sum("duration_s").alias("total_duration_s"))
