"""Joins of samples, results, labels, files, roads and the model registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.core import present
from wayline.operators.ordered import first_by, first_rows

CELL = ["sample_id", "model_id", "modality", "variant", "augment"]


def latest_labels(labels: DataFrame, key: str = "sample_id", order: str = "line") -> DataFrame:
    """The last row of a label wins; ``order`` is unique per label."""
    return first_rows(labels, [key], order, last=True)


def predictions_with_labels(preds: DataFrame, labels: DataFrame, order: str = "line") -> DataFrame:
    """Predictions with the label of their sample; unlabelled ones drop out."""
    one = latest_labels(labels, order=order)
    return preds.join(one.withColumnRenamed(order, "_line").drop("_line"), "sample_id")


def match_counts(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """total, matched and unmatched predictions."""
    flag = labels.select("sample_id").distinct().withColumn("_hit", F.lit(True))
    return preds.join(flag, "sample_id", "left").agg(
        F.count("*").alias("total_predictions"),
        F.count("_hit").alias("matched_samples"),
        F.count_if(F.col("_hit").isNull()).alias("unmatched_samples"),
    )


def first_results(results: DataFrame, order: str = "ordinal") -> DataFrame:
    """First answer without error per sample and model, in file order (``order`` is unique)."""
    usable = results.where(
        present(F.col("error")).isNull() & F.col("sample_id").isNotNull()
        & present(F.col("model_id")).isNotNull()
    )
    return first_rows(usable, ["sample_id", "model_id"], order)


GT_FIELDS = [
    "enhanced_instruction", "next_action", "lane_change_required", "lanes_count",
    "relevant_landmarks", "potential_hazards",
]


def results_with_gt(results: DataFrame, gt: DataFrame) -> DataFrame:
    """Every answer next to the ground truth of its sample.

    The truth of a sample is the answer of its GT model; without one only the
    GT text is known.  The GT model itself is not scored.  ``results`` is one
    row per sample and model.
    """
    manual = gt.where(~F.coalesce("is_auto", F.lit(False))).select(
        "sample_id", F.substring_index(F.coalesce("result_key", F.lit("")), "::", 1).alias("gt_model"),
        F.col("instruction").alias("_text"), "acceptable_actions",
    )
    own = results.select(
        "sample_id", F.col("model_id").alias("gt_model"),
        F.struct(*GT_FIELDS).alias("gt"),
    )
    truth = manual.join(own, ["sample_id", "gt_model"], "left")
    known = F.col("gt").isNotNull()
    fields = [
        F.when(known, F.col(f"gt.{n}")).otherwise(
            F.coalesce("_text", F.lit("")) if n == "enhanced_instruction" else F.lit(None)
        ).alias(f"gt_{n}")
        for n in GT_FIELDS
    ]
    truth = truth.select("sample_id", "gt_model", "acceptable_actions", *fields)
    # only answers of labelled samples meet the join; AQE splits a crowded sample
    return results.join(truth, "sample_id").where(F.col("model_id") != F.col("gt_model"))


def _cells(df: DataFrame) -> DataFrame:
    """Identity of a run with '' and null as the same missing value."""
    return df.withColumns({c: present(F.col(c)) for c in ("variant", "augment")})


def _same_cell(a: DataFrame, b: DataFrame) -> Column:
    cond = None
    for c in CELL:
        part = a[c].eqNullSafe(b[c])
        cond = part if cond is None else cond & part
    return cond


def missing_cells(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted runs without a stored result of the same identity."""
    w, e = _cells(wanted), _cells(existing).select(*CELL).distinct()
    return w.join(e, _same_cell(w, e), "left_anti")


def pending_samples(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Samples a resumed run still has to do: those without a success."""
    done = results.where(present(F.col("error")).isNull()).select("sample_id").distinct()
    return samples.join(done, "sample_id", "left_anti")


def kept_results(results: DataFrame) -> DataFrame:
    """Rows a resumed run keeps; error rows go and are retried."""
    return results.where(present(F.col("error")).isNull())


def with_gt_only(rows: DataFrame, gt: DataFrame) -> DataFrame:
    manual = gt.where(~F.coalesce("is_auto", F.lit(False)))
    return rows.join(manual.select("sample_id").distinct(), "sample_id", "left_semi")


def with_split(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """Split of every sample (null without one); splits is unique per sample."""
    return samples.join(splits.select("sample_id", "split"), "sample_id", "left")


def with_result_counts(samples: DataFrame, results: DataFrame) -> DataFrame:
    counts = results.groupBy("sample_id").agg(F.count("*").alias("result_count"))
    return samples.join(counts, "sample_id", "left").withColumn(
        "result_count", F.coalesce("result_count", F.lit(0).cast("bigint"))
    )


def purge(
    samples: DataFrame, results: DataFrame, gt: DataFrame, files: DataFrame, source: str
) -> dict[str, DataFrame]:
    """Everything that stays when the samples of one source go.

    Files belong to a route when their name starts with it and ``_step``: each
    possible prefix of a name is an equality key, so no prefix scan is needed.
    """
    doomed = samples.where(F.col("source") == source)
    ids, routes = doomed.select("sample_id").distinct(), doomed.select("route_id").distinct()
    parts = F.split("path", "_step")
    prefixes = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_step"),
    )
    hit = (
        files.select("path", F.explode(prefixes).alias("route_id"))
        .join(routes, "route_id", "left_semi").select("path").distinct()
    )
    return {
        "samples": samples.where(~F.coalesce(F.col("source") == source, F.lit(False))),
        "results": results.join(ids, "sample_id", "left_anti"),
        "ground_truth": gt.join(ids, "sample_id", "left_anti"),
        "files": files.join(hit, "path", "left_anti"),
    }


def purge_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows removed and kept per table."""
    def count(df: DataFrame, name: str, sign: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(sign).alias("side"), "n")

    out = None
    for name in before:
        rows = count(before[name], name, "before").unionByName(count(after[name], name, "after"))
        out = rows if out is None else out.unionByName(rows)
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")))
    return out.groupBy("name").agg((n("before") - n("after")).alias("removed"), n("after").alias("kept"))


def merge_road_tags(steps: DataFrame, roads: DataFrame, keys: list[str]) -> DataFrame:
    """Road tags of a step with the found ones on top.

    Null values and keys that start with '_' are not taken over.
    """
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("tags", empty), lambda k, v: v.isNotNull() & ~k.startswith("_"))
    out = steps.join(roads.select(*keys, "tags"), keys, "left").withColumn("_new", new)
    old = F.map_filter(F.coalesce("osm_road", empty), lambda k, v: ~F.map_contains_key("_new", k))
    return out.withColumn("osm_road", F.map_concat(old, "_new")).drop("tags", "_new")


def resolve_examples(
    examples: DataFrame, city_samples: DataFrame, split_samples: DataFrame, gt: DataFrame,
    custom: DataFrame,
) -> DataFrame:
    """Example ids with their sample, GT text, label fields and frame.

    A city file beats the split file; a non-empty manual GT text is required.
    ``frame_at`` picks a frame from 0, the last one where it is null.
    """
    cols = ["sample_id", "instruction", "frames", "overhead"]
    ranked = city_samples.select(*cols, F.lit(0).alias("_rank")).unionByName(
        split_samples.select(*cols, F.lit(1).alias("_rank"))
    )
    sample = first_by(ranked, ["sample_id"], F.col("_rank")).drop("_rank")
    manual = gt.where(~F.coalesce("is_auto", F.lit(False))).select(
        "sample_id", F.col("instruction").alias("gt_instruction")
    ).where(present(F.col("gt_instruction")).isNotNull())
    out = examples.join(sample, "sample_id").join(manual, "sample_id").join(custom, "sample_id", "left")
    at = F.coalesce(F.col("frame_at") + 1, F.lit(-1))
    frame = F.when(F.size("frames") > 0, F.try_element_at("frames", at))
    return out.withColumn("frame", frame)


PATH_HASH = "_path_hash"


def with_path_hash(rows: DataFrame, path: str = "path") -> DataFrame:
    """Rows with ``PATH_HASH``, placed by it.

    Paths begin alike over many characters, so they are ordered by a hash first: it decides nearly every comparison
    of a sort.  Paths that share a hash are still told apart by their text.  Rows without a path meet nothing and
    lie anywhere.
    """
    placed = F.when(F.col(path).isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(path))
    return rows.withColumn(PATH_HASH, placed).repartition(PATH_HASH, path)


def with_existence(rows: DataFrame, files: DataFrame, flag: str, path: str = "path") -> DataFrame:
    """Rows of ``with_path_hash`` with a flag whether their path is one of ``files``."""
    there = files.select(F.xxhash64(path).alias(PATH_HASH), path).distinct().withColumn(flag, F.lit(True))
    return rows.join(there, [PATH_HASH, path], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def existing_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Target frames with a flag whether the file is there."""
    return with_existence(with_path_hash(targets, "filename"), files, "exists", "filename").drop(PATH_HASH)


def registry_names(registry: DataFrame) -> DataFrame:
    """One row per name a model answers to; its id beats an alias of another."""
    names = registry.select(
        F.struct(*registry.columns).alias("m"),
        F.explode(F.array_distinct(F.concat(F.array("model_id"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"),
    )
    rank = F.struct((F.col("name") != F.col("m.model_id")).alias("is_alias"), F.col("m.model_id").alias("id"))
    return names.groupBy("name").agg(F.min_by("m", rank).alias("m"))


def with_registry(rows: DataFrame, registry: DataFrame, how: str = "left") -> DataFrame:
    """Registry fields for rows with a model id or an alias of it."""
    names = registry_names(registry).select(
        F.col("name").alias("model_id"), F.col("m.model_id").alias("registry_id"),
        F.col("m.display_name").alias("display_name"),
        F.col("m.input_cost_per_mtok").alias("input_cost_per_mtok"),
        F.col("m.output_cost_per_mtok").alias("output_cost_per_mtok"),
    )
    return rows.join(names, "model_id", how)


def judge_requests(preds: DataFrame, ref_text: Column, pred_text: Column) -> DataFrame:
    """Two payload rows per judged sample: the prediction and the reference."""
    empty = F.array().cast("array<string>")
    items = lambda c: F.coalesce(c, empty)
    side = lambda name, text, prefix, reasoning: preds.select(
        "ordinal", "sample_id", F.lit(name).alias("model"), F.coalesce(text, F.lit("")).alias("enhanced_instruction"),
        items(F.col(f"{prefix}relevant_landmarks")).alias("relevant_landmarks"),
        items(F.col(f"{prefix}potential_hazards")).alias("potential_hazards"),
        reasoning.alias("reasoning"),
    )
    return side("prediction", pred_text, "", F.coalesce("reasoning", F.lit(""))).unionByName(
        side("reference", ref_text, "gt_", F.lit("Reference label"))
    )


def competitors(
    results: DataFrame, human: DataFrame | None, annotator: str, baseline: DataFrame | None
) -> DataFrame:
    """Results with human labels and the map baseline as two more models."""
    out = results.select("sample_id", "model_id", "enhanced_instruction")
    if human is not None:
        out = out.unionByName(
            human.select("sample_id", F.lit(f"human/{annotator}").alias("model_id"), "enhanced_instruction")
        )
    if baseline is not None:
        out = out.unionByName(
            baseline.select(
                "sample_id", F.lit("maps-osm/baseline").alias("model_id"),
                F.col("instruction").alias("enhanced_instruction"),
            )
        )
    return out


def union_results(*files: DataFrame) -> DataFrame:
    """All result tables as one relation; columns meet by name, a missing one is null."""
    out = files[0]
    for more in files[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def modality_of_files(files: DataFrame, name: str = "file", by: Sequence[str] = ()) -> DataFrame:
    """One bucket for each set of result files, by the strongest marker in any name."""
    has = lambda mark: F.coalesce(F.bool_or(F.contains(name, F.lit(mark))), F.lit(False))
    return files.groupBy(*by).agg(
        F.when(has("_augmented_"), "augmented").when(has("_video_prior"), "video_prior")
        .when(has("_image_prior_normal"), "image_prior").when(has("_prior_only"), "prior_only")
        .alias("modality")
    )
