"""Named queries: aggregations, windows, ordering and sampling."""

from pyspark.sql import functions as F

from wayline.functions import normalize as N
from wayline.operators import joins, matrix, pairwise, reports, routes, selection
from wayline.operators.ordered import with_both_neighbours
from wayline.plans import tables as t
from wayline.plans.frame_queries import _NAME, _STORED, profile_by_part, profile_sql
from wayline.plans.join_queries import HASH, NAMES, PAIRS, TARGETS, manifest_rows, targets
from wayline.plans.oracle_views import with_views
from wayline.plans.registry import query

STRINGS = "array<string>"
STEP = ["route_id", "step_index"]

# file inventory: frames, maps and augments of both layouts, by step
_FILES = """
SELECT CASE pk % 7 WHEN 0 THEN 'frames/' WHEN 1 THEN 'city/frames/' WHEN 2 THEN 'maps/' WHEN 3 THEN 'osm_maps/' WHEN 4 THEN 'frames_fog/'
  WHEN 5 THEN 'augments/rain/' ELSE 'other/' END || route_id || '_' || step_index || CASE WHEN sk % 10 = 0 THEN '.txt' ELSE '.jpg' END AS path, * FROM a_steps"""


def _files(spark, sf):
    pk = F.col("pk") % 7
    folder = (
        F.when(pk == 0, "frames/").when(pk == 1, "city/frames/").when(pk == 2, "maps/").when(pk == 3, "osm_maps/")
        .when(pk == 4, "frames_fog/").when(pk == 5, "augments/rain/").otherwise("other/")
    )
    return t.steps(spark, sf).select(
        F.concat(folder, "route_id", F.lit("_"), F.col("step_index").cast("string"),
                 F.when(F.col("sk") % 10 == 0, ".txt").otherwise(".jpg")).alias("path")
    )


@query("dataset_stats", with_views("a_steps", """
SELECT COUNT(DISTINCT route_id) AS routes, COUNT(*) AS samples, COUNT(*) FILTER (WHERE pk % 7 IN (0, 1) AND sk % 10 <> 0) AS frames,
  COUNT(*) FILTER (WHERE pk % 7 IN (2, 3) AND sk % 10 <> 0) AS maps, COUNT(*) FILTER (WHERE pk % 7 IN (4, 5) AND sk % 10 <> 0) AS augmented_frames FROM a_steps"""))
def _(spark, sf):
    return reports.dataset_stats(t.steps(spark, sf), _files(spark, sf))


@query("maneuver_distribution", with_views("a_samples", """
SELECT COALESCE(maneuver, 'UNKNOWN') AS maneuver, COUNT(*) AS n, round_even(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (), 4) AS percent FROM a_samples GROUP BY 1"""))
def _(spark, sf):
    return reports.maneuver_distribution(t.samples(spark, sf))


@query("augment_counts", with_views("a_steps", """
SELECT CASE pk % 7 WHEN 4 THEN 'fog' ELSE 'rain' END AS augment, COUNT(*) AS n FROM a_steps WHERE pk % 7 IN (4, 5) AND sk % 10 <> 0 GROUP BY 1"""))
def _(spark, sf):
    return reports.augment_counts(_files(spark, sf))


@query("viewer_stats", with_views("a_samples a_results", """
SELECT COALESCE(city, split_part(route_id, '_route', 1)) AS name, COUNT(*) AS count, (SELECT COUNT(*) FROM a_samples) AS total_samples,
  (SELECT COUNT(DISTINCT model_id) FROM a_results) AS total_models, (SELECT COUNT(*) FROM a_results) AS total_results FROM a_samples GROUP BY 1"""))
def _(spark, sf):
    return reports.viewer_stats(t.samples(spark, sf), t.results(spark, sf), "route_id")


def _matched(spark, sf):
    gt = t.ground_truth(spark, sf).select("sample_id", F.col("maneuver").alias("true_maneuver"))
    res = t.results(spark, sf).withColumns({
        "predicted_maneuver": F.when(F.col("ordinal") % 3 == 0, "Keep_Left").when(F.col("ordinal") % 3 == 1, ""),
        "maneuver": F.when(F.col("ordinal") % 6 == 1, "turn_right"),
    })
    return joins.predictions_with_labels(res.withColumn("predicted", reports.predicted_maneuver()), gt.withColumn("line", F.lit(1)))


_MATCHED = """
SELECT r.*, g.maneuver AS true_maneuver, CASE WHEN ordinal % 3 = 0 THEN 'Keep_Left' WHEN ordinal % 6 = 1 THEN 'turn_right' ELSE NULLIF(r.next_action, '') END AS predicted
FROM a_results r JOIN a_gt g USING (sample_id)"""


@query("confusion_matrix", with_views("a_results a_gt", """
SELECT true_maneuver, upper(predicted) AS predicted, COUNT(*) AS n FROM matched WHERE predicted IS NOT NULL GROUP BY ALL""", matched=_MATCHED))
def _(spark, sf):
    return reports.confusion(_matched(spark, sf))


@query("maneuver_accuracy", with_views("a_results a_gt", """
SELECT COUNT(*) AS matched, COUNT(*) FILTER (WHERE upper(predicted) = upper(true_maneuver)) AS correct,
  COUNT(*) FILTER (WHERE upper(predicted) = upper(true_maneuver)) / CAST(COUNT(*) AS DOUBLE) AS maneuver_accuracy FROM matched""", matched=_MATCHED))
def _(spark, sf):
    return reports.maneuver_accuracy(_matched(spark, sf))


_LANES = """
SELECT r.*, g.lane_change_required AS gt_change, g.lanes_count AS gt_lanes, r.lane_change_required = 'yes' AS pred_change FROM a_results r JOIN a_gt g USING (sample_id)"""


def _lanes(spark, sf):
    gt = t.ground_truth(spark, sf).select("sample_id", F.col("lane_change_required").alias("gt_change"), F.col("lanes_count").alias("gt_lanes"))
    return t.results(spark, sf).join(gt, "sample_id").withColumn("pred_change", N.lane_change_flag(F.col("lane_change_required")))


@query("lane_change_prf", with_views("a_results a_gt", """
SELECT model_id, tp, fp, fn, round_even(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 4) AS precision,
  round_even(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 4) AS recall,
  round_even(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 4) AS f1 FROM (
  SELECT model_id, COUNT(*) FILTER (WHERE pred_change AND gt_change) AS tp, COUNT(*) FILTER (WHERE pred_change AND NOT gt_change) AS fp,
    COUNT(*) FILTER (WHERE COALESCE(NOT pred_change, TRUE) AND gt_change) AS fn FROM lanes WHERE gt_change IS NOT NULL GROUP BY model_id)""", lanes=_LANES))
def _(spark, sf):
    return reports.lane_change_prf(_lanes(spark, sf))


@query("lanes_mae", with_views("a_results a_gt", """
SELECT model_id, COUNT(*) AS n, round_even(AVG(abs(lanes_count - gt_lanes)), 6) AS mae, round_even(AVG(CAST(lanes_count = gt_lanes AS INT)), 6) AS exact_rate
FROM lanes WHERE lanes_count IS NOT NULL AND gt_lanes IS NOT NULL GROUP BY model_id""", lanes=_LANES))
def _(spark, sf):
    return reports.lanes_error(_lanes(spark, sf))


@query("inference_run_summary", with_views("a_results", """
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE error IS NULL) AS success, COUNT(error) AS failed,
  AVG(CASE WHEN ordinal % 5 = 0 THEN 0 ELSE latency_ms END) AS mean_latency_ms FROM a_results"""))
def _(spark, sf):
    res = t.results(spark, sf).withColumn("latency_ms", F.when(F.col("ordinal") % 5 != 0, F.col("latency_ms")))
    return reports.run_summary(res)


MODELS = [{"model_id": "co1/m1"}, {"model_id": "co2/m9", "variant": "v2", "provider": "local"}, {"model_id": "co3/m3"}]
_ASSIGNED = "SELECT route_id, (ARRAY['rain', 'night', 'fog', 'motion_blur'])[1 + (row_number() OVER (ORDER BY route_id) - 1) % 4] AS augment FROM (SELECT DISTINCT route_id FROM a_samples)"
_CELLS = """
SELECT s.sample_id, s.route_id, m.model_id, m.variant, m.provider, k.task, k.modality, CASE WHEN k.augmented THEN a.augment END AS augment FROM a_samples s JOIN assigned a USING (route_id),
  (VALUES ('co1/m1', NULL, 'router'), ('co2/m9', 'v2', 'local'), ('co3/m3', NULL, 'router')) m(model_id, variant, provider),
  (VALUES ('video_prior_normal', 'video + prior', FALSE), ('prior_only', 'prior', FALSE), ('image_prior_augmented', 'image + prior', TRUE)) k(task, modality, augmented)"""


def _run(spark, sf):
    """Samples, configuration and assignments of a run."""
    samples = t.samples(spark, sf)
    return samples, MODELS, ["video_prior_normal", "prior_only", "image_prior_augmented"], matrix.assign_augments(samples)


@query("round_robin_augment", with_views("a_samples", "SELECT route_id, augment FROM assigned", assigned=_ASSIGNED))
def _(spark, sf):
    return matrix.assign_augments(t.samples(spark, sf))


@query("assignment_validate", with_views("a_samples a_steps", """
SELECT route_id, 'missing' AS problem FROM a_steps WHERE route_id NOT IN (SELECT route_id FROM a_samples) GROUP BY route_id
UNION ALL SELECT route_id, 'invalid augment' FROM assigned WHERE augment = 'night'""", assigned=_ASSIGNED))
def _(spark, sf):
    table = matrix.assign_augments(t.samples(spark, sf)).withColumn("augment", F.replace("augment", F.lit("night"), F.lit("dusk")))
    return matrix.assignment_problems(t.steps(spark, sf), table)


@query("matrix_task_expand", with_views("a_samples", """
SELECT model_id, variant, provider, task, modality, augment, COUNT(*) AS attempted FROM cells GROUP BY ALL""", assigned=_ASSIGNED, cells=_CELLS))
def _(spark, sf):
    return matrix.task_table(*_run(spark, sf), {"provider": "router"})


@query("matrix_task_summary", with_views("a_samples a_results", """
SELECT c.model_id, c.variant, c.modality, c.augment, COUNT(*) AS attempted, COUNT(e.hit) AS skipped_existing,
  CAST(COALESCE(SUM(CASE WHEN e.hit IS NULL THEN n.n END), 0) AS BIGINT) AS written, CAST(COALESCE(SUM(CASE WHEN e.hit IS NULL THEN n.bad END), 0) AS BIGINT) AS errors
FROM cells c
LEFT JOIN (SELECT DISTINCT sample_id, model_id, modality, NULLIF(variant, '') AS variant, NULLIF(augment, '') AS augment, 1 AS hit FROM a_results WHERE ordinal % 2 = 0) e
  ON e.sample_id = c.sample_id AND e.model_id = c.model_id AND e.modality = c.modality AND e.variant IS NOT DISTINCT FROM c.variant AND e.augment IS NOT DISTINCT FROM c.augment
LEFT JOIN (SELECT sample_id, model_id, modality, NULLIF(variant, '') AS variant, NULLIF(augment, '') AS augment, COUNT(*) AS n, COUNT(CASE WHEN latency_ms % 5 = 0 THEN 1 END) AS bad
  FROM a_results WHERE ordinal % 2 = 1 GROUP BY ALL) n
  ON n.sample_id = c.sample_id AND n.model_id = c.model_id AND n.modality = c.modality AND n.variant IS NOT DISTINCT FROM c.variant AND n.augment IS NOT DISTINCT FROM c.augment
GROUP BY ALL""", assigned=_ASSIGNED, cells=_CELLS))
def _(spark, sf):
    res = t.results(spark, sf).withColumn("error", F.when(F.col("latency_ms") % 5 == 0, "failed"))
    even = F.col("ordinal") % 2 == 0
    return matrix.task_summary(*_run(spark, sf), res.where(even), res.where(~even))


@query("modality_coverage", with_views("a_samples a_results", """
SELECT c.model_id, c.modality, c.route_id, COUNT(*) AS expected, COUNT(d.hit) AS present, COUNT(*) - COUNT(d.hit) AS missing FROM cells c
LEFT JOIN (SELECT DISTINCT sample_id, model_id, modality, NULLIF(variant, '') AS variant, NULLIF(augment, '') AS augment, 1 AS hit FROM a_results WHERE error IS NULL) d
  ON d.sample_id = c.sample_id AND d.model_id = c.model_id AND d.modality = c.modality AND d.variant IS NOT DISTINCT FROM c.variant AND d.augment IS NOT DISTINCT FROM c.augment
GROUP BY ROLLUP (c.model_id, c.modality, c.route_id)""", assigned=_ASSIGNED, cells=_CELLS))
def _(spark, sf):
    return matrix.coverage(*_run(spark, sf), t.results(spark, sf))


@query("route_totals", with_views("a_steps", f"""
SELECT route_id, CAST(SUM(distance_m) AS BIGINT) AS total_distance_m, CAST(SUM(duration_s) AS BIGINT) AS total_duration_s, COUNT(*) AS steps_count,
  CAST(SUM(pk % 5) AS BIGINT) AS frames_count, bool_or(COALESCE(maneuver_raw = 'ramp-right', FALSE)) AS has_highway,
  bool_or(pk % 11 = 0) AS has_toll, bool_or(pk % 13 = 0) AS has_ferry FROM a_steps GROUP BY route_id"""))
def _(spark, sf):
    pk = F.col("pk")
    text = F.concat("instruction", F.when(pk % 11 == 0, " Toll road").otherwise(""), F.when(pk % 13 == 0, " Ferry").otherwise(""))
    return routes.route_totals(t.steps(spark, sf).withColumns({"instruction": text, "n_frames": pk % 5}))


@query("manifest_build", with_views("a_steps", f"""
SELECT s.route_id, CAST(0 AS BIGINT) AS part, COUNT(*) AS steps_count, CAST(SUM(s.pk % 4) AS BIGINT) AS frames_count,
  string_agg(s.step_index || ':' || s.distance_m || ':' || COALESCE(f.names, ''), ' ' ORDER BY s.step_index) AS steps
FROM a_steps s LEFT JOIN (SELECT route_id, step_index, string_agg({_NAME}, ',' ORDER BY rem DESC) AS names FROM stored GROUP BY ALL) f USING (route_id, step_index) GROUP BY s.route_id""", stored=_STORED))
def _(spark, sf):
    text = lambda s: F.concat_ws(
        ":", s["step_index"].cast("string"), s["distance_m"].cast("string"),
        F.array_join(F.coalesce(F.transform(s["frames"], lambda f: f["filename"]), F.array().cast(STRINGS)), ","))
    return manifest_rows(spark, sf).select(
        "route_id", "part", "steps_count", "frames_count", F.array_join(F.transform("steps", text), " ").alias("steps")
    )


@query("download_estimate", with_views("a_steps", """
SELECT *, total_targets - existing AS to_download, LEAST(total_targets - existing, 5000) AS estimated_requests,
  round_even(LEAST(total_targets - existing, 5000) / CAST(1000 AS DOUBLE) * 7, 4) AS estimated_cost_usd
FROM (SELECT COUNT(DISTINCT route_id) AS routes, COUNT(*) AS steps, (SELECT COUNT(*) FROM targets) AS total_targets, (SELECT COUNT(*) FILTER (WHERE exists) FROM targets) AS existing FROM a_steps)""",
    stored=_STORED, targets=TARGETS))
def _(spark, sf):
    rows, files = targets(spark, sf, empty=True)  # a step without targets counts as a step
    return reports.download_estimate(joins.existing_targets(rows, files), limit=5000)


@query("preflight_cost", with_views("a_steps", f"""
SELECT s.route_id, COUNT(DISTINCT s.step_index) AS steps_count, COUNT(x.t) AS total_frames, COUNT(x.t) AS streetview_images, COUNT(DISTINCT s.step_index) AS static_maps,
  round_even(COUNT(x.t) / CAST(1000 AS DOUBLE) * 7, 4) AS streetview_cost, round_even(COUNT(DISTINCT s.step_index) / CAST(1000 AS DOUBLE) * 7, 4) AS maps_cost,
  round_even(COUNT(x.t) / CAST(1000 AS DOUBLE) * 7 + COUNT(DISTINCT s.step_index) / CAST(1000 AS DOUBLE) * 7, 4) AS estimated_cost_usd
FROM a_steps s LEFT JOIN (SELECT route_id, step_index, t FROM ({profile_sql("lens").replace("CAST(20 AS DOUBLE)", "CAST(20 AS DOUBLE)").replace("CAST(150 AS DOUBLE)", "d").replace("CAST(30 AS DOUBLE)", "CAST(0 AS DOUBLE)")})) x USING (route_id, step_index) GROUP BY s.route_id""",
    lens="SELECT *, CAST(distance_m AS DOUBLE) AS d FROM a_steps"))
def _(spark, sf):
    return reports.preflight(t.steps(spark, sf), profile_by_part(), google_maps=True)


@query("benchmark_cost", with_views("a_results a_samples", """
SELECT p AS pairs, p * s AS total_comparisons, p * s * 3 AS total_judge_calls, round_even(p * s * 3 * CAST(0.025 AS DOUBLE), 4) AS estimated_cost_usd
FROM (SELECT (SELECT COUNT(*) FROM pairs) AS p, (SELECT COUNT(*) FROM a_samples) AS s)""", pairs=PAIRS))
def _(spark, sf):
    return pairwise.benchmark_cost(t.results(spark, sf), t.samples(spark, sf))


MAJORITY = """
SELECT *, CASE WHEN a >= 2 AND a * 3 >= n * 2 THEN model_a WHEN b >= 2 AND b * 3 >= n * 2 THEN model_b END AS majority_winner FROM (
  SELECT ordinal, sample_id, model_a, model_b, COUNT(*) FILTER (WHERE error IS NULL) AS n, COUNT(*) FILTER (WHERE error IS NULL AND winner = 'A') AS a,
    COUNT(*) FILTER (WHERE error IS NULL AND winner = 'B') AS b FROM a_votes GROUP BY ALL)"""


@query("vote_majority", with_views("a_votes", """
SELECT ordinal, model_a, model_b, majority_winner, majority_winner IS NULL AS is_tie FROM maj""", maj=MAJORITY))
def _(spark, sf):
    return pairwise.majority(t.votes(spark, sf)).select("ordinal", "model_a", "model_b", "majority_winner", "is_tie")


@query("win_loss_tally", with_views("a_votes", """
SELECT model_id, split_part(model_id, '/', 1) AS company, COUNT(*) FILTER (WHERE majority_winner = model_id) AS wins, COUNT(*) FILTER (WHERE majority_winner <> model_id) AS losses,
  COUNT(*) FILTER (WHERE majority_winner IS NULL) AS ties, COUNT(*) AS total_comparisons
FROM (SELECT model_a AS model_id, majority_winner FROM maj UNION ALL SELECT model_b, majority_winner FROM maj) GROUP BY ALL""", maj=MAJORITY))
def _(spark, sf):
    return pairwise.tally(pairwise.majority(t.votes(spark, sf)))


@query("results_by_modality_count", with_views("a_results", "SELECT sample_id, modality, COUNT(*) AS n FROM a_results GROUP BY ALL"))
def _(spark, sf):
    return reports.counts_per_modality(t.results(spark, sf))


@query("results_grouped_by_model", with_views("a_results", """
SELECT sample_id, model_id, COUNT(*) AS n, MIN(ordinal) AS first_ordinal, MAX(ordinal) AS last_ordinal FROM a_results
WHERE modality = 'video + prior' AND split_part(model_id, '/', 1) = 'co2' GROUP BY ALL"""))
def _(spark, sf):
    return reports.answers_per_model(t.results(spark, sf), "video + prior", "co2")


@query("distinct_filter_values", with_views("a_samples", """
SELECT DISTINCT 'city' AS kind, COALESCE(city, split_part(route_id, '_route', 1)) AS value FROM a_samples
UNION ALL SELECT DISTINCT 'maneuver', COALESCE(maneuver, '') FROM a_samples"""))
def _(spark, sf):
    samples = t.samples(spark, sf)
    cities = reports.distinct_values(samples, N.city_of_sample(F.col("city"), F.col("route_id")), "value")
    maneuvers = reports.distinct_values(samples, F.coalesce("maneuver", F.lit("")), "value")
    return cities.select(F.lit("city").alias("kind"), "value").unionByName(maneuvers.select(F.lit("maneuver").alias("kind"), "value"))


@query("token_cost", with_views("a_results a_registry", """
SELECT r.model_id, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out,
  round_even(SUM((tokens_in * input_cost_per_mtok + tokens_out * output_cost_per_mtok) / 1e6), 8) AS cost_usd
FROM a_results r LEFT JOIN names n ON n.name = r.model_id LEFT JOIN a_registry g ON g.model_id = n.registry_id GROUP BY r.model_id""", names=NAMES))
def _(spark, sf):
    return reports.token_cost(t.results(spark, sf), t.registry(spark, sf))


@query("prompt_images", with_views("a_results", """
SELECT modality, COUNT(*) AS results, CAST(SUM(n) AS BIGINT) AS images, CAST(MAX(n) AS INT) AS most_images FROM (
  SELECT modality, CASE WHEN ordinal % 4 > 0 THEN ordinal % 4 ELSE 0 END + CAST(ordinal % 3 <> 0 AS INT) AS n FROM a_results) GROUP BY modality"""))
def _(spark, sf):
    o = F.col("ordinal")
    res = t.results(spark, sf).withColumns({
        "frame_paths": F.when(o % 4 > 0, F.array_repeat(F.lit("f"), (o % 4).cast("int"))),
        "overhead_path": F.when(o % 3 != 0, "m"),
    })
    return reports.prompt_images(res)


# --- windows ------------------------------------------------------------------


@query("n_plus_one", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN is_last THEN COALESCE(NULLIF(instruction, ''), 'Arrive at destination') ELSE COALESCE(NULLIF(nxt, ''), instruction) END AS effective_instruction,
  CASE WHEN is_last THEN 'arrival' ELSE 'n_plus_one' END AS instruction_policy, nxt AS next_instruction
FROM (SELECT *, LEAD(instruction) OVER w AS nxt, LEAD(step_index) OVER w IS NULL AS is_last FROM a_steps WINDOW w AS (PARTITION BY route_id ORDER BY step_index))"""))
def _(spark, sf):
    return routes.next_step_text(t.steps(spark, sf)).select(*STEP, "effective_instruction", "instruction_policy", "next_instruction")


@query("remaining_distance", with_views("a_steps", """
SELECT route_id, step_index, CAST(SUM(distance_m) OVER (PARTITION BY route_id ORDER BY step_index DESC) AS BIGINT) AS remaining_distance_m FROM a_steps"""))
def _(spark, sf):
    return routes.remaining_distance(t.steps(spark, sf)).select(*STEP, "remaining_distance_m")


# durations with gaps, so that some route ends have none
_TIMED = "SELECT * REPLACE (CASE WHEN pk % 3 = 0 THEN duration_s ELSE 0 END AS duration_s) FROM a_steps"


def _timed(spark, sf):
    return t.steps(spark, sf).withColumn("duration_s", F.when(F.col("pk") % 3 == 0, F.col("duration_s")).otherwise(0))


@query("remaining_duration", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN MAX(duration_s) OVER w > 0 THEN CAST(SUM(duration_s) OVER w AS BIGINT) END AS remaining_duration_s
FROM timed WINDOW w AS (PARTITION BY route_id ORDER BY step_index DESC)""", timed=_TIMED))
def _(spark, sf):
    return routes.remaining(_timed(spark, sf)).select(*STEP, "remaining_duration_s")


@query("eta_table", with_views("a_steps", """
SELECT route_id, step_index, s / 60 AS minutes_remaining, rem / CAST(1000 AS DOUBLE) AS distance_km,
  ltrim(strftime(TIMESTAMP '2024-01-01 08:00:00' + to_microseconds(CAST(floor(s * 1000000) AS BIGINT)), '%I:%M'), '0') AS arrival
FROM (SELECT *, CASE WHEN total_m > 0 AND total_s > 0 THEN total_s * (CAST(rem AS DOUBLE) / total_m) ELSE rem / CAST(1000 AS DOUBLE) / 40 * 3600 END AS s FROM (
  SELECT route_id, step_index, SUM(distance_m) OVER (PARTITION BY route_id ORDER BY step_index DESC) AS rem, CAST(SUM(distance_m) OVER (PARTITION BY route_id) AS DOUBLE) AS total_m,
    CAST(SUM(duration_s) OVER (PARTITION BY route_id) AS DOUBLE) AS total_s FROM timed))""", timed=_TIMED))
def _(spark, sf):
    steps = _timed(spark, sf)
    totals = routes.route_totals(steps.withColumn("n_frames", F.lit(0)))
    out = routes.eta_table(steps, totals, F.lit("2024-01-01 08:00:00").cast("timestamp"))
    return out.select(*STEP, "minutes_remaining", "distance_km", "arrival")


@query("eta_in_step", with_views("a_steps", """
SELECT route_id, step_index, m AS remaining_m, round_even(CASE WHEN later_max > 0 OR duration_s > 0 THEN duration_s * (1 - CAST(t AS DOUBLE) / distance_m) + CASE WHEN later_max > 0 THEN later_s ELSE 0 END
  ELSE m / 1000 / 40 * 3600 END / 60, 6) AS minutes_remaining
FROM (SELECT *, CAST(distance_m - t AS DOUBLE) + COALESCE(later_m, 0) AS m FROM (SELECT *, LEAST(distance_m, 40) AS t, SUM(distance_m) OVER w AS later_m, SUM(duration_s) OVER w AS later_s, MAX(duration_s) OVER w AS later_max
  FROM timed WINDOW w AS (PARTITION BY route_id ORDER BY step_index DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""", timed=_TIMED))
def _(spark, sf):
    into = F.least(F.col("distance_m"), F.lit(40)).cast("double")
    return routes.eta_in_step(_timed(spark, sf), into).select(
        *STEP, "remaining_m", F.bround("minutes_remaining", 6).alias("minutes_remaining")
    )


@query("prev_next_sample", with_views("a_samples", """
SELECT sample_id, LAG(sample_id) OVER (ORDER BY sample_id) AS prev_id, LEAD(sample_id) OVER (ORDER BY sample_id) AS next_id FROM a_samples"""))
def _(spark, sf):
    return with_both_neighbours(t.samples(spark, sf).select("sample_id"), ["sample_id"], "sample_id", "prev_id", "next_id").select("sample_id", "prev_id", "next_id")


@query("step_order", with_views("a_samples", """
SELECT sample_id, row_number() OVER (PARTITION BY route_id ORDER BY step_index) AS step_no, COUNT(*) OVER (PARTITION BY route_id) AS steps_total FROM a_samples"""))
def _(spark, sf):
    steps = t.samples(spark, sf).withColumn("step_index", F.when(F.col("step_index") > 0, F.col("step_index")))
    return routes.step_places(steps).select("sample_id", "step_no", "steps_total")


# --- order, limit, samples ------------------------------------------------------


@query("limit_matched", with_views("a_samples a_results", """
SELECT sample_id, row_no AS matched_no FROM (SELECT *, row_number() OVER (ORDER BY sample_id) AS row_no FROM a_samples WHERE starts_with(route_id, 'city2'))
WHERE row_no <= 120 AND COALESCE(upper(maneuver), '') <> 'ARRIVE'"""))
def _(spark, sf):
    matched = F.col("route_id").startswith("city2")
    keep = F.coalesce(F.upper("maneuver"), F.lit("")) != "ARRIVE"
    return selection.limit_matched(t.samples(spark, sf), matched, 120, keep, ["sample_id"]).select("sample_id", "matched_no")


@query("page_samples", with_views("a_samples", "SELECT sample_id, route_id FROM a_samples ORDER BY sample_id LIMIT 25 OFFSET 75"))
def _(spark, sf):
    return selection.page(t.samples(spark, sf), ["sample_id"], 3).select("sample_id", "route_id")


@query("seeded_subsample", with_views("a_samples", f"""
SELECT sample_id FROM a_samples ORDER BY {HASH.format("sample_id || '|42'")}, sample_id LIMIT 150"""))
def _(spark, sf):
    return pairwise.seeded_sample(t.samples(spark, sf), F.col("sample_id"), 150).select("sample_id")


@query("weighted_sample", with_views("a_samples a_gt", f"""
SELECT s.sample_id FROM a_samples s LEFT JOIN a_gt g USING (sample_id) ORDER BY -ln(({HASH.format("s.sample_id || '|42'")} + 1) / CAST(4294967297 AS DOUBLE)) / CASE WHEN g.sample_id IS NULL THEN 1 ELSE 3 END, s.sample_id LIMIT 150"""))
def _(spark, sf):
    gt = t.ground_truth(spark, sf).select("sample_id", F.lit(3.0).alias("w"))
    rows = t.samples(spark, sf).join(gt, "sample_id", "left")
    return pairwise.weighted_sample(rows, F.col("sample_id"), F.coalesce("w", F.lit(1.0)), 150).select("sample_id")


@query("list_routes", with_views("a_steps", """
SELECT route_id, COUNT(*) AS steps_count, CAST(SUM(distance_m) AS BIGINT) AS total_distance_m, CAST(SUM(duration_s) AS BIGINT) AS total_duration_s
FROM a_steps GROUP BY route_id"""))
def _(spark, sf):
    return reports.list_routes(t.steps(spark, sf))
