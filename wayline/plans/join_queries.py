"""Named queries: joins and set operations."""

from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import frames as fr
from wayline.functions import normalize as N
from wayline.functions.core import rows_of
from wayline.operators import frames as fop
from wayline.operators import joins, manifest, matrix, pairwise, routes, samples
from wayline.operators.ordered import cut, uncut
from wayline.plans import tables as t
from wayline.plans.frame_queries import _NAME, _STORED, _with_frames
from wayline.plans.geometry_queries import _CHUNKS, _ENCODED, _NEAR, POSE_SQL
from wayline.plans.oracle_views import with_views
from wayline.plans.registry import query
from wayline.plans.sqltext import case_of

STRINGS = "array<string>"


def _labels(spark, sf):
    """Two versions of every label; the later line holds."""
    gt = t.ground_truth(spark, sf).select("sample_id", "maneuver")
    first = gt.select("sample_id", F.lit("OLD").alias("maneuver"), F.col("sample_id").alias("line"))
    return first.unionByName(gt.withColumn("line", F.col("sample_id") + 1_000_000_000_000))


@query("join_pred_label", with_views("a_results a_gt", """
SELECT ordinal, sample_id, g.maneuver FROM a_results r JOIN a_gt g USING (sample_id)"""))
def _(spark, sf):
    preds = t.results(spark, sf).select("ordinal", "sample_id")
    return joins.predictions_with_labels(preds, _labels(spark, sf))


@query("join_pred_label_counts", with_views("a_results a_gt", """
SELECT COUNT(*) AS total_predictions, COUNT(g.sample_id) AS matched_samples, COUNT(*) - COUNT(g.sample_id) AS unmatched_samples
FROM a_results r LEFT JOIN a_gt g USING (sample_id)"""))
def _(spark, sf):
    return joins.match_counts(t.results(spark, sf), _labels(spark, sf))


FIRST = """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, model_id ORDER BY ordinal) AS rn
FROM a_results WHERE error IS NULL) WHERE rn = 1"""
# answers next to the truth of their sample
PAIRED = """
SELECT r.*, t.gt_model, t.acceptable_actions, t.known, CASE WHEN known THEN t.enhanced_instruction ELSE t.text END AS gt_enhanced_instruction,
  t.next_action AS gt_next_action, t.lane_change_required AS gt_lane_change_required, t.lanes_count AS gt_lanes_count,
  t.relevant_landmarks AS gt_relevant_landmarks, t.potential_hazards AS gt_potential_hazards
FROM first_res r JOIN (SELECT g.sample_id, g.gt_model, g.text, g.acceptable_actions, f.sample_id IS NOT NULL AS known, f.enhanced_instruction,
    f.next_action, f.lane_change_required, f.lanes_count, f.relevant_landmarks, f.potential_hazards
  FROM (SELECT sample_id, split_part(result_key, '::', 1) AS gt_model, instruction AS text, acceptable_actions FROM a_gt WHERE NOT is_auto) g
  LEFT JOIN first_res f ON f.sample_id = g.sample_id AND f.model_id = g.gt_model) t
ON t.sample_id = r.sample_id AND r.model_id <> t.gt_model"""


@query("join_gt_results", with_views("a_results a_gt", """
SELECT sample_id, model_id, gt_model, gt_enhanced_instruction, gt_next_action, gt_lanes_count FROM paired""", first_res=FIRST, paired=PAIRED))
def _(spark, sf):
    first = joins.first_results(t.results(spark, sf))
    return joins.results_with_gt(first, t.ground_truth(spark, sf)).select(
        "sample_id", "model_id", "gt_model", "gt_enhanced_instruction", "gt_next_action", "gt_lanes_count"
    )


@query("first_result_dedup", with_views("a_results", "SELECT sample_id, model_id, ordinal, modality FROM first_res", first_res=FIRST))
def _(spark, sf):
    return joins.first_results(t.results(spark, sf)).select("sample_id", "model_id", "ordinal", "modality")


@query("anti_missing_cells", with_views("a_results", """
SELECT w.ordinal FROM a_results w WHERE NOT EXISTS (SELECT 1 FROM a_results e WHERE e.error IS NULL AND e.latency_ms < 6000
  AND e.sample_id = w.sample_id AND e.model_id = w.model_id AND e.modality = w.modality
  AND COALESCE(e.variant, '') = COALESCE(w.variant, '') AND COALESCE(e.augment, '') = COALESCE(w.augment, ''))"""))
def _(spark, sf):
    wanted = t.results(spark, sf).select("ordinal", *joins.CELL)
    existing = t.results(spark, sf).where(F.col("error").isNull() & (F.col("latency_ms") < 6000))
    return joins.missing_cells(wanted, existing).select("ordinal")


@query("resume_anti", with_views("a_samples a_results", """
SELECT sample_id FROM a_samples WHERE sample_id NOT IN (SELECT sample_id FROM a_results WHERE error IS NULL)"""))
def _(spark, sf):
    return joins.pending_samples(t.samples(spark, sf), joins.kept_results(t.results(spark, sf))).select("sample_id")


@query("semi_gt_only", with_views("a_votes a_gt", """
SELECT DISTINCT ordinal, sample_id FROM a_votes WHERE sample_id IN (SELECT sample_id FROM a_gt WHERE NOT is_auto)"""))
def _(spark, sf):
    return joins.with_gt_only(t.votes(spark, sf), t.ground_truth(spark, sf)).select("ordinal", "sample_id")


def _splits(spark, sf):
    gt = t.ground_truth(spark, sf)
    k = F.col("sample_id") % 20
    return gt.select("sample_id", F.when(k < 14, "train").when(k < 17, "val").otherwise("test").alias("split"))


@query("left_split_lookup", with_views("a_samples a_gt", """
SELECT s.sample_id, CASE WHEN g.sample_id IS NULL THEN NULL WHEN g.sample_id % 20 < 14 THEN 'train' WHEN g.sample_id % 20 < 17 THEN 'val' ELSE 'test' END AS split
FROM a_samples s LEFT JOIN a_gt g USING (sample_id)"""))
def _(spark, sf):
    return joins.with_split(t.samples(spark, sf), _splits(spark, sf)).select("sample_id", "split")


@query("left_result_counts", with_views("a_samples a_results", """
SELECT s.sample_id, COALESCE(n, 0) AS result_count FROM a_samples s
LEFT JOIN (SELECT sample_id, COUNT(*) AS n FROM a_results GROUP BY sample_id) r USING (sample_id)"""))
def _(spark, sf):
    return joins.with_result_counts(t.samples(spark, sf), t.results(spark, sf)).select("sample_id", "result_count")


HASH = "CAST('0x' || left(md5({0}), 8) AS BIGINT)"
PAIRS = f"""
SELECT CASE WHEN a_first THEN x ELSE y END AS model_a, CASE WHEN a_first THEN y ELSE x END AS model_b FROM (
  SELECT a.model_id AS x, b.model_id AS y, {HASH.format("a.model_id || '|' || b.model_id || '|42'")} % 2 = 0 AS a_first
  FROM (SELECT DISTINCT model_id FROM a_results) a JOIN (SELECT DISTINCT model_id FROM a_results) b
  ON a.model_id < b.model_id AND split_part(a.model_id, '/', 1) <> split_part(b.model_id, '/', 1))"""
PAIR_COLUMNS = "model_a, model_b, split_part(model_a, '/', 1) AS company_a, split_part(model_b, '/', 1) AS company_b"


@query("cross_company_pairs", with_views("a_results", f"SELECT {PAIR_COLUMNS} FROM pairs", pairs=PAIRS))
def _(spark, sf):
    return pairwise.cross_company_pairs(t.results(spark, sf))


_RATING = "SELECT model_id, CAST(900 + COUNT(*) % 300 * 4 AS DOUBLE) AS rating FROM a_results GROUP BY model_id"


@query("elo_gap_filter", with_views("a_results", """
SELECT model_a, model_b FROM pairs JOIN rated a ON a.model_id = model_a JOIN rated b ON b.model_id = model_b WHERE abs(a.rating - b.rating) <= 200""",
    pairs=PAIRS, rated=_RATING))
def _(spark, sf):
    res = t.results(spark, sf)
    rated = res.groupBy("model_id").agg((900 + F.count("*") % 300 * 4).cast("double").alias("rating"))
    return pairwise.cross_company_pairs(res, ratings=rated, max_gap=200).select("model_a", "model_b")


@query("existing_comparison_anti", with_views("a_votes", """
SELECT DISTINCT v.ordinal FROM a_votes v WHERE NOT EXISTS (SELECT 1 FROM a_votes e WHERE e.modality = 'prior' AND e.sample_id = v.sample_id
  AND least(e.model_a, e.model_b) = least(v.model_a, v.model_b) AND greatest(e.model_a, e.model_b) = greatest(v.model_a, v.model_b))"""))
def _(spark, sf):
    votes = t.votes(spark, sf)
    judged = votes.where(F.col("modality") == "prior").select(
        "sample_id", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b")
    )
    return pairwise.unjudged(votes, judged).select("ordinal")


@query("purge_cascade", with_views("a_samples a_results a_gt", """
SELECT name, COUNT(*) FILTER (WHERE gone) AS removed, COUNT(*) FILTER (WHERE NOT gone) AS kept FROM rows GROUP BY name""",
    doomed="SELECT * FROM a_samples WHERE source = 'src3'",
    rows="""SELECT 'samples' AS name, sample_id IN (SELECT sample_id FROM doomed) AS gone FROM a_samples
    UNION ALL SELECT 'results', sample_id IN (SELECT sample_id FROM doomed) FROM a_results
    UNION ALL SELECT 'ground_truth', sample_id IN (SELECT sample_id FROM doomed) FROM a_gt
    UNION ALL SELECT 'files', route_id IN (SELECT route_id FROM doomed) FROM a_samples"""))
def _(spark, sf):
    samples = t.samples(spark, sf)
    files = samples.select(N.frame_filename(F.col("route_id"), F.col("step_index"), F.lit(40), F.lit(100)).alias("path"))
    before = {"samples": samples, "results": t.results(spark, sf), "ground_truth": t.ground_truth(spark, sf), "files": files}
    after = joins.purge(before["samples"], before["results"], before["ground_truth"], files, "src3")
    return joins.purge_counts(before, after)


@query("enrich_osm", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN pk % 2 = 0 THEN 'primary' ELSE 'old' END AS highway,
  CASE WHEN pk % 6 = 0 THEN 'N' || sk ELSE NULL END AS name, 'asphalt' AS surface, CAST(NULL AS VARCHAR) AS error FROM a_steps"""))
def _(spark, sf):
    pk = F.col("pk")
    base = t.steps(spark, sf)
    steps = base.select("route_id", "step_index", F.create_map(
        F.lit("highway"), F.lit("old"), F.lit("surface"), F.lit("asphalt")).alias("osm_road"))
    roads = base.where(pk % 2 == 0).select("route_id", "step_index", F.create_map(
        F.lit("highway"), F.lit("primary"), F.lit("_error"), F.lit("x"), F.lit("name"),
        F.when(pk % 3 == 0, F.concat(F.lit("N"), F.col("sk").cast("string"))), F.lit("surface"), F.lit(None).cast("string")).alias("tags"))
    out = joins.merge_road_tags(steps, roads, ["route_id", "step_index"])
    return out.select("route_id", "step_index", *[
        F.try_element_at("osm_road", F.lit(k)).alias(k.strip("_")) for k in ("highway", "name", "surface", "_error")])


@query("icl_example_resolve", with_views("a_samples a_gt", """
SELECT e.item_id AS sample_id, CASE WHEN s.sample_id % 3 = 0 THEN 'city file ' ELSE 'split file ' END || s.instruction AS instruction,
  g.instruction AS gt_instruction, CASE WHEN s.sample_id % 2 = 0 THEN g.next_action END AS next_action,
  CASE WHEN s.sample_id % 5 = 0 THEN NULL WHEN s.sample_id % 4 = 0 THEN 'f0' ELSE 'f2' END AS frame
FROM benchmark e JOIN a_samples s ON s.sample_id = e.item_id JOIN a_gt g ON g.sample_id = e.item_id WHERE NOT g.is_auto"""))
def _(spark, sf):
    s = F.col("sample_id")
    base = t.samples(spark, sf).select(
        "sample_id", "instruction", F.lit("map.png").alias("overhead"),
        F.when(s % 5 == 0, F.array().cast(STRINGS)).otherwise(F.array(F.lit("f0"), F.lit("f1"), F.lit("f2"))).alias("frames"),
    )
    label = lambda kind: base.withColumn("instruction", F.concat(F.lit(kind), "instruction"))
    gt = t.ground_truth(spark, sf)
    custom = gt.where(s % 2 == 0).select("sample_id", "next_action")
    examples = t.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("sample_id"), F.when(F.col("item_id") % 4 == 0, 0).alias("frame_at"))
    out = joins.resolve_examples(examples, label("city file ").where(s % 3 == 0), label("split file "), gt, custom)
    return out.select("sample_id", "instruction", "gt_instruction", "next_action", "frame")


def targets(spark, sf, empty=False):
    """Manifest target frames, one row each, and the files that are there; ``empty`` keeps a row of steps without any."""
    steps = fop.step_frame_names(_with_frames(spark, sf), "sparse4")
    every = steps.select("route_id", "step_index", "pk", F.explode_outer("names").alias("filename"))
    rows = every.where(F.col("filename").isNotNull())
    return every if empty else rows, rows.where(F.col("pk") % 3 == 0).select("filename")


TARGETS = f"""
SELECT route_id, step_index, {_NAME} AS filename, pk % 3 = 0 AS exists FROM (SELECT * FROM stored
UNION ALL SELECT DISTINCT route_id, step_index, pk, distance_m, LEAST(distance_m, w) AS rem FROM a_steps, (SELECT UNNEST([100, 80, 60, 40]) AS w) WHERE pk % 4 = 0)"""


@query("manifest_existing_files", with_views("a_steps", "SELECT route_id, step_index, filename, exists FROM targets", stored=_STORED, targets=TARGETS))
def _(spark, sf):
    rows, files = targets(spark, sf)
    return joins.existing_targets(rows, files).select("route_id", "step_index", "filename", "exists")


NAMES = """
SELECT name, arg_min(m, CASE WHEN name = m THEN '0' ELSE '1' END || m) AS registry_id FROM (
  SELECT model_id AS m, UNNEST(list_prepend(model_id, aliases)) AS name FROM a_registry) GROUP BY name"""


@query("registry_join", with_views("a_results a_registry", """
SELECT r.model_id, n.registry_id, g.display_name, COUNT(*) AS n FROM a_results r LEFT JOIN names n ON n.name = r.model_id
LEFT JOIN a_registry g ON g.model_id = n.registry_id GROUP BY ALL""", names=NAMES))
def _(spark, sf):
    counts = t.results(spark, sf).groupBy("model_id").agg(F.count("*").alias("n"))
    return joins.with_registry(counts, t.registry(spark, sf)).select("model_id", "registry_id", "display_name", "n")


@query("attach_labels", with_views("a_samples a_gt", """
SELECT sample_id, next_action, lanes_count FROM a_gt JOIN a_samples USING (sample_id)"""))
def _(spark, sf):
    labelled = t.samples(spark, sf).join(t.ground_truth(spark, sf).select("sample_id", "next_action", "lanes_count"), "sample_id")
    maps = labelled.groupBy("route_id", F.floor(F.col("step_index") / 1000).alias("part")).agg(
        F.map_from_entries(F.collect_list(F.struct("sample_id", F.struct("next_action", "lanes_count")))).alias("gt_labels")
    )
    return manifest.attach_labels(maps)


def manifest_rows(spark, sf):
    base = _with_frames(spark, sf).withColumns(
        {"maneuver": N.maneuver_type(F.col("maneuver_raw"), F.col("type_code"))}
    )
    return manifest.build_manifest(base)


@query("manifest_to_samples", with_views("a_steps", f"""
SELECT s.route_id || '_step' || format('{{:03d}}', s.step_index) AS id, s.route_id, s.step_index, s.instruction,
  CAST(SUM(s.distance_m) OVER (PARTITION BY s.route_id ORDER BY s.step_index DESC) AS BIGINT) AS remaining_distance_m, COALESCE(f.names, '') AS frames,
  'v1.0' AS dataset_version, 'manifest_download' AS source, CAST(NULL AS VARCHAR) AS overhead
FROM a_steps s LEFT JOIN (SELECT route_id, step_index, string_agg('frames/' || {_NAME}, ',' ORDER BY rem DESC) AS names FROM stored GROUP BY ALL) f USING (route_id, step_index)""", stored=_STORED))
def _(spark, sf):
    return manifest.manifest_to_samples(manifest_rows(spark, sf)).select(
        "id", "route_id", "step_index", "prior.instruction", "distances.remaining_distance_m", "dataset_version", "metadata.source", "images.overhead",
        F.array_join("images.frames", ",").alias("frames"),
    )


_SAMPLE_ORDER = """
SELECT *, LEAD(step_index) OVER w IS NULL AS is_last, LEAD(instruction) OVER w AS nxt,
  CAST(SUM(distance_m) OVER (PARTITION BY route_id ORDER BY step_index DESC) AS BIGINT) AS remaining_distance_m
FROM a_steps WINDOW w AS (PARTITION BY route_id ORDER BY step_index)"""
_FIRST_TARGET = """
SELECT DISTINCT route_id, step_index, CAST(LEAST(100, distance_m) AS DOUBLE) AS target, path_m AS total FROM a_cum"""
_ENDS = "SELECT route_id, step_index, lat AS end_lat, lng AS end_lng FROM a_points WHERE pt_idx = n_points - 1"


@query("build_samples", with_views("a_cum a_roads", f"""
SELECT s.route_id || '_step' || format('{{:03d}}', s.step_index) AS id, s.route_id, s.step_index, 'v1.0' AS dataset_version, 'train' AS split,
  CASE WHEN maneuver_raw <> '' THEN replace(upper(maneuver_raw), '-', '_') ELSE {case_of('type_code', fixed.MANEUVER_BY_CODE, "'TYPE_' || type_code")} END AS maneuver,
  COALESCE(NULLIF(CASE WHEN is_last THEN NULL ELSE nxt END, ''), CASE WHEN is_last THEN COALESCE(NULLIF(s.instruction, ''), 'Arrive at destination') ELSE s.instruction END) AS instruction,
  CAST(NULL AS VARCHAR) AS overhead,
  array_to_string(list_transform(list_filter([100, 80, 60, 40], lambda t: t <= distance_m OR t = list_min(list_filter([100, 80, 60, 40], lambda u: u >= distance_m))),
    lambda t: 'frames/' || s.route_id || '_step' || format('{{:03d}}', s.step_index) || '_' || format('{{:03d}}', CAST(distance_m - LEAST(t, distance_m) AS INT))
      || 'm_' || format('{{:03d}}', CAST(LEAST(t, distance_m) AS INT)) || 'm.jpg'), ',') AS frames,
  encoded AS step_polyline, lat_e5 / CAST(100000 AS DOUBLE) AS start_lat, lng_e5 / CAST(100000 AS DOUBLE) AS start_lng, end_lat, end_lng,
  COALESCE(round_even(q.heading, 3), 9) AS heading, distance_m AS step_distance_m, remaining_distance_m,
  r.highway, r.ref, r.maxspeed, TRY_CAST(r.lanes AS INT) AS lanes, r.surface, r.oneway = 'yes' AS oneway,
  CASE WHEN r.road_id IS NOT NULL THEN COALESCE(r.lit = 'yes', FALSE) END AS lit, CASE WHEN r.road_id IS NOT NULL THEN COALESCE(r.bridge = 'yes', FALSE) END AS bridge,
  CASE WHEN r.road_id IS NOT NULL THEN COALESCE(r.tunnel = 'yes', FALSE) END AS tunnel, r.toll = 'yes' AS toll,
  COALESCE(NULLIF(r.name, ''), CASE WHEN s.instruction <> '' THEN 'Road ' || s.sk END) AS name,
  CASE WHEN s.instruction <> '' THEN 'Road ' || s.sk ELSE '' END AS street_names, 'google' AS source, '2024-01-01' AS created_at
FROM route_order s JOIN enc USING (route_id, step_index) JOIN ends USING (route_id, step_index) LEFT JOIN poses q USING (route_id, step_index)
LEFT JOIN near n ON n.lat = round_even(lat_e5 / CAST(100000 AS DOUBLE), 5) AND n.lng = round_even(lng_e5 / CAST(100000 AS DOUBLE), 5)
LEFT JOIN a_roads r ON r.road_id = n.road_id""", near=_NEAR, chunks=_CHUNKS, enc=_ENCODED, route_order=_SAMPLE_ORDER, targets=_FIRST_TARGET, poses=POSE_SQL, ends=_ENDS))
def _(spark, sf):
    place = {"start_lat": F.col("lat_e5") / 100000.0, "start_lng": F.col("lng_e5") / 100000.0}

    def whole(rows):
        end = F.element_at("points", -1)
        return t.with_points(t.described(rows)).withColumns(place | {
            "maneuver": N.maneuver_type(F.col("maneuver_raw"), F.col("type_code")), "frames": F.lit(None).cast(f"array<{fop.FRAME}>"),
            "end_lat": end["lat"], "end_lng": end["lng"], "heading": F.lit(9.0),
        })

    # lines go through the shuffles, steps are described again behind them
    steps = cut(t.described(t.route_lines(spark, sf)).withColumns(place), ["route_id"], "step_index", whole=True)
    rows = samples.build_samples(
        steps, t.roads(spark, sf), F.lit("2024-01-01"), whole=whole, places=t.steps(spark, sf).withColumns(place))
    return rows.select(
        "id", "route_id", "step_index", "dataset_version", "split", "maneuver", "prior.*", "images.overhead", F.array_join("images.frames", ",").alias("frames"),
        *[f"geometry.{n}" for n in ("step_polyline", "start_lat", "start_lng", "end_lat", "end_lng")], F.bround("geometry.heading", 3).alias("heading"),
        "distances.*", *[f"osm_road.{n}" for n in (*samples.ROAD_FIELDS, "name")], F.array_join("osm_road.street_names", ",").alias("street_names"), "metadata.*",
    )


@query("judge_requests", with_views("a_results a_gt", """
SELECT ordinal, 'prediction' AS model, r.enhanced_instruction, len(r.relevant_landmarks) AS landmarks, '' AS reasoning FROM a_results r JOIN a_gt g USING (sample_id)
UNION ALL SELECT ordinal, 'reference', g.instruction, len(g.relevant_landmarks), 'Reference label' FROM a_results r JOIN a_gt g USING (sample_id)"""))
def _(spark, sf):
    gt = t.ground_truth(spark, sf).select(
        "sample_id", "instruction", F.col("relevant_landmarks").alias("gt_relevant_landmarks"),
        F.when(F.col("sample_id") % 2 == 0, F.col("potential_hazards")).alias("gt_potential_hazards"))
    both = t.results(spark, sf).join(gt, "sample_id").withColumn("reasoning", F.lit(None).cast("string"))
    rows = joins.judge_requests(both, F.col("instruction"), F.col("enhanced_instruction"))
    return rows.select("ordinal", "model", "enhanced_instruction", F.size("relevant_landmarks").cast("bigint").alias("landmarks"), "reasoning")


@query("union_results", with_views("a_results", """
SELECT ordinal, sample_id, model_id, CASE WHEN modality <> 'prior' THEN latency_ms END AS latency_ms, CASE WHEN modality = 'augment + prior' THEN augment END AS augment FROM a_results"""))
def _(spark, sf):
    """One file per modality, each with columns of its own and in its own order."""
    files = t.results(spark, sf)
    of = lambda modality, *columns: files.where(F.col("modality") == modality).select(*columns)
    return joins.union_results(
        of("prior", "ordinal", "sample_id", "model_id"), of("video + prior", "ordinal", "model_id", "sample_id", "latency_ms"),
        of("image + prior", "latency_ms", "ordinal", "sample_id", "model_id"), of("augment + prior", "augment", "ordinal", "sample_id", "model_id", "latency_ms"))


@query("add_competitors", with_views("a_results a_gt a_samples", """
SELECT sample_id, model_id, enhanced_instruction FROM a_results
UNION ALL SELECT sample_id, 'human/ann', instruction FROM a_gt UNION ALL SELECT sample_id, 'maps-osm/baseline', instruction FROM a_samples"""))
def _(spark, sf):
    human = t.ground_truth(spark, sf).withColumn("enhanced_instruction", F.col("instruction"))
    return joins.competitors(t.results(spark, sf), human, "ann", t.samples(spark, sf))


@query("missing_routes", with_views("a_steps a_samples", """
SELECT route_id FROM a_steps EXCEPT SELECT route_id FROM a_samples"""))
def _(spark, sf):
    return matrix.missing_routes(t.steps(spark, sf), t.samples(spark, sf))


@query("landmark_overlap_sets", with_views("a_pairs", """
SELECT conv_id, turn, len(list_intersect(p, r)) AS n_both, len(list_distinct(list_concat(p, r))) AS n_any FROM (
  SELECT conv_id, turn, list_transform(string_split(pred_text, '.'), lambda s: trim(lower(s), chr(10) || ' ')) AS p,
    list_transform(string_split(ref_text, '.'), lambda s: trim(lower(s), chr(10) || ' ')) AS r FROM a_pairs)"""))
def _(spark, sf):
    from wayline.functions.scores import overlap_sets

    both, either = overlap_sets(F.split("pred_text", "\\."), F.split("ref_text", "\\."))
    return t.pairs(spark, sf).select(
        "conv_id", "turn", F.size(both).cast("bigint").alias("n_both"), F.size(either).cast("bigint").alias("n_any")
    )
