"""Named queries: scans, sinks and streams.

Each one writes rows derived from the given tables to the shared folder and
reads them back through the library.
"""

from pyspark.sql import functions as F

from wayline import schemas
from wayline.functions import geo
from wayline.functions import normalize as N
from wayline.operators import evaluation, frames as fop, joins, manifest, routes
from wayline.operators.ordered import cut, uncut
from wayline.plans import tables as t
from wayline.plans.frame_queries import _NAME, _STORED, _framed, _with_frames
from wayline.plans.join_queries import manifest_rows
from wayline.plans.oracle_views import with_views
from wayline.plans.registry import query
from wayline.plans.score_queries import SCORE_VIEWS
from wayline.sources import readers, writers
from wayline.streaming import results as streams
from wayline.workspace import new_path

C = F.col


def _sample_rows(spark, sf):
    # frames and points are made behind the shuffles, so these move the narrow steps only
    return _stored(routes.remaining_distance(t.steps(spark, sf)))


def _stored(steps, *more):
    """Stored form of steps with the metres left on the route, and columns besides."""
    e5 = lambda c: C(c) / 100000.0
    return _framed(steps).select(
        N.sample_id(C("route_id"), C("step_index")).alias("id"), "route_id", "step_index", F.lit("v1.0").alias("dataset_version"),
        F.lit("train").alias("split"), N.maneuver_type(C("maneuver_raw"), C("type_code")).alias("maneuver"), F.struct("instruction").alias("prior"),
        F.struct(F.lit(None).cast("string").alias("overhead"), F.transform("frames", lambda f: f["filename"]).alias("frames")).alias("images"),
        F.struct(geo.encode_polyline(C("points")).alias("step_polyline"), e5("lat_e5").alias("start_lat"), e5("lng_e5").alias("start_lng")).alias("geometry"),
        F.struct(C("distance_m").cast("double").alias("step_distance_m"), C("remaining_distance_m").cast("double").alias("remaining_distance_m")).alias("distances"),
        F.struct(F.when(C("pk") % 10 == 0, "old").otherwise("new").alias("source")).alias("metadata"), *more,
    )


_SAMPLES = """
SELECT route_id || '_step' || format('{:03d}', step_index) AS id, route_id, step_index, instruction, CAST(distance_m AS DOUBLE) AS step_m,
  CAST(SUM(distance_m) OVER (PARTITION BY route_id ORDER BY step_index DESC) AS DOUBLE) AS remaining_m, pk % 4 AS n_frames, pk, sk FROM a_steps"""


@query("scan_samples", with_views("a_steps", "SELECT id, route_id, step_index, instruction, step_m, remaining_m FROM rows", rows=_SAMPLES))
def _(spark, sf):
    path = new_path(spark, "samples")
    writers.write_samples(_sample_rows(spark, sf), path)
    return readers.read_samples(spark, path).select(
        "id", "route_id", "step_index", "prior.instruction", C("distances.step_distance_m").alias("step_m"), C("distances.remaining_distance_m").alias("remaining_m"))


def _result_lines(spark, sf):
    """Result lines in a few files; some are cut, blank, or have text behind them."""
    o = C("ordinal")
    row = F.to_json(F.struct(
        F.when(o % 2 == 0, C("sample_id").cast("string")).alias("id"), F.when(o % 2 == 1, C("sample_id").cast("string")).alias("sample_id"),
        F.when(o % 19 != 0, C("model_id")).alias("model_id"), "modality", "error", "next_action", "lanes_count",
        F.when(o % 3 == 0, "true").otherwise(C("lane_change_required")).alias("lane_change_required"),
        F.struct("latency_ms", "tokens_in").alias("inference_metadata")))
    row = F.regexp_replace(row, '"lane_change_required":"true"', '"lane_change_required":true')
    line = F.when(o % 23 == 0, F.left(row, F.length(row) - 3)).when(o % 29 == 0, F.concat(row, F.lit(" {}"))).when(o % 31 == 0, "  ").otherwise(row)
    return t.results(spark, sf).select(line.alias("value"), (o % 4).alias("shard"))


@query("scan_results", with_views("a_results", """
SELECT CAST(sample_id AS VARCHAR) AS sample_id, model_id, modality, lanes_count, latency_ms, CASE WHEN ordinal % 3 = 0 THEN 'true' ELSE lane_change_required END AS lane_change
FROM a_results WHERE error IS NULL AND ordinal % 19 <> 0 AND ordinal % 23 <> 0 AND ordinal % 29 <> 0 AND ordinal % 31 <> 0"""))
def _(spark, sf):
    path = new_path(spark, "results")
    _result_lines(spark, sf).write.partitionBy("shard").text(path)
    return readers.read_results(spark, path + "/*").select(
        "sample_id", "model_id", "modality", "lanes_count", C("inference_metadata.latency_ms").alias("latency_ms"), C("lane_change_required").alias("lane_change"))


@query("scan_ground_truth", with_views("a_gt", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, result_key, 'v2 ' || instruction AS instruction FROM a_gt WHERE NOT is_auto"))
def _(spark, sf):
    gt = t.ground_truth(spark, sf).withColumn("sample_id", C("sample_id").cast("string"))
    both = gt.withColumns({"v": F.lit(1), "instruction": F.concat(F.lit("v1 "), "instruction")}).unionByName(
        gt.withColumns({"v": F.lit(2), "instruction": F.concat(F.lit("v2 "), "instruction")}))
    path = new_path(spark, "labels")
    lines = both.repartitionByRange(4, "v", "sample_id").sortWithinPartitions("v", "sample_id")
    lines.select("sample_id", "is_auto", "result_key", "instruction", "acceptable_actions").write.json(path)
    return readers.read_ground_truth(spark, path).select("sample_id", "result_key", "instruction")


# a third of the steps keeps frames, a third only sparse4_frames, a third only one frame
_LEGACY = f"""
SELECT s.route_id, s.step_index, COALESCE(f.names, '') AS frames FROM a_steps s LEFT JOIN (SELECT route_id, step_index,
  CASE WHEN pk % 3 = 2 THEN max(name) ELSE string_agg(name, ',' ORDER BY rem DESC) END AS names FROM (SELECT *, {_NAME} AS name FROM stored WHERE pk % 3 <> 2 OR rem = 100) GROUP BY route_id, step_index, pk) f USING (route_id, step_index)"""


@query("scan_manifest", with_views("a_steps", _LEGACY, stored=_STORED))
def _(spark, sf):
    k, none = C("pk") % 3, F.array().cast(f"array<{fop.FRAME}>")
    steps = _with_frames(spark, sf)
    have = F.coalesce("frames", none)
    legacy = steps.withColumns({
        "frames": F.when(k == 0, have).otherwise(none), "sparse4_frames": F.when(k == 1, have), "frame": F.when((k == 2) & (F.size(have) > 0), F.get(have, F.lit(0)))})
    fields = ["step_index", "distance_m", "frames", "sparse4_frames", "frame"]
    rows = legacy.groupBy("route_id", F.floor(C("step_index") / manifest.STEPS_PER_ROW).alias("part")).agg(F.collect_list(F.struct(*fields)).alias("steps"))
    path = new_path(spark, "manifest")
    writers.write_manifest(rows, path)
    out = readers.read_manifest(spark, path)
    return out.select("route_id", "step_index", F.array_join(F.transform("frames", lambda f: f["filename"]), ",").alias("frames"))


@query("scan_registry", with_views("a_registry", "SELECT model_id, display_name, array_to_string(aliases, '|') AS aliases, input_cost_per_mtok FROM a_registry"))
def _(spark, sf):
    path = new_path(spark, "registry")
    # one document per line and supplier group: the registry format with a list inside
    t.registry(spark, sf).select(F.array(F.struct("*")).alias("models")).write.json(path)
    return readers.read_registry(spark, path, lines=True).select("model_id", "display_name", F.array_join("aliases", "|").alias("aliases"), "input_cost_per_mtok")


@query("scan_split_config", with_views("a_gt", """
SELECT CAST(sample_id AS VARCHAR) AS sample_id, CASE WHEN sample_id % 3 = 0 THEN 'test' WHEN sample_id % 2 = 0 THEN 'val' ELSE 'train' END AS split FROM a_gt"""))
def _(spark, sf):
    s, none = C("sample_id"), F.array().cast("array<string>")
    one = lambda cond: F.when(cond, F.array(s.cast("string"))).otherwise(none)
    path = new_path(spark, "splits")
    t.ground_truth(spark, sf).select(one(F.lit(True)).alias("train"), one(s % 2 == 0).alias("val"), one(s % 3 == 0).alias("test")).write.json(path)
    return readers.read_splits(spark, path, lines=True)


@query("scan_frame_files")
def _(spark, sf):
    # the files of the given tables stand in for images
    return readers.files_per_folder(readers.list_files(spark, sf, "*.parquet")).select(
        F.regexp_replace("folder", r"^.*/", "").alias("folder"), "files", "bytes")


@query("sink_results_append", with_views("a_results", "SELECT ordinal, sample_id, model_id, modality, error FROM a_results"))
def _(spark, sf):
    path = new_path(spark, "appended")
    res = t.results(spark, sf).select("ordinal", "sample_id", "model_id", "modality", "error")
    writers.append_results(res.where(C("ordinal") % 2 == 0), path)
    writers.append_results(res.where(C("ordinal") % 2 == 1), path)
    return spark.read.schema(res.schema).json(path)


@query("sink_scores", with_views("a_results a_gt", "SELECT sample_id, model_id, gt_model, next_action, rouge_1, total FROM scores", **SCORE_VIEWS))
def _(spark, sf):
    path = new_path(spark, "scores")
    writers.write_scores(evaluation.metric_eval(t.results(spark, sf), t.ground_truth(spark, sf)), path)
    back = spark.read.schema("sample_id bigint, model_id string, gt_model string, scores struct<next_action:double,rouge_1:double,total:double>").json(path)
    return back.select("sample_id", "model_id", "gt_model", "scores.*")


@query("sink_manifest", with_views("a_steps", """
SELECT route_id, COUNT(*) AS steps_count, CAST(SUM(pk % 4) AS BIGINT) AS frames_count, string_agg(step_index, ',' ORDER BY step_index) AS step_ids FROM a_steps GROUP BY route_id"""))
def _(spark, sf):
    path = new_path(spark, "manifest")
    writers.write_manifest(manifest_rows(spark, sf), path)
    back = spark.read.schema(schemas.MANIFEST_ROUTE).json(path)
    ids = F.array_join(F.transform("steps", lambda s: s["step_index"].cast("string")), ",")
    return back.select("route_id", "steps_count", "frames_count", ids.alias("step_ids"))


@query("sink_rewrite", with_views("a_steps", "SELECT id, CASE WHEN sk % 3 = 0 THEN 'new.jpg' ELSE '' END || CASE WHEN sk % 3 <> 0 THEN CAST(n_frames AS VARCHAR) ELSE '' END AS frames FROM rows WHERE pk % 10 <> 0", rows=_SAMPLES))
def _(spark, sf):
    # lines go through the shuffle and meet the new frames there, steps are described again and stored behind that
    own, route = N.sample_id(C("route_id"), C("step_index")).alias("id"), t.route_key(C("route_id")).alias("route")
    steps = cut(t.described(t.route_lines(spark, sf)), ["route_id"], "step_index", whole=True)
    rest = uncut(routes.remaining_distance(steps)).select(own, route, *t.LINE, "remaining_distance_m")
    fresh = steps.where(C("sk") % 3 == 0).select(own, route, F.array(F.lit("new.jpg")).alias("new_frames"))
    stored = lambda rows: _stored(t.described(rows, t.route_of_key(C("route"))), "new_frames")
    samples = writers.with_new_frames(rest, fresh, whole=stored, place="route")
    path = new_path(spark, "rewritten")
    writers.write_rewritten(samples.where(C("metadata.source") != "old"), path)
    frames = F.coalesce("images.frames", F.array().cast("array<string>"))
    shown = F.when(F.get(frames, F.lit(0)) == "new.jpg", "new.jpg").otherwise(F.size(frames).cast("string"))
    return readers.read_samples(spark, path).select("id", shown.alias("frames"))


_FILENAMES = "SELECT DISTINCT sample_id, 'results_' || replace(model_id, '/', '_') || CASE modality WHEN 'video + prior' THEN '_video_prior_normal' WHEN 'image + prior' THEN '_image_prior_normal' WHEN 'prior' THEN '_prior_only' ELSE '_video_prior_augmented_fog' END || '.jsonl' AS file FROM a_results"


@query("detect_modality", with_views("a_results", """
SELECT sample_id, CASE WHEN bool_or(contains(file, '_augmented_')) THEN 'augmented' WHEN bool_or(contains(file, '_video_prior')) THEN 'video_prior'
  WHEN bool_or(contains(file, '_image_prior_normal')) THEN 'image_prior' WHEN bool_or(contains(file, '_prior_only')) THEN 'prior_only' END AS modality FROM files GROUP BY sample_id""", files=_FILENAMES))
def _(spark, sf):
    tail = (
        F.when(C("modality") == "video + prior", "_video_prior_normal").when(C("modality") == "image + prior", "_image_prior_normal")
        .when(C("modality") == "prior", "_prior_only").otherwise("_video_prior_augmented_fog"))
    name = F.concat(F.lit("results_"), F.replace("model_id", F.lit("/"), F.lit("_")), tail, F.lit(".jsonl"))
    files = t.results(spark, sf).select("sample_id", name.alias("file")).distinct()
    return joins.modality_of_files(files, by=["sample_id"])


# --- streams ---------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = t.table(spark, sf, "events").schema
    return t.results_of(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))


def _truth(spark, sf):
    gt = t.ground_truth(spark, sf)
    fields = ["next_action", "lane_change_required", "lanes_count", "relevant_landmarks", "potential_hazards"]
    return gt.select("sample_id", "acceptable_actions", C("instruction").alias("gt_enhanced_instruction"), *[C(f).alias(f"gt_{f}") for f in fields])


@query("stream_scores", with_views("a_results a_gt", """
SELECT r.ordinal, r.sample_id, r.model_id, CASE WHEN r.next_action = g.next_action OR list_contains(list_transform(g.acceptable_actions, lambda x: trim(lower(x))), r.next_action) THEN CAST(1 AS DOUBLE) ELSE 0 END AS next_action_strict,
  CASE WHEN g.lanes_count IS NULL THEN NULL WHEN COALESCE(r.lanes_count = g.lanes_count, FALSE) THEN CAST(1 AS DOUBLE) ELSE 0 END AS lanes_count_exact
FROM a_results r JOIN a_gt g USING (sample_id) WHERE r.error IS NULL"""))
def _(spark, sf):
    scored = streams.scored_stream(_event_stream(spark, sf), _truth(spark, sf)).select(
        "ordinal", "sample_id", "model_id", "next_action_strict", "lanes_count_exact")
    path = new_path(spark, "stream-scores")
    streams.run_available(scored, path, new_path(spark, "stream-scores-state"))
    return spark.read.schema(scored.schema).parquet(path)


@query("stream_dedup", with_views("a_results", """
SELECT DISTINCT sample_id, model_id, modality, NULLIF(variant, '') AS variant, NULLIF(augment, '') AS augment FROM a_results"""))
def _(spark, sf):
    # dealt over files that are read in four batches, so that repeats are late and lie in different batches
    events, parts = t.table(spark, sf, "events"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_path(spark, "stream-events")
    events.repartition(parts).write.parquet(folder)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-parts // 4)).parquet(folder)
    unique = streams.unique_stream(t.results_of(arriving)).select(*joins.CELL)
    path = new_path(spark, "stream-unique")
    streams.run_available(unique, path, new_path(spark, "stream-unique-state"))
    return spark.read.schema(unique.schema).parquet(path)
