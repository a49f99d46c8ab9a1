"""Named queries: projections, filters and normalisation."""

from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import normalize as N
from wayline.functions.core import rows_of
from wayline.operators import routes, selection
from wayline.plans import tables as t
from wayline.plans.oracle_views import with_views
from wayline.plans.registry import query
from wayline.plans.sqltext import case_of, in_list, strip_sql

KEY = ["route_id", "step_index"]


_BARE = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(?:div|br|p|span)[^>]*>', ' ', 'g'), "
    "'<[^>]+>', '', 'g'), ' {2,}', ' ', 'g')"
)


@query("strip_html", f"SELECT page_id, {strip_sql(_BARE)} AS clean_text FROM pages")
def _(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", N.strip_html(F.col("html")).alias("clean_text"))


@query("maneuver_type", with_views("a_steps", f"""
SELECT route_id, step_index, CASE WHEN maneuver_raw <> '' THEN replace(upper(maneuver_raw), '-', '_')
  ELSE {case_of('type_code', fixed.MANEUVER_BY_CODE, "'TYPE_' || type_code")} END AS maneuver
FROM a_steps"""))
def _(spark, sf):
    return t.steps(spark, sf).select(
        *KEY, N.maneuver_type(F.col("maneuver_raw"), F.col("type_code")).alias("maneuver")
    )


@query("maneuver_code", with_views("a_steps", f"""
SELECT route_id, step_index, CAST({case_of('maneuver_raw', fixed.CODE_BY_MANEUVER, '8')} AS INT) AS code FROM a_steps"""))
def _(spark, sf):
    return t.steps(spark, sf).select(*KEY, N.maneuver_code(F.col("maneuver_raw")).alias("code"))


@query("expected_action", with_views("a_gt", f"""
SELECT sample_id, {case_of('trim(upper(maneuver))', fixed.ACTION_BY_MANEUVER, "replace(lower(trim(maneuver)), ' ', '_')")} AS action FROM a_gt"""))
def _(spark, sf):
    return t.ground_truth(spark, sf).select(
        "sample_id", N.expected_action(F.col("maneuver")).alias("action")
    )


# instructions with every kind of marker and terminator, by supplier and part
def _instructions(spark, sf):
    pk, text = F.col("pk"), F.col("sk").cast("string")
    return t.steps(spark, sf).withColumn(
        "text",
        F.when(pk % 6 == 0, F.concat(F.lit("Turn left onto A"), text, F.lit("/B Rd toward City, then on")))
        .when(pk % 6 == 1, F.concat(F.lit("Continue on M"), text, F.lit(". Partial toll road")))
        .when(pk % 6 == 2, F.concat(F.lit("Keep right Onto Long St and merge, "), text))
        .when(pk % 6 == 3, F.lit("Head north"))
        .when(pk % 6 == 4, F.concat(F.lit("Turn on X/"), text, F.lit(" Partial toll")))
        .otherwise(F.concat(F.lit("Merge onto Highway "), text, F.lit("."))),
    )


_INSTR = """
SELECT *, CASE pk % 6 WHEN 0 THEN 'Turn left onto A' || sk || '/B Rd toward City, then on'
  WHEN 1 THEN 'Continue on M' || sk || '. Partial toll road'
  WHEN 2 THEN 'Keep right Onto Long St and merge, ' || sk WHEN 3 THEN 'Head north'
  WHEN 4 THEN 'Turn on X/' || sk || ' Partial toll' ELSE 'Merge onto Highway ' || sk || '.' END AS text
FROM a_steps"""
_AFTER = """
SELECT *, CASE WHEN instr(lower(text), ' onto ') > 0 THEN trim(substr(text, instr(lower(text), ' onto ') + 6))
  WHEN instr(lower(text), ' on ') > 0 THEN trim(substr(text, instr(lower(text), ' on ') + 4)) END AS rest FROM instrs"""
_NAMES = """
SELECT *, list_filter(list_transform(string_split(COALESCE(CASE
  WHEN contains(rest, ' toward ') THEN trim(split_part(rest, ' toward ', 1))
  WHEN contains(rest, ' then ') THEN trim(split_part(rest, ' then ', 1))
  WHEN contains(rest, ' and ') THEN trim(split_part(rest, ' and ', 1))
  WHEN contains(rest, '.') THEN trim(split_part(rest, '.', 1))
  WHEN contains(rest, ',') THEN trim(split_part(rest, ',', 1))
  WHEN contains(rest, 'Partial') THEN trim(split_part(rest, 'Partial', 1))
  WHEN contains(rest, 'partial') THEN trim(split_part(rest, 'partial', 1)) ELSE rest END, ''), '/'),
  lambda n: trim(n)), lambda n: length(n) > 1) AS names FROM after"""


@query("street_names", with_views("a_steps", """
SELECT route_id, step_index, text, array_to_string(names, '|') AS street_names FROM named""",
    instrs=_INSTR, after=_AFTER, named=_NAMES))
def _(spark, sf):
    return _instructions(spark, sf).select(
        *KEY, "text", F.array_join(N.street_names(F.col("text")), "|").alias("street_names")
    )


@query("road_name_fallback", with_views("a_steps", """
SELECT route_id, step_index, COALESCE(CASE WHEN pk % 5 = 0 THEN 'Osm Road' WHEN pk % 5 = 1 THEN NULL END,
  CASE WHEN pk % 7 <> 0 THEN names[1] END, rtrim(rest, '.')) AS road_name FROM named""",
    instrs=_INSTR, after=_AFTER, named=_NAMES))
def _(spark, sf):
    pk = F.col("pk")
    names = F.when(pk % 7 == 0, F.array().cast("array<string>")).otherwise(N.street_names(F.col("text")))
    osm = F.when(pk % 5 == 0, "Osm Road").when(pk % 5 == 2, "")
    return _instructions(spark, sf).select(
        *KEY, N.road_name(osm, names, F.col("text")).alias("road_name")
    )


@query("lane_change_norm", with_views("a_results", """
SELECT ordinal, CASE WHEN ordinal % 10 = 3 THEN TRUE WHEN lane_change_required IS NULL THEN NULL
  ELSE lower(trim(lane_change_required)) = 'yes' END AS lane_change FROM a_results"""))
def _(spark, sf):
    value = F.when(F.col("ordinal") % 10 == 3, "true").otherwise(
        F.concat(F.lit(" "), F.upper("lane_change_required"))
    )
    return t.results(spark, sf).select("ordinal", N.lane_change_flag(value).alias("lane_change"))


@query("highway_flag", with_views("a_steps", f"""
SELECT route_id, step_index, {' OR '.join(f"contains(lower(text), '{k}')" for k in fixed.HIGHWAY_KEYWORDS)}
  OR COALESCE(maneuver_raw IN {in_list(fixed.HIGHWAY_MANEUVERS)}, FALSE) AS highway FROM instrs""", instrs=_INSTR))
def _(spark, sf):
    return _instructions(spark, sf).select(
        *KEY, N.highway_flag(F.col("text"), F.col("maneuver_raw")).alias("highway")
    )


@query("continue_text", with_views("a_steps", """
SELECT route_id, step_index, 'Continue for ' || CASE WHEN m < 100 THEN m || ' meters.'
  WHEN m < 1000 THEN (m // 10) * 10 || ' meters.'
  WHEN m < 10000 THEN format('{:.1f}', m / CAST(1000 AS DOUBLE)) || ' kilometers.'
  ELSE m // 1000 || ' kilometers.' END AS text
FROM (SELECT route_id, step_index, CAST(distance_m * (pk % 20) AS BIGINT) AS m FROM a_steps)"""))
def _(spark, sf):
    metres = F.col("distance_m") * (F.col("pk") % 20)
    return t.steps(spark, sf).select(*KEY, N.continue_text(metres).alias("text"))


@query("parse_duration", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN pk % 4 IN (0, 1) THEN duration_s ELSE 0 END AS seconds FROM a_steps"""))
def _(spark, sf):
    d = F.col("duration_s").cast("string")
    text = (
        F.when(F.col("pk") % 4 == 0, F.concat(d, F.lit("s"))).when(F.col("pk") % 4 == 1, F.concat(F.lit(" "), d, F.lit("s")))
        .when(F.col("pk") % 4 == 2, d).otherwise(F.lit("soon s"))
    )
    return t.steps(spark, sf).select(*KEY, N.parse_duration(text).alias("seconds"))


@query("to_metres", with_views("a_steps", """
SELECT route_id, step_index, CASE pk % 6 WHEN 0 THEN distance_m / CAST(10 AS DOUBLE) * 1000 WHEN 1 THEN distance_m
  WHEN 2 THEN distance_m WHEN 3 THEN distance_m + CAST(0.5 AS DOUBLE) WHEN 4 THEN NULL
  ELSE CAST(distance_m AS DOUBLE) END AS metres FROM a_steps"""))
def _(spark, sf):
    d, k = F.col("distance_m").cast("string"), F.col("pk") % 6
    tenth = F.concat(F.floor(F.col("distance_m") / 10).cast("string"), F.lit("."), (F.col("distance_m") % 10).cast("string"))
    text = (
        F.when(k == 0, F.concat(tenth, F.lit(" KM"))).when(k == 1, F.concat(d, F.lit(" meters")))
        .when(k == 2, F.concat(F.lit(" "), d, F.lit("Metres "))).when(k == 3, F.concat(d, F.lit(".5")))
        .when(k == 4, F.lit("far away")).otherwise(F.concat(d, F.lit("m")))
    )
    return t.steps(spark, sf).select(*KEY, N.to_metres(text).alias("metres"))


@query("format_distance", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN m IS NULL THEN '--' WHEN m < 1000 THEN CAST(round_even(m, 0) AS BIGINT) || ' m'
  WHEN m / 1000 > 1e9 THEN '>>> km' WHEN m / 1000 < 10 THEN format('{:.1f}', m / 1000) || ' km'
  ELSE CAST(round_even(m / 1000, 0) AS BIGINT) || ' km' END AS text
FROM (SELECT route_id, step_index, CASE WHEN pk % 8 = 0 THEN NULL WHEN pk % 8 = 1 THEN 1e13
  ELSE distance_m * CAST(pk % 16 AS DOUBLE) / CAST(2 AS DOUBLE) END AS m FROM a_steps)"""))
def _(spark, sf):
    pk = F.col("pk")
    m = F.when(pk % 8 == 0, F.lit(None)).when(pk % 8 == 1, F.lit(1e13)).otherwise(
        F.col("distance_m") * (pk % 16).cast("double") / 2.0
    )
    return t.steps(spark, sf).select(*KEY, N.format_distance(m).alias("text"))


@query("format_eta", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN x IS NULL THEN '--' WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN m // 60 || 'h'
  ELSE m // 60 || 'h ' || m % 60 || 'm' END AS text
FROM (SELECT *, GREATEST(0, CAST(round_even(x, 0) AS BIGINT)) AS m FROM (SELECT route_id, step_index,
  CASE WHEN pk % 9 <> 0 THEN (duration_s - 20) * CAST(pk % 9 AS DOUBLE) / CAST(2 AS DOUBLE) END AS x FROM a_steps))"""))
def _(spark, sf):
    pk = F.col("pk")
    minutes = F.when(pk % 9 != 0, (F.col("duration_s") - 20) * (pk % 9).cast("double") / 2.0)
    return t.steps(spark, sf).select(*KEY, N.format_eta(minutes).alias("text"))


@query("sample_id_build", with_views("a_steps", """
SELECT route_id, step_index, route_id || '_step' || format('{:03d}', step_index) AS id,
  route_id || '_step' || format('{:03d}', step_index) || '_map.png' AS map_name FROM a_steps"""))
def _(spark, sf):
    return t.steps(spark, sf).select(
        *KEY, N.sample_id(*map(F.col, KEY)).alias("id"), N.map_filename(*map(F.col, KEY)).alias("map_name")
    )


_FRAME_NAMES = """
SELECT *, route_id || '_step' || format('{:03d}', step_index) || '_' || format('{:03d}', GREATEST(0, distance_m - rem))
  || 'm_' || format('{:03d}', rem) || 'm' || CASE pk % 3 WHEN 0 THEN '_fog' ELSE '' END || '.jpg' AS frame_name
FROM (SELECT *, CAST(pk % 200 AS INT) AS rem FROM a_steps)"""


def _frame_names(spark, sf):
    pk = F.col("pk")
    aug = F.when(pk % 3 == 0, "fog").when(pk % 3 == 1, "")
    return t.steps(spark, sf).withColumn("rem", (pk % 200).cast("int")).withColumn(
        "frame_name",
        N.frame_filename(F.col("route_id"), F.col("step_index"), F.col("rem"), F.col("distance_m"), aug),
    )


@query("frame_filename_build", with_views("a_steps", "SELECT route_id, step_index, frame_name FROM frames", frames=_FRAME_NAMES))
def _(spark, sf):
    return _frame_names(spark, sf).select(*KEY, "frame_name")


@query("frame_filename_parse", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN pk % 5 = 0 THEN 0 ELSE GREATEST(0, distance_m - rem) END AS into_m,
  CASE WHEN pk % 5 = 0 THEN 0 ELSE rem END AS remaining_m FROM frames""", frames=_FRAME_NAMES))
def _(spark, sf):
    name = F.when(F.col("pk") % 5 == 0, F.regexp_replace("frame_name", "_step0", "_step")).otherwise(
        F.concat(F.lit("frames/"), F.col("frame_name"))
    )
    parsed = _frame_names(spark, sf).withColumn("parsed", N.parse_frame_filename(name))
    return parsed.select(
        *KEY, F.col("parsed.distance_into_step_m").alias("into_m"), F.col("parsed.remaining_m").alias("remaining_m")
    )


@query("slugify", """
SELECT doc_id, left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 40) AS slug FROM documents""")
def _(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", N.slugify(F.col("text")).alias("slug"))


@query("city_of_sample", with_views("a_samples", """
SELECT sample_id, COALESCE(city, split_part(route_id || '_step', '_route', 1)) AS city FROM a_samples"""))
def _(spark, sf):
    return t.samples(spark, sf).select(
        "sample_id", N.city_of_sample(F.col("city"), F.concat("route_id", F.lit("_step"))).alias("city")
    )


@query("company_of_model", with_views("a_results", """
SELECT company, COUNT(*) AS n FROM (SELECT lower(split_part(upper(model_id), '/', 1)) AS company FROM a_results) GROUP BY company"""))
def _(spark, sf):
    company = N.company_of_model(F.upper("model_id")).alias("company")
    return t.results(spark, sf).groupBy(company).agg(F.count("*").alias("n"))


@query("model_display_name", with_views("a_results", """
SELECT ordinal, 'm' || (split_part(model_id, '/m', 2)) || CASE ordinal % 4 WHEN 0 THEN '' WHEN 1 THEN '-mini' WHEN 2 THEN '' ELSE '-beta-x' END AS name FROM a_results"""))
def _(spark, sf):
    o = F.col("ordinal")
    tail = F.when(o % 4 == 0, "-Instruct").when(o % 4 == 1, "-mini").when(o % 4 == 2, "-beta-preview").otherwise("-beta-x")
    return t.results(spark, sf).select(
        "ordinal", N.model_display_name(F.concat("model_id", tail)).alias("name")
    )


_RAW = """
SELECT ordinal, enhanced_instruction AS prior, CASE ordinal % 6
  WHEN 0 THEN '{"enhanced_instruction": "Turn ' || ordinal || '", "lane_change_required": true, "lanes_count": 3, "next_action": "turn_left", "relevant_landmarks": ["a", "b"], "reasoning": "r"}'
  WHEN 1 THEN '```json' || chr(10) || '{"enhanced_instruction": "X", "lane_change_required": "yes"}' || chr(10) || '```'
  WHEN 2 THEN '<think>{"a": 1}' || chr(10) || '</think>  {"next_action": "uturn", "potential_hazards": ["ice"]}'
  WHEN 3 THEN 'answer: {"enhanced_instruction": "A"} and {"b": 2}'
  WHEN 4 THEN 'no object at all' ELSE '{"enhanced_instruction": "cut' END AS raw_response FROM a_results"""


def _raw_responses(spark, sf):
    o = F.col("ordinal")
    raw = (
        F.when(o % 6 == 0, F.concat(
            F.lit('{"enhanced_instruction": "Turn '), o.cast("string"),
            F.lit('", "lane_change_required": true, "lanes_count": 3, "next_action": "turn_left", '
                  '"relevant_landmarks": ["a", "b"], "reasoning": "r"}')))
        .when(o % 6 == 1, '```json\n{"enhanced_instruction": "X", "lane_change_required": "yes"}\n```')
        .when(o % 6 == 2, '<think>{"a": 1}\n</think>  {"next_action": "uturn", "potential_hazards": ["ice"]}')
        .when(o % 6 == 3, 'answer: {"enhanced_instruction": "A"} and {"b": 2}')
        .when(o % 6 == 4, "no object at all").otherwise('{"enhanced_instruction": "cut')
    )
    return t.results(spark, sf).select("ordinal", F.col("enhanced_instruction").alias("prior"), raw.alias("raw_response"))


@query("response_normalise", with_views("a_results", """
SELECT ordinal, COALESCE(j ->> 'enhanced_instruction', prior) AS enhanced_instruction,
  COALESCE(j ->> 'lane_change_required', 'no') AS lane_change_required, CAST(j ->> 'lanes_count' AS INT) AS lanes_count,
  COALESCE(j ->> 'next_action', 'unknown') AS next_action,
  COALESCE(array_to_string(CAST(j -> 'relevant_landmarks' AS VARCHAR[]), '|'), '') AS relevant_landmarks,
  COALESCE(array_to_string(CAST(j -> 'potential_hazards' AS VARCHAR[]), '|'), '') AS potential_hazards
FROM (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM (SELECT *, regexp_extract(
  regexp_replace(raw_response, '(?s)<think>.*?</think>', '', 'g'), '(?s)(\\{.*\\})', 1) AS body FROM raws))""", raws=_RAW))
def _(spark, sf):
    fields = N.response_fields(F.col("raw_response"), F.col("prior")).alias("f")
    return _raw_responses(spark, sf).select("ordinal", fields).select(
        "ordinal", "f.enhanced_instruction", "f.lane_change_required", "f.lanes_count", "f.next_action",
        F.array_join("f.relevant_landmarks", "|").alias("relevant_landmarks"),
        F.array_join("f.potential_hazards", "|").alias("potential_hazards"),
    )


@query("validate_results", with_views("a_results", f"""
SELECT ordinal, bad_augment, augment_with_prior, bad_confidence, bad_modality FROM (SELECT ordinal,
  COALESCE(augment NOT IN {in_list(fixed.AUGMENTS)}, FALSE) AS bad_augment,
  COALESCE(augment, '') <> '' AND modality = 'prior' AS augment_with_prior,
  confidence < 0 OR confidence > 1 AS bad_confidence,
  modality NOT IN {in_list(fixed.MODALITIES)} AS bad_modality FROM a_results)
WHERE bad_augment OR augment_with_prior OR bad_confidence OR bad_modality"""))
def _(spark, sf):
    return selection.invalid_results(t.results(spark, sf)).select(
        "ordinal", "bad_augment", "augment_with_prior", "bad_confidence", "bad_modality"
    )


@query("filter_route_or_id", with_views("a_samples", """
SELECT sample_id, route_id FROM a_samples WHERE starts_with(route_id, 'city1_route1') OR starts_with(route_id, 'city3_route')"""))
def _(spark, sf):
    return selection.in_routes(t.samples(spark, sf), ["city1_route1", "city3_route"], id_col="route_id").select(
        "sample_id", "route_id"
    )


@query("filter_modality_files", with_views("a_results", """
SELECT ordinal, file FROM files WHERE file IN (SELECT file FROM (SELECT file, arg_min(modality, ordinal) AS m FROM files GROUP BY file) WHERE m = 'prior')""",
    files="SELECT *, 'results_' || (user_id // 3) || '.jsonl' AS file FROM a_results JOIN (SELECT event_id, user_id FROM events) ON event_id = ordinal"))
def _(spark, sf):
    users = t.table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), "user_id")
    files = t.results(spark, sf).join(users, "ordinal").withColumn(
        "file", F.concat(F.lit("results_"), F.floor(F.col("user_id") / 3).cast("string"), F.lit(".jsonl"))
    )
    return selection.files_of_modality(files, "prior").select("ordinal", "file")


@query("sample_search", with_views("a_samples", """
SELECT sample_id FROM a_samples WHERE COALESCE(city, split_part(route_id, '_route', 1)) = 'city2' AND maneuver = 'KEEP_RIGHT'
  AND (contains(lower(route_id), 'then en') OR contains(lower(instruction), 'then en'))"""))
def _(spark, sf):
    return selection.search(
        t.samples(spark, sf), city="city2", maneuver="KEEP_RIGHT", text="Then EN", id_col="route_id"
    ).select("sample_id")


@query("skip_arrive", with_views("a_samples", """
SELECT sample_id FROM a_samples WHERE COALESCE(upper(maneuver), '') <> 'ARRIVE'"""))
def _(spark, sf):
    return selection.without_arrivals(t.samples(spark, sf)).select("sample_id")


@query("split_latlon", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN pk % 4 < 3 THEN lat_e5 / CAST(100000 AS DOUBLE) END AS lat,
  CASE WHEN pk % 4 < 3 THEN lng_e5 / CAST(100000 AS DOUBLE) END AS lng FROM a_steps"""))
def _(spark, sf):
    number = lambda c: (F.col(c).cast("double") / 100000.0).cast("string")
    mark = F.when(F.col("pk") % 4 == 0, ",").when(F.col("pk") % 4 == 1, " ; ").when(F.col("pk") % 4 == 2, "  ").otherwise(",1,")
    text = F.concat(number("lat_e5"), mark, number("lng_e5"))
    return t.steps(spark, sf).withColumn("p", N.split_latlon(text)).select(*KEY, "p.lat", "p.lng")


@query("nav_fields", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN maneuver_raw <> '' THEN maneuver_raw WHEN pk % 3 = 0 THEN 'step-' || pk % 3
  ELSE 'MANEUVER_UNSPECIFIED' END AS nav_maneuver,
  CASE WHEN instruction <> '' THEN instruction WHEN pk % 5 = 0 THEN 'own text' ELSE 'next text' END AS nav_instruction,
  CAST(CASE WHEN pk % 7 > 0 THEN pk % 7 WHEN sk % 7 > 0 THEN sk % 7 ELSE distance_m END AS DOUBLE) AS nav_metres FROM a_steps"""))
def _(spark, sf):
    pk = F.col("pk")
    fields = N.nav_fields(
        F.col("instruction"), F.when(pk % 5 == 0, "own text").otherwise(""), F.lit("next text"),
        F.col("maneuver_raw"), F.when(pk % 3 == 0, "step-0"),
        (pk % 7).cast("double"), (F.col("sk") % 7).cast("double"), F.col("distance_m").cast("double"),
    )
    return t.steps(spark, sf).select(*KEY, *[c.alias(n) for n, c in fields.items()])


@query("sample_lookup", with_views("a_samples a_results a_gt", """
SELECT s.sample_id, s.route_id, r.n_results, g.instruction AS gt_instruction
FROM a_samples s LEFT JOIN (SELECT sample_id, COUNT(*) AS n_results FROM a_results GROUP BY sample_id) r USING (sample_id)
LEFT JOIN a_gt g USING (sample_id) WHERE s.sample_id IN (SELECT item_id FROM benchmark)"""))
def _(spark, sf):
    ids = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("sample_id"))
    return selection.lookup_samples(
        t.samples(spark, sf), t.results(spark, sf), t.ground_truth(spark, sf), ids
    ).select("sample_id", "route_id", "n_results", "gt_instruction")


_FRAMELISTS = """
SELECT route_id, step_index, pk, distance_m, modality, augment, i, 'frames/' || route_id || '_' || step_index || '_' || i || '.jpg' AS path, n
FROM (SELECT *, CASE pk % 3 WHEN 0 THEN 'video + prior' WHEN 1 THEN 'image + prior' ELSE 'prior' END AS modality,
  CASE WHEN pk % 5 = 0 THEN 'fog' END AS augment, CAST(pk % 4 AS INT) AS n FROM a_steps), LATERAL (SELECT UNNEST(range(0, n)) AS i) x"""


@query("select_frames", with_views("a_steps", """
SELECT s.route_id, s.step_index, CAST(COALESCE(k.n_selected, 0) AS BIGINT) AS n_selected, CAST(COALESCE(k.n_existing, 0) AS BIGINT) AS n_existing,
  (s.pk % 6 <> 0) AND (s.pk % 3 = 2 OR COALESCE(k.n_existing, 0) >= CASE WHEN s.pk % 3 = 0 AND s.pk % 5 <> 0 THEN 2 ELSE 1 END) AS runnable
FROM a_steps s LEFT JOIN (SELECT route_id, step_index, COUNT(*) AS n_selected, COUNT(*) FILTER (WHERE (pk + i) % 3 <> 0) AS n_existing
  FROM lists WHERE modality <> 'prior' AND (i = n - 1 OR NOT (modality = 'image + prior' OR augment IS NOT NULL)) GROUP BY ALL) k
USING (route_id, step_index)""", lists=_FRAMELISTS))
def _(spark, sf):
    pk = F.col("pk")
    name = lambda i: F.concat(
        F.lit("frames/"), F.col("route_id"), F.lit("_"), F.col("step_index").cast("string"),
        F.lit("_"), i.cast("string"), F.lit(".jpg"))
    base = t.steps(spark, sf).select(
        *KEY, "pk",
        F.when(pk % 3 == 0, "video + prior").when(pk % 3 == 1, "image + prior").otherwise("prior").alias("modality"),
        F.when(pk % 5 == 0, "fog").alias("augment"),
        F.slice(F.array(*[name(F.lit(i)) for i in range(3)]), F.lit(1), (pk % 4).cast("int")).alias("frames"),
        F.concat(F.lit("maps/"), F.col("route_id"), F.lit("_"), F.col("step_index").cast("string")).alias("overhead"),
    )
    # the map of a step stands behind its frames
    stored = rows_of(base.withColumn("paths", F.concat("frames", F.array("overhead"))), ["pk"], "paths", "i", "path")
    files = stored.where(F.when(F.col("i") < pk % 4, (pk + F.col("i")) % 3 != 0).otherwise(pk % 6 != 0)).select("path")
    return selection.select_frames(base, files, KEY).select(*KEY, "n_selected", "n_existing", "runnable")


@query("route_defaults", with_views("a_steps", """
SELECT route_id, step_index, CASE WHEN pk % 3 = 0 THEN '' ELSE 'enc' || pk END AS polyline,
  CASE WHEN pk % 4 = 0 THEN '' ELSE instruction END AS instruction, CASE WHEN pk % 4 = 0 THEN 8 ELSE type_code END AS type_code,
  CASE WHEN pk % 5 <> 0 THEN CAST(lat_e5 AS DOUBLE) END AS start_lat FROM a_steps"""))
def _(spark, sf):
    pk, null = F.col("pk"), F.lit(None)
    nested = t.steps(spark, sf).select(
        *KEY,
        F.when(pk % 3 != 0, F.struct(F.concat(F.lit("enc"), pk.cast("string")).alias("encodedPolyline"))).alias("polyline"),
        F.when(pk % 4 != 0, F.struct("instruction", F.col("type_code").alias("type"))).alias("navigationInstruction"),
        F.when(pk % 5 != 0, F.struct(F.col("lat_e5").cast("double").alias("latitude"), F.col("lng_e5").cast("double").alias("longitude")))
        .alias("startLocation"),
    )
    return routes.fill_step_defaults(nested).select(
        *KEY, F.col("polyline.encodedPolyline").alias("polyline"), F.col("navigationInstruction.instruction").alias("instruction"),
        F.col("navigationInstruction.type").alias("type_code"), F.col("startLocation.latitude").alias("start_lat"),
    )


@query("route_normalise", with_views("a_steps a_points a_segments", f"""
SELECT s.route_id, CAST(s.pk % 2 AS INT) AS leg_index, s.step_index AS maneuver_index, s.distance_m, s.duration_s || 's' AS static_duration,
  CASE WHEN s.rf = 'N' THEN '' ELSE 'Turn ' || LOWER(s.rf) || ' onto Road ' || s.sk END AS instruction,
  CAST({case_of('s.maneuver_raw', fixed.CODE_BY_MANEUVER, '8')} AS INT) AS maneuver_code,
  CAST(COALESCE(f.bearing, 0) AS DOUBLE) - CAST(COALESCE(f.bearing, 0) AS DOUBLE) % 1 AS bearing_after,
  CAST(COALESCE(l.bearing, 0) AS DOUBLE) - CAST(COALESCE(l.bearing, 0) AS DOUBLE) % 1 AS bearing_before,
  CASE WHEN s.rf <> 'N' THEN 'Road ' || s.sk ELSE '' END AS street_names,
  COALESCE(s.maneuver_raw IN {in_list(fixed.HIGHWAY_MANEUVERS)}, FALSE) AS highway
FROM a_steps s
LEFT JOIN (SELECT route_id, step_index, arg_min(bearing, pt_idx) AS bearing FROM a_segments GROUP BY ALL) f USING (route_id, step_index)
LEFT JOIN (SELECT route_id, step_index, arg_max(bearing, pt_idx) AS bearing FROM a_segments GROUP BY ALL) l USING (route_id, step_index)"""))
def _(spark, sf):
    from wayline.functions import geo

    located = t.paths(spark, sf).select(
        "route_id", (F.col("pk") % 2).cast("int").alias("leg_index"), "step_index",
        F.when(F.col("rf") == "N", "").otherwise(
            F.concat(F.lit("<b>Turn "), F.lower("rf"), F.lit("</b><div>onto <i>Road "), F.col("sk").cast("string"), F.lit("</i></div>"))
        ).alias("html_instructions"),
        F.col("maneuver_raw").alias("maneuver"), "distance_m", "duration_s",
        geo.encode_polyline(F.col("points")).alias("encoded"),
    )
    out = routes.normalise_steps(located)
    return out.select(
        "route_id", "leg_index", F.col("step_index").alias("maneuver_index"), "distance_m", "static_duration", "instruction",
        "maneuver_code", F.col("bearing_after").cast("double").alias("bearing_after"),
        F.col("bearing_before").cast("double").alias("bearing_before"),
        F.array_join("street_names", "|").alias("street_names"), "highway",
    )
