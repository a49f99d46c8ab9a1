"""SQL twins of the views in ``tables``, for the comparison engine."""

VIEWS = {
    "a_steps": """
SELECT 'city' || (l_orderkey % 5) || '_route' || l_orderkey AS route_id,
  CAST(line - 1 AS INT) AS step_index,
  CAST(q * 5 AS INT) AS distance_m,
  CAST(FLOOR(price / CAST(1000 AS DOUBLE)) AS INT) AS duration_s,
  CAST(pk % 31 AS INT) AS type_code,
  CASE pk % 4 WHEN 0 THEN 'turn-left' WHEN 1 THEN '' WHEN 2 THEN 'ramp-right' END AS maneuver_raw,
  CAST(-2747000 + pk % 1000 * 10 AS BIGINT) AS lat_e5,
  CAST(15302000 + sk % 1000 * 10 AS BIGINT) AS lng_e5,
  CASE WHEN rf = 'N' THEN '' ELSE 'Turn ' || LOWER(rf) || ' onto Road ' || sk END AS instruction,
  q, pk, sk, rf
FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS price, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf,
        ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line
      FROM lineitem)""",
    "a_points": """
SELECT s.*, CAST(i AS INT) AS pt_idx, n_points,
  CAST(lat_e5 + i * q * (pk % 5 - 2) AS BIGINT) AS plat_e5,
  CAST(lng_e5 + i * (sk % 3) * 20 AS BIGINT) AS plng_e5,
  CAST(lat_e5 + i * q * (pk % 5 - 2) AS DOUBLE) / CAST(100000 AS DOUBLE) AS lat,
  CAST(lng_e5 + i * (sk % 3) * 20 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lng
FROM (SELECT *, CAST(CASE WHEN pk % 29 = 0 THEN 1 ELSE 2 + pk % 3 END AS INT) AS n_points
      FROM a_steps) s, LATERAL (SELECT UNNEST(range(0, n_points)) AS i) t""",
    "a_segments": """
SELECT *, 2 * 6371000.0::DOUBLE * asin(sqrt(
    pow(sin(radians(lat2 - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2))) AS metres,
  (degrees(atan2(sin(radians(lng2 - lng)) * cos(radians(lat2)),
     cos(radians(lat)) * sin(radians(lat2))
     - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lng2 - lng)))) + 360) % 360 AS bearing
FROM (SELECT *, LEAD(lat) OVER w AS lat2, LEAD(lng) OVER w AS lng2 FROM a_points
      WINDOW w AS (PARTITION BY route_id, step_index ORDER BY pt_idx))
WHERE lat2 IS NOT NULL""",
    "a_cum": """
SELECT *, SUM(metres) OVER (PARTITION BY route_id, step_index ORDER BY pt_idx) AS cum_end,
  SUM(metres) OVER (PARTITION BY route_id, step_index ORDER BY pt_idx) - metres AS cum_start,
  SUM(metres) OVER (PARTITION BY route_id, step_index) AS path_m
FROM a_segments""",
    "a_results": """
SELECT event_id AS ordinal, CAST(FLOOR(event_id / 10) AS BIGINT) AS sample_id,
  'co' || (user_id % 7) || '/m' || (user_id % 21) AS model_id,
  CASE event_type WHEN 'view' THEN 'video + prior' WHEN 'click' THEN 'image + prior'
    WHEN 'signup' THEN 'prior' ELSE 'augment + prior' END AS modality,
  CASE event_id % 9 WHEN 0 THEN 'v2' WHEN 1 THEN '' END AS variant,
  CASE event_id % 6 WHEN 0 THEN 'rain' WHEN 1 THEN '' WHEN 2 THEN 'haze' END AS augment,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error,
  CAST(FLOOR(value * 100) AS INT) AS latency_ms,
  CASE WHEN event_id % 7 <> 6 THEN CAST(event_id % 7 AS INT) END AS lanes_count,
  CASE event_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unknown' END AS lane_change_required,
  CASE event_id % 5 WHEN 0 THEN 'turn_left' WHEN 1 THEN 'keep_left' WHEN 2 THEN 'turn_right'
    WHEN 3 THEN 'straight' ELSE '' END AS next_action,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE 'Turn ' || CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END
    || ' onto Road ' || (user_id % 40) || ' then continue for ' || CAST(FLOOR(value) AS BIGINT) || ' meters'
    END AS enhanced_instruction,
  CASE WHEN event_id % 5 = 0 THEN CAST([] AS VARCHAR[])
    ELSE ['Shop ' || (event_id % 3), ' park ' || (user_id % 4), 'shop ' || (event_id % 3)] END AS relevant_landmarks,
  CASE WHEN event_id % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['cyclist ' || (event_id % 2)] END AS potential_hazards,
  100 + event_id % 50 AS tokens_in, 10 + user_id % 30 AS tokens_out,
  value / CAST(500 AS DOUBLE) AS confidence, ts
FROM events""",
    "a_gt": """
SELECT doc_id AS sample_id, doc_id % 10 = 0 AS is_auto,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'co' || (doc_id % 7) || '/m' || (doc_id % 21) || '::human' END AS result_key,
  'Turn left onto Road ' || (doc_id % 40) || ' then continue' AS instruction,
  CASE WHEN doc_id % 5 = 0 THEN ['keep_left', 'TURN_RIGHT '] ELSE CAST([] AS VARCHAR[]) END AS acceptable_actions,
  CASE WHEN doc_id % 11 <> 0 THEN quality = 1 END AS lane_change_required,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(1 + doc_id % 4 AS INT) END AS lanes_count,
  CASE WHEN toxic = 1 THEN 'turn_right' ELSE 'turn_left' END AS next_action,
  CASE WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['shop ' || (doc_id % 3), 'bridge'] END AS relevant_landmarks,
  CASE WHEN doc_id % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Cyclist 1'] END AS potential_hazards,
  CASE doc_id % 6 WHEN 0 THEN 'RAMP_LEFT' WHEN 1 THEN 'TURN_RIGHT' WHEN 2 THEN 'straight'
    WHEN 3 THEN 'U Turn' WHEN 4 THEN '' ELSE 'KEEP_LEFT' END AS maneuver
FROM labels""",
    "a_samples": """
SELECT doc_id AS sample_id,
  'city' || (CAST(FLOOR(doc_id / 7) AS BIGINT) % 5) || '_route' || CAST(FLOOR(doc_id / 7) AS BIGINT) AS route_id,
  CAST(doc_id % 7 AS INT) AS step_index,
  CASE WHEN doc_id % 7 = 6 THEN 'Arrive' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'TURN_LEFT'
    ELSE 'KEEP_RIGHT' END AS maneuver,
  source, 'Go ' || n_chars || ' then ' || lang AS instruction,
  CASE WHEN doc_id % 3 = 0 THEN 'city' || (CAST(FLOOR(doc_id / 7) AS BIGINT) % 5) END AS city, n_chars
FROM documents""",
    "a_pairs": """
SELECT a.conv_id, a.turn, a.text AS ref_text, b.text AS pred_text
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "a_vectors": """
SELECT vec_id, label AS maneuver, embedding, CAST(vec_id % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS reward
FROM embeddings""",
    "a_roads": """
SELECT p_partkey AS road_id,
  CAST(-2747000 + p_partkey % 1000 * 10 + p_partkey % 3 * 4 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lat,
  CAST(15302000 + p_partkey % 97 * 10 AS DOUBLE) / CAST(100000 AS DOUBLE) AS lng,
  CASE p_partkey % 8 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary_link'
    WHEN 3 THEN 'tertiary' WHEN 4 THEN 'residential' WHEN 5 THEN 'unclassified' WHEN 6 THEN 'footway'
    ELSE 'service' END AS highway,
  p_name AS name,
  CASE WHEN p_size % 4 = 0 THEN 'two' ELSE CAST(p_size % 5 AS VARCHAR) END AS lanes,
  CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS oneway,
  CASE WHEN p_partkey % 5 = 0 THEN 'M' || (p_partkey % 50) END AS ref, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size % 6 * 10 + 30 AS VARCHAR) END AS maxspeed,
  CASE WHEN p_partkey % 4 <> 1 THEN p_brand END AS surface, CASE p_partkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lit,
  CASE WHEN p_partkey % 9 = 0 THEN 'both' END AS sidewalk, CASE WHEN p_partkey % 10 = 0 THEN 'lane' END AS cycleway,
  CASE WHEN p_partkey % 11 = 0 THEN 'yes' END AS bridge, CASE WHEN p_partkey % 13 = 0 THEN 'yes' END AS tunnel,
  CASE WHEN p_partkey % 17 = 0 THEN 'yes' ELSE 'no' END AS toll
FROM part""",
    "a_registry": """
SELECT 'co' || (s_suppkey % 7) || '/x' || s_suppkey AS model_id,
  ['co' || (s_suppkey % 7) || '/m' || s_suppkey, 'old/m' || s_suppkey] AS aliases,
  s_name AS display_name,
  CAST(s_suppkey % 20 AS DOUBLE) / CAST(4 AS DOUBLE) AS input_cost_per_mtok,
  CAST(s_suppkey % 20 AS DOUBLE) / CAST(2 AS DOUBLE) AS output_cost_per_mtok
FROM supplier""",
    "a_votes": """
SELECT a.ordinal, a.sample_id, a.modality, a.model_id AS model_a, b.model_id AS model_b,
  k AS judge, CASE WHEN (a.ordinal * k) % 3 = 0 THEN 'A' WHEN (a.ordinal * k + k) % 3 = 1 THEN 'B' ELSE 'tie' END AS winner,
  CASE WHEN (a.ordinal + k) % 11 = 0 OR (a.ordinal % 13 = 0 AND k < 3) THEN 'timeout' END AS error
FROM a_results a JOIN a_results b ON b.ordinal = a.ordinal + 1 AND b.sample_id = a.sample_id
  AND b.model_id <> a.model_id, (SELECT UNNEST([1, 2, 3]) AS k)""",
}

NEEDS = {
    "a_points": ["a_steps"],
    "a_segments": ["a_steps", "a_points"],
    "a_cum": ["a_steps", "a_points", "a_segments"],
    "a_votes": ["a_results"],
}


def with_views(names: str, body: str, /, **extra: str) -> str:
    """``body`` behind the named views; ``extra`` adds views of its own."""
    ordered: list[str] = []
    for name in names.split():
        for part in [*NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered]
    parts += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
