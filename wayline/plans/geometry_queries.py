"""Named queries: geometry over steps and points."""

from pyspark.sql import functions as F

from wayline.functions import geo
from wayline.operators import geometry, routes
from wayline.plans import tables as t
from wayline.plans.oracle_views import with_views
from wayline.plans.registry import query

KEY = ["route_id", "step_index"]
P = "points"


def _encoded(spark, sf):
    return t.paths(spark, sf).withColumn("encoded", geo.encode_polyline(P))


@query("polyline_to_points", with_views("a_points", """
SELECT route_id, step_index, pt_idx, lat, lng FROM a_points WHERE pk % 7 <> 0"""))
def _(spark, sf):
    # one path in seven is cut so that it ends inside a number
    cut = F.when(F.col("pk") % 7 == 0, F.concat("encoded", F.lit("_"))).otherwise(F.col("encoded"))
    return geometry.polyline_to_points(_encoded(spark, sf).withColumn("encoded", cut), KEY, "encoded")


_CHUNKS = """
SELECT route_id, step_index, pt_idx, axis, CASE WHEN d < 0 THEN -d * 2 - 1 ELSE d * 2 END AS z FROM (
  SELECT route_id, step_index, pt_idx, 0 AS axis, plat_e5 - COALESCE(LAG(plat_e5) OVER w, 0) AS d FROM a_points
  WINDOW w AS (PARTITION BY route_id, step_index ORDER BY pt_idx)
  UNION ALL SELECT route_id, step_index, pt_idx, 1, plng_e5 - COALESCE(LAG(plng_e5) OVER w, 0) FROM a_points
  WINDOW w AS (PARTITION BY route_id, step_index ORDER BY pt_idx))"""
_ENCODED = """
SELECT route_id, step_index, string_agg(c, '' ORDER BY pt_idx, axis, k) AS encoded FROM (
  SELECT route_id, step_index, pt_idx, axis, k,
    chr(CAST(63 + ((z >> (5 * k)) & 31) + CASE WHEN (z >> (5 * k)) >= 32 THEN 32 ELSE 0 END AS INT)) AS c
  FROM chunks, (SELECT UNNEST(range(0, 7)) AS k) WHERE k = 0 OR (z >> (5 * k)) > 0)
GROUP BY route_id, step_index"""


@query("points_to_polyline", with_views("a_points", "SELECT * FROM enc", chunks=_CHUNKS, enc=_ENCODED))
def _(spark, sf):
    return geometry.points_to_polyline(geometry.points_of(t.paths(spark, sf), KEY), KEY)


@query("segment_lengths", with_views("a_segments", """
SELECT route_id, step_index, CAST(pt_idx AS INT) AS seg_idx, round_even(metres, 3) AS metres FROM a_segments"""))
def _(spark, sf):
    return geometry.segments_of(t.paths(spark, sf), KEY).select(
        *KEY, "seg_idx", F.bround("metres", 3).alias("metres")
    )


@query("segment_bearings", with_views("a_segments", """
SELECT route_id, step_index, CAST(pt_idx AS INT) AS seg_idx, round_even(bearing, 4) AS bearing FROM a_segments"""))
def _(spark, sf):
    return geometry.segments_of(t.paths(spark, sf), KEY).select(
        *KEY, "seg_idx", F.bround("bearing", 4).alias("bearing")
    )


@query("polyline_length", with_views("a_segments", """
SELECT s.route_id, s.step_index, COALESCE(round_even(SUM(g.metres), 3), 0) AS metres
FROM a_steps s LEFT JOIN a_segments g USING (route_id, step_index) GROUP BY s.route_id, s.step_index"""))
def _(spark, sf):
    return t.paths(spark, sf).select(*KEY, F.bround(geo.path_length(P), 3).alias("metres"))


@query("cumulative_distance", with_views("a_cum", """
SELECT route_id, step_index, CAST(pt_idx AS INT) AS seg_idx, round_even(cum_end, 3) AS cum_end FROM a_cum"""))
def _(spark, sf):
    return geometry.segments_of(t.paths(spark, sf), KEY).select(
        *KEY, "seg_idx", F.bround("cum_end", 3).alias("cum_end")
    )


# pose at a target: the first segment that ends at or behind it, else the last one
POSE_SQL = """
SELECT route_id, step_index, target,
  CASE WHEN s <= 0 THEN lat_first WHEN s >= path_m THEN lat_last ELSE lat + (lat2 - lat) * part END AS lat,
  CASE WHEN s <= 0 THEN lng_first WHEN s >= path_m THEN lng_last ELSE lng + (lng2 - lng) * part END AS lng,
  CASE WHEN lat = lat2 AND lng = lng2 THEN 0 ELSE bearing END AS heading
FROM (SELECT *, (s - cum_start) / CASE WHEN metres = 0 THEN 1 ELSE metres END AS part,
    row_number() OVER (PARTITION BY route_id, step_index, target ORDER BY CASE WHEN cum_end >= s THEN pt_idx ELSE 1000 - pt_idx END) AS rn
  FROM (SELECT c.*, target, GREATEST(0, LEAST(total, total - target)) AS s,
    first_value(c.lat) OVER w AS lat_first, first_value(c.lng) OVER w AS lng_first,
    last_value(lat2) OVER w AS lat_last, last_value(lng2) OVER w AS lng_last
    FROM targets JOIN (SELECT c.* FROM a_cum c) c USING (route_id, step_index)
    WINDOW w AS (PARTITION BY route_id, step_index, target ORDER BY pt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
WHERE rn = 1"""
_TARGETS = """
SELECT route_id, step_index, target, total FROM (SELECT DISTINCT route_id, step_index, path_m,
  CASE WHEN distance_m % 3 = 0 THEN path_m ELSE CAST(distance_m AS DOUBLE) END AS total FROM a_cum),
  (SELECT UNNEST([CAST(0 AS DOUBLE), 7.5, 40, 100]) AS target)"""


def _round_pose(df, keys, lat="lat", lng="lng", heading="heading"):
    return df.select(
        *keys, F.bround(lat, 6).alias("lat"), F.bround(lng, 6).alias("lng"), F.bround(heading, 3).alias("heading")
    )


@query("pose_at_remaining", with_views("a_cum", f"""
SELECT route_id, step_index, target, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng, round_even(heading, 3) AS heading FROM poses
UNION ALL SELECT route_id, step_index, target, lat, lng, 0 FROM a_points, (SELECT UNNEST([CAST(0 AS DOUBLE), 7.5, 40, 100]) AS target) WHERE n_points = 1""",
    targets=_TARGETS, poses=POSE_SQL))
def _(spark, sf):
    length = F.when(F.col("distance_m") % 3 == 0, F.lit(0.0)).otherwise(F.col("distance_m").cast("double"))
    wanted = F.array(*[F.lit(v) for v in (0.0, 7.5, 40.0, 100.0)])
    poses = t.paths(spark, sf).select(*KEY, F.explode(geo.poses_at_remaining(P, length, wanted)).alias("q"))
    flat = poses.select(*KEY, F.col("q.remaining_m").alias("target"), "q.lat", "q.lng", "q.heading")
    return _round_pose(flat, [*KEY, "target"])


_MAP_TARGETS = """
SELECT DISTINCT route_id, step_index, CASE WHEN path_m < 40 THEN path_m / 2 ELSE CAST(20 AS DOUBLE) END AS target, path_m AS total
FROM a_cum WHERE path_m > 0"""


@query("map_pose", with_views("a_cum", f"""
SELECT route_id, step_index, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng, round_even(heading, 3) AS heading FROM poses
UNION ALL SELECT route_id, step_index, lat_e5 / CAST(100000 AS DOUBLE), lng_e5 / CAST(100000 AS DOUBLE), 45
FROM a_steps s WHERE NOT EXISTS (SELECT 1 FROM a_cum c WHERE c.route_id = s.route_id AND c.step_index = s.step_index AND path_m > 0)""",
    targets=_MAP_TARGETS, poses=POSE_SQL))
def _(spark, sf):
    e5 = lambda c: F.col(c).cast("double") / 100000.0
    none = F.lit(None).cast("double")
    pose = geo.map_pose(P, e5("lat_e5"), e5("lng_e5"), none, none, F.lit(45.0))
    return _round_pose(t.paths(spark, sf).select(*KEY, pose.alias("q")).select(*KEY, "q.*"), KEY)


_MAP40 = """
SELECT DISTINCT route_id, step_index, CASE WHEN distance_m < 80 THEN LEAST(40, distance_m / CAST(2 AS DOUBLE)) ELSE CAST(40 AS DOUBLE) END AS target,
  path_m AS total FROM a_cum"""


@query("map_pose_40", with_views("a_cum", f"""
SELECT route_id, step_index, round_even(lat, 6) AS lat, round_even(lng, 6) AS lng, round_even(heading, 3) AS heading FROM poses
UNION ALL SELECT route_id, step_index, lat, lng, 12 FROM a_points WHERE n_points = 1""", targets=_MAP40, poses=POSE_SQL))
def _(spark, sf):
    e5 = lambda c: F.col(c).cast("double") / 100000.0
    pose = geo.map_pose_40(P, F.col("distance_m"), e5("lat_e5"), e5("lng_e5"), F.lit(12.0))
    return _round_pose(t.paths(spark, sf).select(*KEY, pose.alias("q")).select(*KEY, "q.*"), KEY)


@query("route_bounds", with_views("a_points", """
SELECT route_id, MIN(lat) AS min_lat, MAX(lat) AS max_lat, MIN(lng) AS min_lng, MAX(lng) AS max_lng FROM a_points GROUP BY route_id"""))
def _(spark, sf):
    return geometry.route_bounds(t.paths(spark, sf))


@query("step_end_bearings", with_views("a_segments", """
SELECT s.route_id, s.step_index, COALESCE(CAST(floor(f.b) AS INT), 0) AS bearing_after, COALESCE(CAST(floor(f.e) AS INT), 0) AS bearing_before
FROM a_steps s LEFT JOIN (SELECT route_id, step_index, arg_min(bearing, pt_idx) AS b, arg_max(bearing, pt_idx) AS e FROM a_segments GROUP BY ALL) f
USING (route_id, step_index)"""))
def _(spark, sf):
    brg = t.paths(spark, sf).withColumn("b", geo.segment_bearings(P))
    at = lambda i: F.coalesce(F.floor(F.try_element_at("b", F.lit(i))).cast("int"), F.lit(0))
    return brg.select(*KEY, at(1).alias("bearing_after"), at(-1).alias("bearing_before"))


@query("shape_index", with_views("a_points", """
SELECT route_id, step_index, CAST(SUM(n_points - 1) OVER w - (n_points - 1) AS BIGINT) AS begin_shape_index,
  CAST(SUM(n_points - 1) OVER w AS BIGINT) AS end_shape_index
FROM (SELECT DISTINCT route_id, step_index, n_points FROM a_points) WINDOW w AS (PARTITION BY route_id ORDER BY step_index)"""))
def _(spark, sf):
    return routes.shape_index(t.paths(spark, sf), F.size("points")).select(
        *KEY, "begin_shape_index", "end_shape_index"
    )


_NEAR = """
SELECT lat, lng, arg_max(road_id, CAST(rank AS BIGINT) * 1000000000 - road_id) AS road_id FROM (
  SELECT p.lat, p.lng, r.road_id, CASE r.highway WHEN 'motorway' THEN 10 WHEN 'primary' THEN 6 WHEN 'secondary_link' THEN 3
    WHEN 'tertiary' THEN 2 WHEN 'residential' THEN 0 WHEN 'unclassified' THEN 0 ELSE -1 END AS rank
  FROM (SELECT DISTINCT round_even(CAST(lat_e5 AS DOUBLE) / 100000, 5) AS lat, round_even(CAST(lng_e5 AS DOUBLE) / 100000, 5) AS lng FROM a_steps) p
  JOIN a_roads r ON abs(r.lat - p.lat) < 0.0003 AND abs(r.lng - p.lng) < 0.0003
  WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(r.lat - p.lat) / 2), 2)
    + cos(radians(p.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lng - p.lng) / 2), 2))) <= 20)
GROUP BY lat, lng"""


def _places(spark, sf):
    e5 = lambda c: (F.col(c).cast("double") / 100000.0).alias(c[:3])
    return t.steps(spark, sf).select(*KEY, e5("lat_e5"), e5("lng_e5"))


@query("nearest_road", with_views("a_steps a_roads", """
SELECT n.lat, n.lng, n.road_id, r.highway, r.name, r.ref, r.maxspeed, TRY_CAST(r.lanes AS INT) AS lanes, r.surface, r.oneway = 'yes' AS oneway,
  COALESCE(r.lit = 'yes', FALSE) AS lit, r.sidewalk, r.cycleway, COALESCE(r.bridge = 'yes', FALSE) AS bridge, COALESCE(r.tunnel = 'yes', FALSE) AS tunnel, r.toll = 'yes' AS toll
FROM near n JOIN a_roads r USING (road_id)""", near=_NEAR))
def _(spark, sf):
    near = geometry.roads_near(_places(spark, sf), t.roads(spark, sf))
    return near.select("lat", "lng", "road.road_id", geometry.road_info(F.col("road")).alias("i")).select(
        "lat", "lng", "road_id", "i.*"
    )


@query("grid_dedup_lookup", with_views("a_steps a_roads", """
SELECT s.route_id, s.step_index, n.road_id FROM a_steps s LEFT JOIN near n
ON n.lat = round_even(CAST(lat_e5 AS DOUBLE) / 100000, 5) AND n.lng = round_even(CAST(lng_e5 AS DOUBLE) / 100000, 5)""", near=_NEAR))
def _(spark, sf):
    return geometry.attach_roads(_places(spark, sf), t.roads(spark, sf)).select(*KEY, "road.road_id")


@query("route_polyline_concat", with_views("a_points", """
SELECT route_id, step_index, CAST(pt_idx AS INT) AS pt_idx,
  CAST(row_number() OVER (PARTITION BY route_id ORDER BY step_index, pt_idx) - 1 AS BIGINT) AS path_idx, lat, lng FROM a_points"""))
def _(spark, sf):
    return routes.concat_paths(t.paths(spark, sf))
