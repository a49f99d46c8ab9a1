"""Tests for the findings of the fourth round."""

import datetime
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayline.operators import ordered, samples

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz"
PART = "p_partkey long, p_name string, p_brand string, p_size int"


def tables(spark, folder):
    """Orders with several lines, equal lines and lines without an order, and roads."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(o, o * 7 + n, o * 3 + n, n, float(3 * n + o % 40), 1000.0 * n + o, "NRA"[n % 3], day) for o in range(60) for n in range(1 + o % 5)]
    rows += [rows[5], rows[5], (None, 8, 3, 1, 30.0, 10.0, "R", day), (None, 9, 4, 2, None, 20.0, "N", day), (7, None, None, 9, 21.0, None, None, day)]
    spark.createDataFrame(rows, LINE).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}", "b", p % 9) for p in range(500)], PART).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Name, key and the line below of each exchange in the plan."""
    lines = plan(df).split("\n")
    return [(x.strip(" :+-|"), lines[i + 1]) for i, x in enumerate(lines) if re.search(r"[-+] Exchange ", x)]


def by_hand(rows):
    """Sum from a row to the end of its key and the value of the next row, in one list a key."""
    found = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(own):
            found[r[:2]] = (sum(x[2] or 0 for x in own[i:]), own[i + 1][2] if i + 1 < len(own) else None)
    return found


def test_reverse_order_over_blocks(spark):
    places = {"a": range(40), "b": [3], "c": range(-25, 25, 3), None: [*range(9, 12), 35], "d": range(90, 100), "e": [0, 55]}
    rows = [(k, at, None if at % 7 == 3 else at * 5 % 23) for k, v in places.items() for at in v]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    for base in (ordered.cut(df, ["k"], "at", 10), df, ordered.cut(df, ["k"], "at", 10, whole=True)):
        value = {"rest": F.col("v").cast("bigint")}
        out = ordered.with_neighbour(ordered.running_sums(base, ["k"], "at", value, reverse=True, width=10), ["k"], "at", {"next": F.col("v")}, width=10)
        assert {(r.k, r.at): (r.rest, r.next) for r in out.collect()} == by_hand(rows)
    # a key that is one block is not summed up over blocks at all
    assert "Join" not in plan(out)
    # and else only later blocks are
    assert re.search(r"Filter .*> 0", plan(ordered.running_sums(df, ["k"], "at", {"rest": F.col("v").cast("bigint")}, reverse=True)))


def test_samples_are_filled_behind_the_shuffles(spark, tmp_path):
    folder = tables(spark, tmp_path)
    out = entry.queries()["build_samples"](spark, folder)
    moved = exchanges(out)
    assert not any("points" in below or "route_id" in below.split("coalesce")[0] for _, below in moved)
    lines = [x for x, _ in moved if "REPARTITION_BY_COL" in x]
    assert len(lines) == 1 and len([x for x, _ in moved if "_cut_" in x]) == 0
    rows = {(r.route_id, r.step_index): r for r in out.collect() if r.route_id}
    first = rows["city4_route59", 0]
    assert len(rows) == 183 and (first.remaining_distance_m, rows["city4_route59", 4].remaining_distance_m) == (5 * (19 * 5 + 30), 155)
    assert first.instruction == "Turn r onto Road 178" and first.heading is not None and first.frames


def test_samples_of_plain_steps(spark):
    from wayline.operators import frames as fop

    schema = f"route_id string, step_index int, instruction string, maneuver string, distance_m int, points array<struct<lat:double,lng:double>>, start_lat double, start_lng double, end_lat double, end_lng double, heading double, frames array<{fop.FRAME}>"
    path = [(1.0, 2.0), (1.001, 2.0)]
    rows = [("r", i, f"Turn left onto Road {i}", "TURN_LEFT", 50, path, 1.0, 2.0, 1.001, 2.0, 9.0, None) for i in range(3)] + [(None, 0, None, None, 10, [], None, None, None, None, 9.0, None)]
    steps = spark.createDataFrame(rows, schema)
    roads = spark.createDataFrame([(1, 1.0, 2.0)], "road_id long, lat double, lng double").withColumns(
        {n: F.lit("primary" if n == "highway" else "2" if n == "lanes" else "yes") for n in (*samples.ROAD_FIELDS, "name", "sidewalk", "cycleway")})
    narrow = steps.drop("points", "maneuver", "heading", "frames", "end_lat", "end_lng")
    more = [F.when(F.col("route_id") == "r", F.lit("TURN_LEFT")).alias("maneuver"), F.lit(9.0).alias("heading"), F.lit(None).cast(f"array<{fop.FRAME}>").alias("frames")]
    point = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in path])
    whole = lambda df: df.select("*", *more, F.when(F.col("route_id") == "r", point).otherwise(F.array().cast("array<struct<lat:double,lng:double>>")).alias("points"),
                                 (F.col("start_lat") + F.when(F.col("route_id") == "r", 0.001)).alias("end_lat"), F.col("start_lng").alias("end_lng"))
    made = [samples.build_samples(steps, roads, F.lit("x")), samples.build_samples(narrow, roads, F.lit("x"), whole=whole, places=steps)]
    got = [sorted(map(str, df.collect())) for df in made]
    assert len(got[0]) == 4 and [x.replace("1.00099", "1.001") for x in got[0]] == [x.replace("1.00099", "1.001") for x in got[1]]
    r = next(r for r in made[0].collect() if r.step_index == 1)
    assert (r.prior.instruction, r.distances.remaining_distance_m, r.osm_road.highway, r.osm_road.street_names) == ("Turn left onto Road 2", 100, "primary", ["Road 1"])
    assert r.images.frames == ["frames/r_step001_000m_050m.jpg", "frames/r_step001_010m_040m.jpg"] and abs(r.geometry.heading) < 1e-6


def test_rewritten_samples_are_made_behind_the_join(spark, tmp_path, monkeypatch):
    from wayline.sources import writers

    folder, seen, write = tables(spark, tmp_path / "in"), [], writers.write_rewritten
    monkeypatch.setattr(writers, "write_rewritten", lambda df, *args: seen.append(df) or write(df, *args))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = entry.queries()["sink_rewrite"](spark, folder)
        moved = exchanges(seen[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # lines are read twice, by one and the same shuffle, and nothing else moves
    assert len(moved) == 2 and len({re.sub(r"#\d+L?|plan_id=\d+", "", x) for x, _ in moved if "REPARTITION_BY_COL" in x}) == 1
    rows = [(r.id, r.frames) for r in out.collect()]
    named = dict(x for x in rows if x[0])
    assert (named["city4_route59_step000"], named["city4_route59_step001"]) == ("new.jpg", "2")  # sk 177; sk 178 and pk 414
    assert len(rows) == len(named) + 2 and "city0_route0_step000" not in named  # two lines without an order; pk 0


def test_new_frames_beside_narrow_samples(spark):
    from wayline.sources import writers

    samples = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "id string, n int")
    fresh = spark.createDataFrame([("a", ["x"]), (None, ["y"]), ("c", ["z"]), ("b", None)], "id string, new_frames array<string>")
    stored = lambda df: df.withColumn("images", F.struct(F.array(F.concat(F.lit("f"), F.col("n").cast("string"))).alias("frames")))
    lie = lambda df: df.withColumn("place", F.coalesce("id", F.lit("none")))
    found = lambda df: sorted((r.n, r.id, r.images.frames) for r in df.collect())
    plain, behind = writers.with_new_frames(stored(samples), fresh), writers.with_new_frames(samples, fresh, whole=stored)
    met = [writers.with_new_frames(lie(stored(samples)).repartition(*n), lie(fresh).repartition(*n), place="place") for n in ((3,), (3, "place"), (3, "place", "id"))]
    # frames that come twice give a sample twice, as a join does
    more = fresh.union(fresh)
    assert found(writers.with_new_frames(samples, more, whole=stored)) == found(writers.with_new_frames(lie(samples), lie(more), whole=stored, place="place"))
    for df in met:
        assert found(df) == found(plain)
    assert found(behind) == found(plain) == [(1, "a", ["x"]), (2, "b", ["f2"]), (3, None, ["f3"]), (4, "a", ["x"])]


def test_frames_lie_by_route_and_only_files_move(spark, tmp_path):
    from wayline.functions import normalize as N
    from wayline.operators import frames as fop

    names = [("a_step001_000m_040m.jpg", "a"), ("a_step1_step002_x.jpg", "a_step1"), ("_step000_", ""), ("map.png", "map.png"), ("", ""), (None, None), ("é_step3", "é")]
    df = spark.createDataFrame(names, "name string, route string")
    assert df.where(~N.route_of_frame(F.col("name")).eqNullSafe(F.col("route"))).count() == 0

    rows = [(f"{r}_{s}", f"{r}_step{s:03d}_{k}m.jpg", r, w) for r in ("a", "b", "c") for s in range(40) for k in (1, 2, 3) for w in (True, False) if (s + k + w) % 3]
    rows += rows[::5] + [("b_0", "a_step000_1m.jpg", "a", True), ("z", None, "none", True), ("z", None, "none", False), ("z", None, "none", True), (None, "c_step000_1m.jpg", "c", False)]
    listed = spark.createDataFrame(rows, "sample_id string, path string, route string, wanted boolean")
    files = spark.createDataFrame([(r[1],) for r in rows[::2]] * 2 + [(None,), ("map.png",), ("a_step999_1m.jpg",)], "path string")
    there = {r[1] for r in rows[::2]} - {None}
    want = set()
    for sample, path, _, wanted in rows:
        action = ("skip" if path in there else "download") if wanted else "stale" if path in there else "gone"
        if wanted or path is None or (sample, path) not in {x[:2] for x in rows if x[3]}:
            want.add((sample, path, action))
    key = lambda row: tuple(map(str, row))
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            for df in (fop.plan_of_listed(listed.repartition("route"), files, route="route"), fop.plan_of_listed(listed, files, route="route"), fop.plan_of_listed(listed, files)):
                assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    moved = [x for x, _ in exchanges(entry.queries()["regenerate_plan"](spark, tables(spark, tmp_path)))]
    assert len(moved) == 3 and [x for x in moved if "hashpartitioning(route#" in x] and not any("_path_hash" in x for x in moved)
