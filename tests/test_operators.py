import pytest
import itertools
import json
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from wayline.operators import agreement, frames, geometry, joins, manifest, matrix, ordered, pairwise, routes
from wayline.sources import readers


def test_running_sums_over_blocks(spark):
    random.seed(3)
    rows = [(k, i, random.randint(0, 9)) for k, n in (("hot", 500), ("cold", 3), (None, 20)) for i in random.sample(range(5000), n)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for reverse, inclusive in itertools.product((False, True), repeat=2):
        out = ordered.running_sums(df, ["k"], "i", {"s": F.col("v")}, reverse=reverse, inclusive=inclusive, width=64)
        for r in out.collect():
            before = lambda i: i > r.i if reverse else i < r.i
            want = sum(v for k, i, v in rows if k == r.k and (before(i) or (inclusive and i == r.i)))
            assert r.s == want
        assert out.count() == len(rows)


def test_neighbours_over_blocks(spark):
    rows = [("a", i * 3) for i in range(200)] + [("b", 7)]
    df = spark.createDataFrame(rows, "k string, i int")
    for step in (1, -1):
        out = ordered.with_neighbour(df, ["k"], "i", {"n": F.col("i")}, step=step, width=10)
        got = {(r.k, r.i): r.n for r in out.collect()}
        for k, i in rows:
            assert got[(k, i)] == (i + 3 * step if (k, i + 3 * step) in rows else None)


def test_dense_ordinal_and_whole_table_neighbours(spark):
    values = random.Random(5).sample(range(10**6), 1000)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ranked = sorted(values)
    assert {r.v: r.n for r in ordered.dense_ordinal(df, ["v"], "n").collect()} == {v: i + 1 for i, v in enumerate(ranked)}
    near = {r.v: (r.a, r.b) for r in ordered.with_both_neighbours(df, ["v"], "v", "a", "b").collect()}
    for i, v in enumerate(ranked):
        assert near[v] == (ranked[i - 1] if i else None, ranked[i + 1] if i + 1 < len(ranked) else None)


def test_next_step_text(spark):
    df = spark.createDataFrame([("r", 0, "A"), ("r", 1, "B"), ("r", 2, "C"), ("s", 0, ""), ("s", 4, "")], "route_id string, step_index int, instruction string")
    got = {(r.route_id, r.step_index): (r.effective_instruction, r.instruction_policy, r.next_instruction) for r in routes.next_step_text(df).collect()}
    assert got == {
        ("r", 0): ("B", "n_plus_one", "B"), ("r", 1): ("C", "n_plus_one", "C"), ("r", 2): ("C", "arrival", None),
        ("s", 0): ("", "n_plus_one", ""), ("s", 4): ("Arrive at destination", "arrival", None)}


def _tau(pts):
    c = d = tx = ty = 0
    for (a, b), (e, f) in itertools.combinations(pts, 2):
        if a == e and b == f:
            continue
        if a == e:
            tx += 1
        elif b == f:
            ty += 1
        elif (a - e) * (b - f) > 0:
            c += 1
        else:
            d += 1
    base = math.sqrt((c + d + tx) * (c + d + ty))
    return 0.0 if base == 0 else (c - d) / base


def test_kendall_and_spearman_match_brute_force(spark):
    random.seed(11)
    for size, spread in ((0, 3), (1, 3), (2, 1), (60, 4), (150, 1000)):
        pts = [(float(random.randint(0, spread)), float(random.randint(0, spread))) for _ in range(size)]
        df = spark.createDataFrame(pts, "x double, y double")
        row = agreement.kendall(df, "x", "y").head()
        assert row.n == size and math.isclose(row.kendall, _tau(pts), abs_tol=1e-6)
        rank = lambda v, i: sum(p[i] < v for p in pts) + (sum(p[i] == v for p in pts) + 1) / 2
        rx, ry = [rank(p[0], 0) for p in pts], [rank(p[1], 1) for p in pts]
        mean = (size + 1) / 2
        var = math.sqrt(sum((a - mean) ** 2 for a in rx) * sum((b - mean) ** 2 for b in ry))
        want = sum((a - mean) * (b - mean) for a, b in zip(rx, ry)) / var if var else 0.0
        assert math.isclose(agreement.spearman(df, "x", "y").head().spearman, want, abs_tol=1e-6)


def test_pearson_of_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(agreement.pearson(df, "x", "y")).head()[0] == 0.0


def test_cross_company_pairs_are_complete(spark):
    models = [f"co{i % 4}/m{i}" for i in range(40)]
    got = pairwise.cross_company_pairs(spark.createDataFrame([(m,) for m in models * 3], "model_id string"), blocks=5).collect()
    want = {frozenset(p) for p in itertools.combinations(models, 2) if p[0].split("/")[0] != p[1].split("/")[0]}
    assert len(got) == len(want) and {frozenset((r.model_a, r.model_b)) for r in got} == want


def test_majority(spark):
    vote = lambda w, e=None: ("j", w, e)
    rows = [
        (1, "x", "y", [vote("A"), vote("A"), vote("B")]), (2, "x", "y", [vote("A"), vote("B"), vote("tie")]),
        (3, "x", "y", [vote("B", "bad"), vote("B"), vote("B")]), (4, "x", "y", [vote("A", "bad")] * 3), (5, "x", "y", []),
    ]
    df = spark.createDataFrame(rows, "i int, model_a string, model_b string, judge_votes array<struct<judge_model:string,winner:string,error:string>>")
    assert {r.i: (r.majority_winner, r.is_tie) for r in pairwise.majority(df).collect()} == {
        1: ("x", False), 2: (None, True), 3: ("y", False), 4: (None, True), 5: (None, True)}


def test_ratings_order_strong_models_first(spark):
    rows = [("a", "b", "a")] * 8 + [("b", "c", "b")] * 8 + [("a", "c", "a")] * 8 + [("a", "b", None)] * 2
    df = spark.createDataFrame(rows, "model_a string, model_b string, majority_winner string")
    rating = {r.model_id: r.rating for r in pairwise.ratings(df).collect()}
    assert rating["a"] > rating["b"] > rating["c"]


def test_roads_near_match_brute_force(spark):
    random.seed(2)
    classes = ["motorway", "primary", "residential", "footway", "service"]
    for lat0, lng0 in ((-27.47, 153.02), (0.0, 179.9999), (64.0, -179.9999), (0.0, 0.0)):
        wrap = lambda x: (x + 180) % 360 - 180
        place = lambda: (round(lat0 + random.uniform(-0.001, 0.001), 5), round(wrap(lng0 + random.uniform(-0.001, 0.001)), 5))
        points = [place() for _ in range(40)]
        roads = [(i, *place(), random.choice(classes)) for i in range(150)]
        out = geometry.roads_near(
            spark.createDataFrame(points, "lat double, lng double"),
            spark.createDataFrame(roads, "road_id long, lat double, lng double, highway string"), 30.0)
        got = {(r.lat, r.lng): r.road.road_id for r in out.collect()}
        rank = {"motorway": 10, "primary": 6, "residential": 0}

        def metres(a, b):
            p, q = math.radians(a[0]), math.radians(b[0])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
            return 2 * 6371000 * math.asin(math.sqrt(h))

        want = {}
        for p in set(points):
            near = [(-rank.get(h, -1), i) for i, a, b, h in roads if metres(p, (a, b)) <= 30.0]
            if near:
                want[p] = min(near)[1]
        assert got == want and want


def test_points_to_polyline_over_blocks(spark):
    random.seed(4)
    paths = {k: [(random.uniform(-1, 1), random.uniform(-1, 1)) for _ in range(n)] for k, n in (("a", 1), ("b", 57))}
    rows = [(k, i, *p) for k, pts in paths.items() for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "k string, pt_idx int, lat double, lng double")
    from wayline.functions import geo

    whole = spark.createDataFrame(list(paths.items()), f"k string, p {geo.POINTS}").select("k", geo.encode_polyline(F.col("p")).alias("e"))
    assert sorted(geometry.points_to_polyline(df, ["k"], width=8).collect()) == sorted(whole.collect())


def test_round_robin(spark):
    df = spark.createDataFrame([(f"r{i:02d}",) for i in (3, 1, 2, 5, 4, 1)] + [("",), (None,)], "route_id string")
    got = {r.route_id: r.augment for r in matrix.assign_augments(df).collect()}
    assert got == {"r01": "rain", "r02": "night", "r03": "fog", "r04": "motion_blur", "r05": "rain"}


def test_missing_cells_treat_blank_as_null(spark):
    schema = "sample_id long, model_id string, modality string, variant string, augment string"
    wanted = spark.createDataFrame([(1, "m", "prior", None, ""), (2, "m", "prior", "v", None)], schema)
    existing = spark.createDataFrame([(1, "m", "prior", "", None), (2, "m", "prior", None, None)], schema)
    assert [r.sample_id for r in joins.missing_cells(wanted, existing).collect()] == [2]


def test_panoramas(spark):
    rows = [("s", 1, "p", "OK"), ("s", 2, "p", "OK"), ("s", 3, None, "OK"), ("s", 4, "", "OK"), ("s", 5, None, "OK"), ("s", 6, "q", "ERROR"), ("t", 7, "p", "OK")]
    df = spark.createDataFrame(rows, "k string, i int, pano_id string, status string")
    assert sorted(r.i for r in frames.distinct_panoramas(df, ["k"], "i").collect()) == [1, 3, 4, 5, 7]


def test_manifest_round_trip_in_parts(spark, monkeypatch):
    monkeypatch.setattr(manifest, "STEPS_PER_ROW", 4)
    steps = spark.createDataFrame([("r", i, "m", f"t{i}", 10, ["f"] * (i % 3)) for i in range(10)],
                                  "route_id string, step_index int, maneuver string, instruction string, distance_m int, f array<string>")
    steps = steps.withColumn("frames", F.transform("f", lambda x: F.struct(x.alias("filename")))).drop("f")
    rows = manifest.build_manifest(steps)
    assert sorted((r.part, [s.step_index for s in r.steps]) for r in rows.collect()) == [(0, [0, 1, 2, 3]), (1, [4, 5, 6, 7]), (2, [8, 9])]
    back = {r.step_index: (r.prior.instruction, r.distances.remaining_distance_m) for r in manifest.manifest_to_samples(rows).collect()}
    assert back == {i: (f"t{i}", (10 - i) * 10) for i in range(10)}


def test_read_results_and_labels(spark, tmp_path):
    (tmp_path / "results_a.jsonl").write_text("\n".join([
        json.dumps({"id": "1", "model_id": "m", "lane_change_required": True}), "", "{bad", json.dumps({"sample_id": "2", "model_id": "m"}) + " x",
        json.dumps({"sample_id": "3", "model_id": "m", "error": "e"}), json.dumps({"id": "", "sample_id": "4", "model_id": "m"}), json.dumps({"id": "5"})]))
    got = sorted((r.sample_id, r.lane_change_required) for r in readers.read_results(spark, str(tmp_path / "results_*.jsonl")).collect())
    assert got == [("1", "true"), ("4", None)]
    (tmp_path / "gt.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"sample_id": "1", "instruction": "a"}, {"sample_id": "1", "instruction": "b"}, {"sample_id": "1", "is_auto": True, "instruction": "c"}]))
    assert [r.instruction for r in readers.read_ground_truth(spark, str(tmp_path / "gt.jsonl")).collect()] == ["b"]


def test_documents(spark, tmp_path):
    frame = {"filename": "f.jpg", "remaining_m": 40}
    (tmp_path / "manifest.json").write_text(json.dumps({"version": "1", "routes": [{"route_id": "r", "steps": [
        {"step_index": 0, "frame": frame}, {"step_index": 1, "sparse4_frames": [frame, frame], "frame": frame}, {"step_index": 2}]}]}, indent=1))
    got = {r.step_index: len(r.frames or []) for r in readers.read_manifest(spark, str(tmp_path / "manifest.json"), documents=True).collect()}
    assert got == {0: 1, 1: 2, 2: 0}
    (tmp_path / "splits.json").write_text(json.dumps({"train": ["a", "b"], "val": ["b", "c"], "test": ["c"]}))
    assert {r.sample_id: r.split for r in readers.read_splits(spark, str(tmp_path / "splits.json")).collect()} == {"a": "train", "b": "val", "c": "test"}
    (tmp_path / "models.json").write_text(json.dumps({"models": [{"model_id": "m", "aliases": ["n"], "params_estimated": True}]}))
    assert readers.read_registry(spark, str(tmp_path / "models.json")).head().aliases == ["n"]


def test_image_files(spark, tmp_path):
    for folder, n in (("frames", 3), ("maps", 1)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            (tmp_path / folder / f"{i}.jpg").write_bytes(b"x" * (1 + i // 2))
        (tmp_path / folder / "note.txt").write_text("no")
    got = readers.files_per_folder(readers.list_files(spark, str(tmp_path))).collect()
    assert {r.folder.rsplit("/", 1)[1]: (r.files, r.bytes) for r in got} == {"frames": (3, 4), "maps": (1, 1)}
    assert len({r.digest for r in readers.file_digests(spark, str(tmp_path / "frames")).collect()}) == 2


def test_directions(spark):
    step = {"html_instructions": "Turn <b>left</b> onto <b>A Rd</b>", "maneuver": "turn-left", "distance": {"value": 120},
            "duration": {"value": 9}, "polyline": {"points": "_p~iF~ps|U_ulLnnqC"}}
    schema = ("route_id string, routes array<struct<legs:array<struct<steps:array<struct<html_instructions:string,maneuver:string,"
              "distance:struct<value:int>,duration:struct<value:int>,polyline:struct<points:string>,start_location:struct<lat:double,lng:double>,"
              "end_location:struct<lat:double,lng:double>>>>>>>")
    df = spark.createDataFrame([("r", [{"legs": [{"steps": [step, step]}, {"steps": [step]}]}])], schema)
    rows = routes.normalise_steps(routes.explode_directions(df)).collect()
    assert [(r.leg_index, r.step_index) for r in sorted(rows, key=lambda r: (r.leg_index, r.step_index))] == [(0, 0), (0, 1), (1, 0)]
    assert {(r.instruction, tuple(r.street_names), r.maneuver_code, r.continue_text) for r in rows} == {
        ("Turn left onto A Rd", ("A Rd",), 15, "Continue for 120 meters.")}


def test_one_vote_is_no_majority(spark):
    from wayline.operators import pairwise

    vote = lambda w, e=None: ("j", w, e)
    rows = [(0, [vote("A"), vote("B", "timeout"), vote("B", "timeout")]), (1, [vote("A"), vote("A"), vote("B")]), (2, [vote("B"), vote("B"), vote("A", "x")]), (3, [vote("A"), vote("B"), vote("tie")])]
    df = spark.createDataFrame([(k, "m1", "m2", v) for k, v in rows], "k int, model_a string, model_b string, judge_votes array<struct<judge_model:string,winner:string,error:string>>")
    assert [r.majority_winner for r in pairwise.majority(df).orderBy("k").collect()] == [None, "m1", "m2", None]


def test_ratings_settle_or_fail(spark):
    from wayline.operators import pairwise

    games = spark.createDataFrame([("a", "b", "a")] * 9 + [("a", "b", "b"), ("b", "c", "b"), ("b", "c", None)], "model_a string, model_b string, majority_winner string")
    got = {r.model_id: r.rating for r in pairwise.ratings(games).collect()}
    assert got["a"] > got["b"] > got["c"] and abs(sum(got.values()) / 3 - 1000) < 1e-6
    with pytest.raises(RuntimeError):
        pairwise.ratings(games, most_rounds=2)
    with pytest.raises(ValueError):
        pairwise.ratings(games, most_models=2)


def test_unique_stream_late_and_distant_repeats(spark, tmp_path):
    from wayline.streaming import results as streams

    schema = "sample_id string, model_id string, modality string, variant string, augment string, ts timestamp"

    def land(*rows):
        cells = [(s, "m", "prior", v, None, day) for s, v, day in rows]
        spark.createDataFrame(cells, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.run_available(streams.unique_stream(arriving), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted(f"{r.sample_id} {r.variant}" for r in spark.read.parquet(f"{tmp_path}/out").collect())

    land(("a", None, "2024-03-01"), ("b", "fog", "2024-03-01"))
    land(("a", "", "2024-06-01"), ("c", None, "2024-06-01"))  # a comes again three months later
    assert run() == ["a None", "b fog", "c None"]
    land(("d", None, "2024-01-01"), ("b", "fog", "2024-01-01"), ("a", None, "2024-09-01"))  # after a restart; d is new but late
    assert run() == ["a None", "b fog", "c None", "d None"]


def test_run_counts_match_the_grid(spark):
    rng = random.Random(5)
    samples = spark.createDataFrame([(i, f"r{i % 4}" if i % 9 else None) for i in range(40)] + [(3, "r3")], "sample_id long, route_id string")
    given = spark.createDataFrame([("r0", "rain"), ("r1", "fog"), ("r2", "")], "route_id string, augment string")
    models = [{"model_id": "a/m"}, {"model_id": "b/m", "variant": ""}, {"model_id": "b/m", "variant": "v"}]
    tasks = ["prior_only", "image_prior_normal", "image_prior_augmented"]
    pick = lambda: (
        rng.choice([None, *range(45)]), rng.choice(["a/m", "b/m", "c/m"]), rng.choice(["prior", "image + prior", "video + prior"]),
        rng.choice([None, "", "v"]), rng.choice([None, "", "rain", "fog"]), rng.choice([None, None, "", "failed"]),
    )
    schema = "sample_id long, model_id string, modality string, variant string, augment string, error string"
    old, new = [pick() for _ in range(700)], [pick() for _ in range(700)]
    grid = matrix.expand_tasks(samples, models, tasks, given).collect()
    cell = lambda r: (r[0], r[1], r[2], r[3] or None, r[4] or None)
    asked = [(g.route_id, cell((g.sample_id, g.model_id, g.modality, g.variant, g.augment))) for g in grid]
    before, done = {cell(r) for r in old}, {cell(r) for r in old if not r[5]}
    want, seen = Counter(), {}
    for route, c in asked:
        for key in {(c[1], c[2], route, 0), (c[1], c[2], None, 1), (c[1], None, None, 2), (None, None, None, 3)}:
            want[key + ("all",)] += 1
            want[key + ("ok",)] += c in done
        row = seen.setdefault((c[1], c[3], c[2], c[4]), [0, 0, 0, 0])
        mine = [] if c in before else [r for r in new if cell(r) == c]
        for at, n in enumerate((1, c in before, len(mine), sum(bool(r[5]) for r in mine))):
            row[at] += n
    got = matrix.coverage(samples, models, tasks, given, spark.createDataFrame(old, schema)).collect()
    expected = Counter((k[:3], n, want[k[:4] + ("ok",)]) for k, n in want.items() if k[4] == "all")
    assert Counter(((r.model_id, r.modality, r.route_id), r.expected, r.present) for r in got) == expected
    assert all(r.missing == r.expected - r.present for r in got)
    summary = matrix.task_summary(samples, models, tasks, given, spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert {tuple(r)[:4]: list(r)[4:] for r in summary.collect()} == seen
    table = Counter((g.model_id, g.variant, g.provider, g.task, g.modality, g.augment) for g in grid)
    assert {tuple(r)[:6]: r.attempted for r in matrix.task_table(samples, models, tasks, given).collect()} == dict(table)


def test_pairs_within_a_gap_and_their_number(spark):
    rng = random.Random(8)
    names = [f"c{i % 5}/m{i}" for i in range(60)]
    rated = {n: rng.choice([-350.5, 900.0, 1000.0, 1100.0, 1300.0, 1700.25]) for n in names[:45]}
    models = spark.createDataFrame([(n,) for n in [*names, *names[:5], None]], "model_id string")
    ratings = spark.createDataFrame(list(rated.items()), "model_id string, rating double")
    pairs = pairwise.cross_company_pairs(models)
    close = pairwise.cross_company_pairs(models, ratings=ratings, max_gap=200)
    assert sorted(close.collect()) == sorted(pairwise.close_pairs(pairs, ratings, 200).select(*close.columns).collect())
    assert 0 < close.count() < pairs.count() == pairwise.pair_count(models).first()[0]
    assert pairwise.pair_count(models.limit(0)).first()[0] == 0


def test_first_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]), f"text {i}") for i in rng.sample(range(90), 60)] + [(None, "c", 1, "x")]
    df = spark.createDataFrame(rows, "n long, k string, m long, wide string")
    for last, best in ((False, min), (True, max)):
        got = ordered.first_rows(df, ["k", "m"], "n", last=last)
        want = {}
        for r in rows[:-1]:
            want[r[1:3]] = best(want.get(r[1:3], r), r, key=lambda x: x[0])
        assert got.columns == df.columns and {tuple(r) for r in got.collect()} == set(want.values()) and got.count() == len(want)
    plan = ordered.first_rows(df, ["k", "m"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
