import math
import random

import pytest
from pyspark.sql import functions as F

from wayline import fixed
from wayline.functions import frames as fr
from wayline.functions import geo
from wayline.functions import normalize as N
from wayline.functions import scores as S
from wayline.functions import text as T


def test_weights_sum_to_one():
    for weights in (fixed.COMPOSITE_WEIGHTS_V1, fixed.COMPOSITE_WEIGHTS_V2, fixed.TOTAL_WEIGHTS):
        assert math.isclose(sum(weights.values()), 1.0)


def test_clamp_targets(one):
    got = one(fr.clamp_targets(F.col("d"), [100, 80, 60, 40]), [(180.0,), (70.0,), (23.0,), (0.0,), (None,)], "d double")
    assert got == [[100, 80, 60, 40], [70, 60, 40], [23], [], []]


def test_spaced_targets(one):
    rows = [(23.0, 5.0, None, 5.0), (4.0, 5.0, None, 5.0), (500.0, 20.0, 150.0, 30.0), (80.0, 20.0, 150.0, 30.0),
            (50.0, 20.0, 10.0, 30.0), (0.4, 5.0, None, 5.0)]
    got = one(fr.spaced_targets(*map(F.col, "dgse")), rows, "d double, g double, s double, e double")
    assert got == [[23, 18, 13, 8, 5], [4], [150, 130, 110, 90, 70, 50, 30], [80, 60, 40, 30], [30], [1]]


def test_targets_fall_and_stay_in_the_step(spark):
    random.seed(1)
    rows = [(random.uniform(0.1, 400), random.uniform(0, 40), random.uniform(0, 500), random.uniform(0, 60)) for _ in range(300)]
    df = spark.createDataFrame(rows, "d double, g double, s double, e double")
    for r in df.select("d", fr.spaced_targets(*map(F.col, "dgse")).alias("t")).collect():
        assert r.t == sorted(set(r.t), reverse=True)
        assert all(0 < v <= max(1, round(r.d)) for v in r.t)


def test_unknown_profile_is_an_error(one):
    with pytest.raises(Exception, match="unknown frame profile"):
        one(fr.profile_distances(F.col("d"), F.lit("nine")), [(5.0,)], "d double")


def test_format_eta(one):
    got = one(N.format_eta(F.col("m")), [(10.2,), (60.0,), (89.8,), (-3.0,), (None,)], "m double")
    assert got == ["10m", "1h", "1h 30m", "0m", "--"]


def test_numbers_with_one_decimal_round_like_binary(one):
    values = [k / 1000 for k in range(1000, 10000, 7)] + [1.05, 1.15, 1.25, 1.35, 2.675, 9.95, 9.949999]
    got = one(N.format_distance(F.col("m") * 1000), [(v,) for v in values], "m double")
    assert got == [f"{(v * 1000) / 1000.0:.1f} km" for v in values]


def test_frame_names(one):
    name = N.frame_filename(F.lit("brisbane_route001"), F.lit(0), F.col("rem"), F.col("d"))
    assert one(name, [(80, 100), (1500, 1200)], "rem int, d int") == [
        "brisbane_route001_step000_020m_080m.jpg", "brisbane_route001_step000_000m_1500m.jpg"]
    parsed = N.parse_frame_filename(F.col("n"))
    got = one(parsed, [("frames/a_b_step012_0020m_080m.jpg",), ("x_step12_1m_2m.jpg",), ("r_step000_5m_xm.png",), ("r_step000_5m.png",)], "n string")
    assert [tuple(g) for g in got] == [(20, 80), (0, 0), (5, 0), (0, 0)]


def test_street_names(one):
    rows = ["Turn left onto A1/B Rd toward City, then on", "Continue on M1. Partial toll", "Head north", "Keep ON X/Long Rd"]
    got = one(N.street_names(F.col("t")), [(r,) for r in rows], "t string")
    assert got == [["A1", "B Rd"], ["M1"], [], ["Long Rd"]]


def test_lane_change(one):
    got = one(N.lane_change_flag(F.col("v")), [("yes",), (" YES ",), ("no",), ("unknown",), ("true",), (None,)], "v string")
    assert got == [True, True, False, False, True, None]


def test_split_latlon(one):
    got = one(N.split_latlon(F.col("v")), [("1.5,2",), ("1; -2.5",), ("3 4",), ("1,2,3",), ("x,1",)], "v string")
    assert [None if g is None else tuple(g) for g in got] == [(1.5, 2.0), (1.0, -2.5), (3.0, 4.0), None, (None, 1.0)]


def test_response_fields(one):
    raw = ['{"enhanced_instruction": "A", "lane_change_required": true}', "```json\n{\"next_action\": \"uturn\"}\n```",
           '<think>{"x": 1}</think> nothing', '{"a": 1} and {"b": 2}', None]
    got = one(N.response_fields(F.col("r"), F.lit("prior")), [(r,) for r in raw], "r string")
    assert [(g.enhanced_instruction, g.lane_change_required, g.next_action) for g in got] == [
        ("A", "true", "unknown"), ("prior", "no", "uturn"), ("prior", "no", "unknown"), ("prior", "no", "unknown"), ("prior", "no", "unknown")]


def test_polyline_vector(one):
    encoded = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    got = one(geo.decode_polyline(F.col("e")), [(encoded,), (encoded[:-1],), (encoded + "?",), ("",), (None,), ("~" * 17 + "??",), ("~" * 8 + "??",)], "e string")
    assert [tuple(p) for p in got[0]] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert got[1:] == [[]] * 6  # also numbers too long for a coordinate


@pytest.mark.parametrize("precision", [5, 6])
def test_polyline_round_trip(spark, precision):
    random.seed(precision)
    rows = []
    for k in range(60):
        rows.append((k, [(round(random.uniform(-90, 90), precision), round(random.uniform(-180, 180), precision)) for _ in range(k % 9)]))
    df = spark.createDataFrame(rows, f"k int, p {geo.POINTS}")
    out = df.select("p", geo.decode_polyline(geo.encode_polyline(F.col("p"), precision), precision).alias("q")).collect()
    for r in out:
        assert [(round(a.lat, precision), round(a.lng, precision)) for a in r.q] == [tuple(p) for p in r.p]


def _haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def test_lengths_and_poses(spark):
    pts = [(0.0, 0.0), (0.0, 0.001), (0.001, 0.001)]
    df = spark.createDataFrame([(pts,)], f"p {geo.POINTS}")
    r = df.select(
        geo.path_length(F.col("p")).alias("n"),
        geo.poses_at_remaining(F.col("p"), F.lit(0.0), F.array(F.lit(0.0), F.lit(55.0), F.lit(1e9))).alias("q"),
    ).head()
    total = _haversine(pts[0], pts[1]) + _haversine(pts[1], pts[2])
    assert math.isclose(r.n, total)
    end, middle, start = r.q
    assert (end.lat, end.lng) == pts[2] and abs(end.heading) < 1e-6
    assert middle.lng == 0.001 and 0 < middle.lat < 0.001
    assert (start.lat, start.lng) == pts[0] and math.isclose(start.heading, 90.0)


def test_lanes_and_sets(one):
    got = one(S.score_lanes(F.col("p"), F.col("g")), [(3, 3), (3, 4), (3, 5), (None, 3), (3, None)], "p int, g int")
    assert got == [1.0, 0.5, 0.0, 0.0, None]
    rows = [([], []), ([], ["a"]), (["A "], ["a"]), (None, None), (["a", "b"], ["b", "c"])]
    got = one(S.set_jaccard(F.col("p"), F.col("g")), rows, "p array<string>, g array<string>")
    assert got == [1.0, 0.0, 1.0, 1.0, 1 / 3]


def test_latency_tiers(one):
    got = one(S.latency_reward(F.col("ms")), [(4999,), (5000,), (24999,), (25000,), (None,)], "ms int")
    assert got == [1.0, 0.8, 0.2, 0.0, 0.0]


def test_fuzzy_items_count_once(one):
    parts = S.set_prf_fuzzy(F.col("p"), F.col("g"))
    rows = [(["red shop", "the red shop"], ["red shop", "bridge"]), ([], []), (["x"], []), ([" "], ["x"])]
    got = one(F.struct(parts["precision"], parts["recall"], parts["f1"]), rows, "p array<string>, g array<string>")
    assert [tuple(g) for g in got] == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)]


# --- text measures against plain loops -------------------------------------------


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _bag(tokens, n):
    out = {}
    for i in range(len(tokens) - n + 1):
        g = tuple(tokens[i:i + n])
        out[g] = out.get(g, 0) + 1
    return out


def test_overlaps_match_brute_force(spark):
    random.seed(7)
    texts = [" ".join(random.choice("aa bb cc dd ee".split()) for _ in range(random.randint(0, 40))) for _ in range(160)]
    rows = [(i, texts[2 * i], texts[2 * i + 1]) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, p string, r string")
    for r in T.with_overlap(df, F.col("p"), F.col("r"), T.space_tokens, "_").collect():
        p, q = r.p.split(), r.r.split()
        assert (r._np, r._nr, r._lcs) == (len(p), len(q), _lcs(p, q))
        for n in range(1, 5):
            a, b = _bag(p, n), _bag(q, n)
            assert r[f"_m{n}"] == sum(min(c, b.get(g, 0)) for g, c in a.items())


def test_tokenizers(one):
    text = "Ça va Über-Straße  no_1"
    assert one(T.space_tokens(F.col("t")), [(text,)], "t string") == [["ça", "va", "über-straße", "no_1"]]
    assert one(T.word_tokens(F.col("t")), [(text,)], "t string") == [["a", "va", "ber", "stra", "e", "no_1"]]


def test_bleu_zeroes_higher_orders(spark):
    df = spark.createDataFrame([("a b c d", "a c b d"), ("a", "a"), ("", "a")], "p string, r string")
    out = T.with_overlap(df, F.col("p"), F.col("r"), T.space_tokens, "_", lcs=False)
    got = [tuple(r) for r in out.select(*[T.bleu("_", n) for n in range(1, 5)]).collect()]
    assert got == [(1.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
