"""Spelling variants, URL verdicts and hard negatives against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wayline.llm import hard_negatives, queries, spelling, url_filter

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants


def counted(rows, least_length=6, least=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LETTERS)
            h = zlib.crc32(f"{d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least}


def variants(n):
    near, blanked = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            blanked[w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in blanked.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=(0, None))
        form[w] = best[1] if best[1] is not None and -best[0] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def collected(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_query(spark):
    sf = "/root/testdata/sf0.01"
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = variants(counted(zip(table["doc_id"], table["text"])))
    assert collected(queries.QUERIES["op11_spelling"](spark, sf)) == want and sum(w[1] is not None for w in want) > 100


def test_spelling_words(spark, monkeypatch):
    """Chains of forms, ties, accents, words around the length from which halves are compared, frequent grams."""
    monkeypatch.setattr(spelling, "MOST_FREQUENT", 30)
    rng = random.Random(7)
    syllables = ["th", "tion", "er", "an", "é", "ße", "b", "inin"]
    words = {"".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(500)}
    words |= {"a", "", "ab", "abc", "chainaa", "chainab", "chainbb"}
    for n in (198, 199, 200, 201, 5000):
        long = "".join(rng.choice("abc") for _ in range(n))
        words |= {long, long[: n // 2] + "x" + long[n // 2 :], "y" + long[1:], long + "z", long[:3] + "q" + long[4:]}
    words |= {w[:i] + rng.choice("the") + w[i + rng.randint(0, 1) :] for w in list(words) if len(w) < 100 for i in [rng.randint(0, len(w))]}
    n = {w: rng.choice([1, 1, 5, 25, 125, 625]) for w in words} | {"chainaa": 1, "chainab": 5, "chainbb": 25}
    rows = [(w, c, "x", 1, 2) for w, c in n.items()] + [("chainaa", 1, "x", 1, 2), (None, 9, "x", 1, 2), ("nothing", None, "x", 1, 2)]
    df = spark.createDataFrame(rows, "word string, n long, form string, size int, key int").repartition(3)
    got = collected(spelling.group_variants(df))
    assert got == variants(n)
    assert any(form is not None and root != form for _, form, root, *_ in got)


def test_spelling_edges(spark, empty):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.count_words(empty, spelling.edited_runs(), 6, 5).count() == 0
    long = "Straße " * 40_000 + "a" * 300_000 + " ÀÉ×÷ÿ" * 9
    rows = [(1, long), (2, None), (3, ""), (None, "Straße")] + [(i, "straßen straßE") for i in range(4, 14)]
    got = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"), spelling.edited_runs(), 3, 5).collect()}
    want = counted([(d if d is not None else "", t) for d, t in rows], 3)
    assert got == want


@given(st.lists(st.text("thern", min_size=1, max_size=9), min_size=1, max_size=40), st.integers(0, 4), st.data())
@settings(max_examples=80, deadline=None)
def test_edited_words_meet(words, floor, data):
    """A word and its edited form share a list, whatever the dictionary."""
    counts = Counter(w[i : i + q] for w in words for q in range(spelling.Q_MIN, spelling.Q_MAX) for i in range(len(w) - q + 1))
    frequent = {g: c for g, c in counts.items() if c > floor}
    tails = frozenset(g[i:] for g in frequent for i in range(1, len(g)))
    word = data.draw(st.sampled_from(words))
    at, letter = data.draw(st.integers(0, len(word))), data.draw(st.sampled_from("thernx"))
    for other in (word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]):
        if other == word:
            continue
        short, long = sorted((word, other), key=lambda w: (len(w), w))
        mine = {(size, key) for size, key, _ in spelling.keys_of(short, frequent, tails)}
        assert mine & {(size, key) for size, key, longer in spelling.keys_of(long, frequent, tails) if longer}


# URL verdicts


def judged(url, rules, blocked):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate(LETTERS)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    found = [(len(h + p), len(h), v != "allow", h + p) for h, p, v in rules if fits(h, p)]
    best = max(found, default=None)
    listed = any(fits(h, p) for h, p in blocked)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else "block" if listed else "allow"


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("both.org", "/", "allow"), ("both.org", "/", "block"), ("a.net", "/e", "allow")]
BLOCKED = [("spam.org", "/"), ("org", "/x/y"), ("EMPTY.org", "")]


def urls():
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.COM", "a.net", "b.a.net", "both.org", "x.both.org", "spam.org", "notspam.org", "empty.org", "org", "com", "", "a..com", "exämple.net", "a.com:80"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/x/y/z", "/e", "/EN/", "/en/?q=://b.com/", "?x=/en/", "#/en/", "/é/\n/en/"]
    made = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths]
    return made + [None, "", "example.com/en/", "://", "x://y://z.com/en/", "//a.net/es/", "http://" + "a." * 50_000 + "com/en/", "x" * 1_000_000, "http://spam.org/" + "x/" * 200_000, made[3], made[3]]


@pytest.mark.parametrize("bits", [url_filter.MAX_BITS, 200])
def test_judge_urls(spark, monkeypatch, bits):
    """With whole listings, and with listings cut into parts."""
    if bits == 200:
        monkeypatch.setattr(url_filter, "cascade", lambda universe, most, f=url_filter.cascade: f(universe))
    rows = [(i, u, "h", "p", "r", 1, "k") for i, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict int, key string").repartition(3)
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("org", None, "block"), ("org", "/", None)], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, rules, spark.createDataFrame(BLOCKED, "host string, path string"), ["page_id"], max_bits=bits)
    blocked = [(h.lower(), p) for h, p in BLOCKED]
    assert {tuple(r) for r in got.drop("listed_key").collect()} == {(i, *judged(u, RULES, blocked)) for i, u in enumerate(urls())}


def test_judge_urls_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules, sites = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "host string, path string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules, sites, ["page_id"]).collect()] == [(1, "a.com", "/", None, None, "allow")]
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, rules.schema), spark.createDataFrame(BLOCKED, sites.schema)).count() == 0


def test_cascade_is_exact(spark):
    """Several levels, no mistake over the universe; filters are not copied into the rows."""
    universe = spark.range(30_000).select(F.concat(F.lit("key"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    levels = url_filter.cascade(universe)
    assert len(levels) > 4
    out = url_filter._with_words(universe, levels).select("listed", url_filter._member(F.col("key"), levels).alias("found"))
    assert out.where("listed <> found").count() == 0
    with pytest.raises(ValueError):
        url_filter.cascade(universe, 1000)


def test_no_python_in_the_filter(spark):
    plan = queries.QUERIES["op12_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


# hard negatives


def mined(rows, anchor, positives, negatives, low=50, high=95):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, label, v in rows:
        if not anchor(i):
            continue
        scores = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scores if x[2] == label][:positives]:
            fits = [(k, -t) for t, k, other in scores if other != label and low * -s <= 100 * -t <= high * -s]
            out |= {(i, j, r + 1, k, -s, t) for r, (k, t) in enumerate(fits[:negatives])}
    return out


@pytest.mark.parametrize("dims, spread, block", [(16, 40, 64), (1, 3, 4096), (9, 2**28, 32)])
def test_mine(spark, monkeypatch, dims, spread, block):
    """Random vectors with copies, short ones, zero and negative scores, numbers over 32 bits; several blocks and parts."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rng = random.Random(dims)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 7]), [rng.randint(-spread, spread) for _ in range(dims)]) for i in range(600)]
    rows += [(600 + i, i % 3, rows[5][2]) for i in range(60)] + [(700, 0, []), (701, 1, [3]), (702, 99, rows[5][2]), (750, 55, [0] * dims)]
    extra = [(*r, 1, 2, "x") for r in rows + rows[:9]] + [(None, 1, [1] * dims, 1, 2, "x"), (50, 9, [1] * dims, 1, 2, "x"), (800, None, [1], 1, 2, "x"), (850, 1, None, 1, 2, "x"), (851, 1, [None], 1, 2, "x")]
    rows = [r if r[0] != 50 or r[1] <= 9 else (50, 9, [1] * dims) for r in rows]
    df = spark.createDataFrame(extra, "vec_id long, label int, dims array<long>, part int, score int, kind string").repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 25 == 0, 4, 3, rows_per_part=150).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == mined(rows, lambda i: i % 25 == 0, 4, 3)


def test_mine_edges(spark):
    schema = "vec_id long, label int, dims array<long>"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    alone = spark.createDataFrame([(1, 1, [5]), (2, 1, [4])], schema)
    assert hard_negatives.mine(alone, F.lit(True)).count() == 0 and hard_negatives.mine(alone, F.lit(False)).count() == 0


def test_negatives_query_drops_odd_numbers(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 2, [1.0 + i / 100, 0.5]) for i in range(1, 101)] + [(150, 1, [nan, 1.0]), (200, 1, [inf, 1.0]), (250, None, [1.0, 1.0]), (300, 1, None), (350, 0, [1.0, None])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.anchor_id for r in queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()}
    assert got <= {50, 100}
