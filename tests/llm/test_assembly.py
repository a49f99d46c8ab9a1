"""Mixing, packing, tool calls and the pipeline."""

import json
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from wayline.llm import best_fit, mixing, tool_calls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


@given(st.lists(st.integers(0, 10_000), max_size=9))
@settings(max_examples=60, deadline=None)
def test_targets_share_everything(sizes):
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
    open_ = [t / w for t, s, w in zip(got, sizes, [5, 2, 1] * 3) if t < 3 * s - 1e-6]
    assert not open_ or max(open_) == pytest.approx(min(open_))


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    k = np.arange(n)
    got = mixing.permuted(k, np.full(n, n), np.full(n, key, np.uint64))
    assert sorted(got.tolist()) == k.tolist()


def test_shard_draws():
    slots = [1000, 0, 37, 5]
    draws = mixing.shard_draws(slots, 64, 3)
    total, first = defaultdict(int), defaultdict(int)
    for shard, s, lo, n in draws:
        assert lo == first[s]
        first[s] += n
        total[shard] += n
    assert [first[s] for s in range(4)] == slots and set(list(total.values())[:-1]) == {64}


def test_mix(docs, rows):
    got = {r.doc_id: r for r in mixing.mix(docs, block=8).collect()}
    sizes, source = {d: len(WORD.findall(t or "")) for d, t, *_ in rows}, {d: s for d, _, _, s, _ in rows}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    per = [sum(n for d, n in sizes.items() if source[d] == s) for s in names]
    wanted = dict(zip(names, mixing.targets(per)))
    taken = defaultdict(int)
    for d, r in got.items():
        assert (r.size, r.source_size) == (sizes[d], per[names.index(source[d])]) and r.target == pytest.approx(wanted[source[d]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[d]] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - wanted[s]) <= 16 for s in names)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), block=8).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_mix_edges(docs, empty, repeated, rows):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(repeated).count() == 2 * len(rows) + 2
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 and counts[next(d for d, t, *_ in rows if t is None)] == 1
    assert mixing.mixed_documents(repeated).columns == docs.columns


def check_packing(pieces, capacity):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_pack_documents(docs, rows):
    for capacity in (64, 2048):
        got = best_fit.pack_documents(docs, capacity).collect()
        encoder = best_fit.Encoder(best_fit.default_files()[0], None)
        by = defaultdict(list)
        for p in got:
            by[p.doc_id].append(p)
        import zlib

        for d, t, *_ in rows:
            ids = np.array([*encoder.ids(t or ""), 0], "<u4")
            pieces = sorted(by[d], key=lambda p: p.piece)
            assert [p.piece for p in pieces] == list(range(len(pieces)))
            at = 0
            for k, p in enumerate(pieces):
                assert p.start == at and (k == 0 or p.length == capacity) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
        assert check_packing(got, capacity) == best_fit_decreasing([p.length for p in got], capacity)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
@settings(max_examples=80, deadline=None)
def test_supersteps_are_best_fit(counts):
    runs = best_fit.supersteps(counts, 50)
    used = defaultdict(list)
    for length, rank, n, first, offset in runs:
        for k in range(n):
            used[first + k].append((offset, length))
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 50
    assert sum(len(v) for v in used.values()) == sum(counts.values())
    assert len(used) == best_fit_decreasing([s for s, n in counts.items() for _ in range(n)], 50)


def test_pack_edges(empty, repeated, rows):
    assert best_fit.pack_documents(empty).count() == 0
    got = best_fit.pack_documents(repeated).collect()
    check_packing(got, 2048)
    assert sum(p.doc_id is None for p in got) == 2


@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("‐’“… '\n")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_both_tokenizers_agree(text):
    both = test_both_tokenizers_agree.__dict__.setdefault("both", (best_fit.Encoder(*best_fit.default_files()), best_fit.Encoder(best_fit.default_files()[0], None)))
    assert both[0].ids(text) == both[1].ids(text)


def test_tokenizer_odd_texts():
    fast, slow = best_fit.Encoder(*best_fit.default_files()), best_fit.Encoder(best_fit.default_files()[0], None)
    for text in ["<|endoftext|>", "a<|endoftext|>b ", "漢字 かな 🎉", "x" * 9000, " " * 9000 + "y", "\u0085᠎ ", "﻿"]:
        assert fast.ids(text) == slow.ids(text)


CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = "tool string, name string, type string, required boolean, min_length int, max_length int"


@pytest.fixture(scope="module")
def linked(spark):
    calls = [
        (1, "c", 5, "find", '{"q": "x", "n": 2}', ["b", "a"]), (1, "a", 1, "find", '{"n": 1.5, "q": "y"}', None), (1, "b", 3, "find", '{"q": 7}', ["a"]),
        (1, "d", 2, "find", '{"q": "", "z": {"b": 1, "a": [2, {"y": 1, "x": null}]}}', ["nowhere"]), (2, "a", 0, "find", "{broken", []), (2, "l", 1, "other", "{}", ["m"]), (2, "m", 2, "find", "[1]", ["l"]),
        (3, "a", 4, "find", '{"q":"late"}', None), (3, "a", 1, "find", '{"q":"early"}', None), (3, None, 1, "find", '{"q":"x"}', None), (4, "v", 1, "find", '{"q": null}', ["v"]),
    ]
    results = [(1, "a", 9, "late"), (1, "a", 2, "first \"é\"\n"), (1, "c", 6, None), (2, "zz", 1, "lost"), (3, None, 2, "nameless"), (1, "b", 4, "ok")]
    schemas = [("find", "q", "string", True, 1, 10), ("find", "n", "integer", False, 0, 0)]
    out = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, SCHEMAS)).collect()
    return {(r.conv_id, r.call_id, r.turn): r for r in out}


def test_tool_calls(linked):
    a, b, c, d = (linked[1, k, t] for k, t in (("a", 1), ("b", 3), ("c", 5), ("d", 2)))
    assert (a.level, b.level, c.level, d.level) == (0, 1, 2, 0)
    assert a.errors == ["type of n"] and b.errors == ["type of q"] and c.errors == []
    assert d.errors == ["too short q", "unknown z", "no result", "waits for unknown call"]
    assert a.n_results == 2 and a.json == '{"arguments":{"n":1.5,"q":"y"},"call_id":"a","result":"first \\"é\\"\\n","tool":"find"}'
    assert json.loads(d.json)["arguments"]["z"] == {"a": [2, {"x": None, "y": 1}], "b": 1} and '"z":{"a":[2,{"x":null,"y":1}],"b":1}' in d.json
    assert json.loads(c.json) == {"arguments": {"n": 2, "q": "x"}, "call_id": "c", "result": None, "tool": "find"} and c.linked


def test_tool_calls_edges(spark, linked):
    assert linked[2, "a", 0].errors == ["malformed arguments", "no result"] and json.loads(linked[2, "a", 0].json)["arguments"] is None
    assert linked[2, "l", 1].errors == ["unknown tool", "no result", "cyclic order"] and linked[2, "m", 2].errors[:1] == ["malformed arguments"] and linked[2, "m", 2].level is None
    assert linked[3, "a", 4].errors == ["repeated identifier"] and linked[3, "a", 1].level == 0
    assert linked[3, None, 1].errors == ["no identifier"] and linked[3, None, 2].errors == ["result without call"] and linked[2, "zz", 1].errors == ["result without call"]
    assert linked[4, "v", 1].level is None and "missing q" in linked[4, "v", 1].errors
    none = tool_calls.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCHEMAS))
    assert none.count() == 0


def leveled(waits):
    """Levels by repeated settling; calls on or behind a cycle have none."""
    level = {}
    while True:
        new = {c: 1 + max((level[a] for a in after), default=-1) for c, after in waits.items() if c not in level and all(a in level for a in after)}
        if not new:
            return level
        level |= new


def test_levels(spark, monkeypatch, turns=8, block=5):
    """Long chains, chains against the order of turns, turns that repeat, cycles and random graphs."""
    import random

    monkeypatch.setattr(tool_calls, "TURNS", turns)
    monkeypatch.setattr(tool_calls, "BLOCK", block)
    rng = random.Random(turns)
    graphs = {
        "chain": {i: [i - k for k in (1, 2) if i >= k] for i in range(150)},
        "back": {i: [i + 1] if i < 5 else [] for i in range(6)},
        "cycle": {i: [(i + 1) % 9] if i < 9 else [i - 1] if i % 2 else [] for i in range(20)},
        "self": {0: [0], 1: [0], 2: []},
        "random": {i: rng.sample(range(i), min(i, rng.randint(0, 3))) for i in range(40)},
        "mixed": {i: rng.sample(range(30), rng.randint(0, 2)) for i in range(30)},
    }
    turn = lambda g, i: None if g == "self" else i // 7 if g == "random" else i
    calls = [(g, str(i), turn(g, i)) for g, waits in graphs.items() for i in waits]
    edges = [(g, str(i), str(a)) for g, waits in graphs.items() for i, after in waits.items() for a in after]
    got = tool_calls.levels(spark.createDataFrame(calls, "conv_id string, call_id string, turn int").repartition(3), spark.createDataFrame(edges, "conv_id string, call_id string, after string"))
    assert {(r.conv_id, int(r.call_id)): r.level for r in got.collect()} == {(g, i): n for g, waits in graphs.items() for i, n in leveled(waits).items()}


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.reject_toxic(spark, docs, sf)
    labels = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert len(labels - kept) <= 0.02 * len(labels) and clean.columns == docs.columns
    unique = corpus_pipeline.drop_exact_copies(spark, clean, sf)
    want = {}
    for r in clean.collect():
        want[r.text or ""] = max(r.doc_id, want.get(r.text or "", -1))
    assert {r.doc_id for r in unique.collect()} == set(want.values()) and unique.columns == docs.columns
    from test_dedup import groups_by_force

    single = corpus_pipeline.drop_near_copies(spark, unique, sf)
    assert {r.doc_id for r in single.collect()} == {c for _, c in groups_by_force([(r.doc_id, r.text) for r in unique.collect()]).values()}
    mixed = corpus_pipeline.mix_sources(spark, single, sf)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * single.count()
    check_packing(corpus_pipeline.pack_sequences(spark, mixed, sf).collect(), 2048)


def test_pipeline_runs_whole(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    check_packing(corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect(), 2048)
