"""Exact copies, similarity join and repeated windows against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayline.llm import components, exact_dedup, jaccard_join, substring_dedup, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_copies(docs, rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    want = {d: (max(g), len(g), d == max(g)) for g in groups.values() for d in g}
    for hash_all in (False, True):
        got = exact_dedup.exact_copies(docs, hash_all=hash_all).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)
        text = {d: t or "" for d, t, *_ in rows}
        for r in got:
            assert r.text_hash == hashlib.sha256(text[r.doc_id].encode()).hexdigest() or not hash_all and r.group_size == 1 and r.text_hash is None


def test_exact_copies_edges(docs, empty, repeated, rows):
    assert exact_dedup.exact_copies(empty).count() == 0
    got = exact_dedup.exact_copies(repeated).collect()
    assert len(got) == 2 * len(rows) + 2
    assert {r.group_size for r in got if r.doc_id == 0} == {2} and all(r.kept for r in got if r.doc_id == 0)
    kept = exact_dedup.drop_copies(repeated)
    assert kept.columns == docs.columns
    assert Counter(r.text or "" for r in kept.collect()).most_common(1)[0][1] == 1


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups_by_force(rows, percent=75):
    sets = {d: shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_similar_groups(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    want = groups_by_force(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 8  # the fixture has groups


def test_similar_groups_exact_phase(spark):
    """A chain of texts, each near the next only, and a star whose rays are far from each other."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):
        w = base[:]
        for j in range(k):
            w[j * 5] = f"x{j}"
        rows.append((k, " ".join(w), None, None, 0))
    for k in range(12):
        w = [f"v{i}" for i in range(40)]
        w[3 * k] = f"y{k}"
        rows.append((100 + k, " ".join(w), None, None, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for percent in (60, 75, 90):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs, percent=percent).collect()}
        assert got == groups_by_force(rows, percent)


def test_similar_groups_of_edited_families(spark):
    """Families of copies with few to many edits, deletions and insertions, with and without their origin."""
    import random

    rng, rows = random.Random(8), []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(70)]
        for k in range(45):
            w = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8]) if family % 2 == 0 else rng.choice([2, 3, 4])):
                at, kind = rng.randrange(len(w)), rng.randrange(6)
                if kind == 0:
                    del w[at]
                elif kind == 1:
                    w.insert(at, f"i{rng.randrange(6)}")
                else:
                    w[at] = f"e{rng.randrange(400)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w), None, None, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for percent in (75, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs, percent=percent).collect()}
        assert got == groups_by_force(rows, percent)


def test_similar_groups_edges(docs, empty, repeated, rows):
    assert jaccard_join.similar_groups(empty).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(repeated).collect()}
    assert got == groups_by_force(rows)
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {c for _, c in groups_by_force(rows).values()}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(20)] + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{50 + i: 50 for i in range(20)}, 100: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_force(rows, window):
    first, split = {}, {d: WORD.findall(t or "") for d, t, *_ in rows}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window,most_bits", [(20, 27), (20, 19), (8, 27), (6, 20)])
def test_remove_repeats(docs, rows, window, most_bits):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, window, most_bits=most_bits).collect()}
    assert got == removed_by_force(rows, window)


def test_remove_repeats_edges(empty, repeated, rows):
    assert substring_dedup.remove_repeats(empty).count() == 0
    got = substring_dedup.remove_repeats(repeated).collect()
    want = removed_by_force(rows, 20)
    assert len(got) == 2 * len(rows) + 2
    assert all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted(r.kept_text for r in got if r.doc_id is None) == ["", "no id here"]


def test_sketch_never_too_low():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    bits = 20
    table = {}
    for r, cell in enumerate(substring_dedup.cells_of(np.concatenate([grams, grams[:1000]]), bits)):
        for c in range(1 << (bits - substring_dedup.CHUNK_BITS)):
            own = cell[(cell >> np.uint64(substring_dedup.CHUNK_BITS)) == c] & np.uint64((1 << substring_dedup.CHUNK_BITS) - 1)
            n = np.minimum(np.bincount(own.astype(np.int64), minlength=1 << substring_dedup.CHUNK_BITS), 2).astype(np.uint8)
            table[r, c] = n[0::4] | (n[1::4] << 2) | (n[2::4] << 4) | (n[3::4] << 6)
    guess = substring_dedup.estimated_repeated(table, grams, bits)
    assert guess[:1000].all() and guess[1000:].mean() < 0.01


def test_anchor_depends_on_the_window_only():
    rng = np.random.default_rng(9)
    grams = rng.integers(0, 2**64, 400, dtype=np.uint64)
    at = substring_dedup.anchors(grams, 385, 16)
    for i in range(385):
        alone = substring_dedup.anchors(grams[i : i + 16], 1, 16)[0]
        assert at[i] - i == alone


def test_words_match_the_pattern(rows):
    texts = [None if t is None else t.encode() for _, t, *_ in rows] + ["\x1fa\x85b c d".encode(), b"\x0b\x0c x\ty\r\n"]
    w = words.Words(texts)
    for i, t in enumerate(texts):
        want = WORD.findall((t or b"").decode())
        lo, hi = w.first[i], w.first[i + 1]
        assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi])] == want
    h = w.hashes()
    seen = {}
    for a, b, x in zip(w.start, w.end, h):
        assert seen.setdefault(w.raw[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
