"""Toxicity by a learned lexicon, matched with edits and weighed by its context.

The lexicon (whole words, and stems that begin words) is learned from labelled
documents. Its trie is intersected with a Levenshtein automaton: a state is a set
of (trie node, edits so far), transitions are made when first needed and kept, so
each new word costs one step per character. A hit counts less inside a quotation
or after a reporting verb, and more next to a second person.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayline.llm import words
from wayline.llm.workers import released
from wayline.workspace import written

C = F.col
WORD = re.compile(r"[^\W_]+")
STEM_LENGTHS = range(3, 8)
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says wrote called quote quoted quoting quotes allegedly sagte schrieb nannte zitat dit écrit appelé cite dijo escribió llamó cita".split())
SECOND_PERSON = frozenset("you your youre u du dich dir dein tu toi ton vous votre tú te usted eres".split())
WINDOW = 8
N_FEATURES = 4


def features_of(text: str) -> dict[str, float]:
    """Share of a text's words that are a word ('idle$') or begin with a stem ('^idl')."""
    counts = Counter(WORD.findall(text.lower()))
    one = 1.0 / max(1, sum(counts.values()))
    found: dict[str, float] = {}
    for w, n in counts.items():
        found[w + "$"] = n * one
        for k in STEM_LENGTHS:
            if len(w) > k:
                found["^" + w[:k]] = found.get("^" + w[:k], 0.0) + n * one
    return found


def allowed_edits(term: str, stem: bool) -> int:
    return 0 if stem and len(term) < 6 or len(term) < 5 else 1 if len(term) < 9 else 2


#: what an automaton remembers before it starts afresh (some 100 MB)
MOST_WORDS, MOST_STEPS = 150_000, 400_000


class Automaton:
    """Levenshtein automaton intersected with the trie of a lexicon.

    With any_first edits may fall on every letter; without, the first letter must
    be right and edits are counted behind it.
    """

    def __init__(self, terms: list[tuple[str, bool]], any_first: bool = False):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.terms = terms
        self.edits = [allowed_edits(t, s) for t, s in terms]
        for i, (term, _) in enumerate(terms):
            node = 0
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][ch]
            self.ends[node].append(i)
        self.reach = [max((self.edits[i] for i in ends), default=-1) for ends in self.ends]  # most edits of a term at or below the node
        for node in reversed(range(len(self.children))):
            self.reach[node] = max([self.reach[node], *(self.reach[c] for c in self.children[node].values())])
        self.any_first = any_first
        self.seen: dict[str, tuple[tuple[int, int], ...]] = {}
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.dead = self._number({})
        self.start = self._number(self._close({0: 0}))

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
        return self.numbers[key]

    def _close(self, state: dict[int, int]) -> dict[int, int]:
        """Skip letters of the lexicon, one edit each; keep the fewest edits per node."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if state.get(node) == e:
                for child in self.children[node].values():
                    if e + 1 < state.get(child, self.reach[child] + 1):
                        state[child] = e + 1
                        todo.append((child, e + 1))
        return state

    def _step(self, number: int, ch: str) -> int:
        key = (number, ch)
        if key not in self.steps:
            out: dict[int, int] = {}

            def put(node, e):
                if e < out.get(node, self.reach[node] + 1):
                    out[node] = e

            for node, e in self.states[number].items():
                put(node, e + 1)
                for letter, child in self.children[node].items():
                    put(child, e + (letter != ch))
            self.steps[key] = self._number(self._close(out))
        return self.steps[key]

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of every lexicon entry within its allowed edits of the word."""
        known = self.seen.get(word)
        if known is not None:
            return known
        best: dict[int, int] = {}
        if self.any_first and word:
            state = self._step(self.start, word[0])
        else:
            first = self.children[0].get(word[:1])
            state = self.dead if first is None else self._number(self._close({first: 0}))
        if state != self.dead:
            for at in range(1, len(word) + 1):
                for node, e in self.states[state].items():
                    for term in self.ends[node]:
                        if e <= self.edits[term] and (at < len(word) if self.terms[term][1] else at == len(word)):
                            best[term] = min(e, best.get(term, e))
                if at == len(word) or state == self.dead:
                    break
                state = self._step(state, word[at])
        if len(self.seen) > MOST_WORDS:
            self.seen.clear()
        if len(self.steps) > MOST_STEPS:
            self._forget()
        self.seen[word] = out = tuple(sorted(best.items()))
        return out


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)  # text, whether it is a stem
    weights: list[float] = field(default_factory=list)  # exact hits
    fuzzy: list[float] = field(default_factory=list)  # hits with edits
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))


def hits_of(text: str, automaton: Automaton) -> tuple[list[tuple[int, int, float, int]], int]:
    """(term, edits, context factor, character) of every hit in the text, and the number of words."""
    low = text.lower()
    tokens = WORD.findall(low)
    toxic = {w for w in set(tokens) if automaton.match(w)}
    if not toxic:
        return [], len(tokens)
    out = []
    marks, at = 0, 0  # quote marks of the line before position `at`; every character is counted once
    for i, m in enumerate(WORD.finditer(low)):
        if m.group() not in toxic:
            continue
        line = low.rfind("\n", at, m.start()) + 1
        if line:
            marks, at = 0, line
        marks, at = marks + sum(low.count(q, at, m.start()) for q in QUOTES), m.start()
        quoted = marks % 2 == 1
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        aimed = not SECOND_PERSON.isdisjoint(near)
        reported = not REPORTING.isdisjoint(tokens[max(0, i - WINDOW) : i])
        factor = 0.25 if quoted or reported and not aimed else 1.25 if aimed else 1.0
        for term, edits in automaton.match(m.group()):
            out.append((term, edits, factor, m.start()))
    return out, len(tokens)


def tally(hits: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int]]:
    """(term, whether edited, context factor, number) of a document's hits: at most six rows per term."""
    return [(*k, n) for k, n in sorted(Counter((t, int(e > 0), f) for t, e, f, _ in hits).items())]


def vector(tallied: list[tuple[int, int, float, int]], n_words: int, model: Model) -> list[float]:
    worth = [(f * (model.fuzzy[t] if e else model.weights[t]), n) for t, e, f, n in tallied]
    worth = [(w, n) for w, n in worth if w > 0]
    total = sum(w * n for w, n in worth)
    kinds = len({t for t, _, f, _ in tallied if f >= 1})
    return [math.log1p(total), max((w for w, _ in worth), default=0.0), math.log1p(kinds), math.log1p(100.0 * total / max(1, n_words))]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(toxic, text) of at most per_class labelled documents of each class, chosen by a hash of the id.

    Only the ids are sampled and broadcast (2 x per_class numbers), so the texts
    are not shuffled. A document with several labels is toxic if one says so.
    """
    marks = labels.where(C("toxic").isNotNull() & C("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id", F.lit("toxicity"))
    ids = marks.where("toxic >= 1").orderBy(by_hash, "doc_id").limit(per_class).unionByName(marks.where("toxic < 1").orderBy(by_hash, "doc_id").limit(per_class))
    return written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "text"), "labelled")


def _counted(sample: DataFrame) -> DataFrame:
    """Per feature: documents that have it, and its shares summed over them; summed in each task before the shuffle."""

    def rows(seen: dict[str, list[float]]) -> pa.RecordBatch:
        n, share = zip(*seen.values()) if seen else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(n, pa.float64()), pa.array(share, pa.float64())], ["feature", "n", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[float]] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for f, share in features_of(text).items():
                    at = seen.setdefault(f, [0.0, 0.0])
                    at[0] += 1
                    at[1] += share
                if len(seen) > 100_000:
                    yield rows(seen)
                    seen = {}
        yield rows(seen)

    counted = sample.select("text").mapInArrow(released(run), "feature string, n double, share double")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"), F.round(F.sum("share"), 9).alias("share"))


def pure_features(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, odds: float) -> dict[str, float]:
    """Toxic documents of every feature that is common enough in them and rare enough in clean ones; all features are tested, in Spark."""
    least = max(3, n_toxic // 100)
    both = _counted(toxic).where(C("n") >= least).join(_counted(clean).select("feature", C("n").alias("b"), C("share").alias("also")), "feature", "left").na.fill(0.0, ["b", "also"])
    # two clean documents with the usual share are assumed: a few toxic ones alone prove nothing
    rarer = F.log(C("share") / n_toxic) - F.log((C("also") + 2 * C("share") / C("n")) / n_clean)
    ratio = F.log((C("n") + 0.5) / (n_toxic + 1)) - F.log((C("b") + 0.5) / (n_clean + 1))
    return {r["feature"]: r["n"] for r in both.where((rarer >= odds) & (ratio >= odds / 3)).select("feature", "n").collect()}


def specific(pure: dict[str, float], share: float = 0.8) -> list[tuple[str, bool, float]]:
    """From each family of a pure stem and what continues it, the longest entry that keeps most of its documents."""
    roots = [f for f in pure if f[0] == "^" and not any(f[:k] in pure for k in range(2, len(f)))]
    after: dict[str, list[str]] = {}  # stem: the stems one letter longer; beginning of a word: the words
    for f in pure:
        for begin in [f[:-1]] if f[0] == "^" else {f[:k] for k in STEM_LENGTHS}:
            after.setdefault(begin, []).append(f)
    chosen = {}
    for root in roots:
        at, n = root, pure[root]
        while True:
            longer = [(f, pure[f]) for f in after.get(at, ()) if pure[f] >= share * n]
            whole = [(f, pure[f]) for f in after.get(at[1:], ()) if pure[f] >= share * n]
            if whole:
                at = max(whole, key=lambda x: (x[1], x[0]))[0]
                break
            if not longer:
                break
            at = max(longer, key=lambda x: (x[1], x[0]))[0]
        chosen[at] = pure[at]
    for f in pure:  # words too short to have a stem of their own, or under no pure stem
        if f[-1] == "$" and not any("^" + f[:k] in pure for k in STEM_LENGTHS if k < len(f) - 1):
            chosen[f] = pure[f]
    return [(f.strip("^$"), f[0] == "^", n) for f, n in sorted(chosen.items())]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, odds: float = 2.5) -> Model:
    """Learn lexicon and weights from at most per_class documents of each class.

    What reaches the driver: the pure features (a part of the sample's vocabulary),
    the tally of each sampled document. Without a labelled document of both classes the model
    scores everything 0.
    """
    sample = labelled_sample(docs, labels, per_class)
    toxic, clean = sample.where("toxic >= 1"), sample.where("toxic < 1")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Model()
    ratio = lambda t, b: math.log((t + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
    pure = pure_features(toxic, clean, n_toxic, n_clean, odds)
    terms = specific(pure)
    terms = sorted(terms, key=lambda t: (-t[2], t[0]))
    if not terms:
        return Model()
    model = Model([(t, s) for t, s, _ in terms], [1.0] * len(terms), [1.0] * len(terms))
    rows = _hits(sample, model)
    keep = covering([r for r in rows if r[0]], len(terms))
    model = Model([model.terms[i] for i in keep], [1.0] * len(keep), [1.0] * len(keep))
    rows = _hits(sample, model)
    seen = {(i, kind): [0, 0] for i in range(len(keep)) for kind in (0, 1)}
    for label, _, hits in rows:
        for i, kind in {(t, int(e > 0)) for t, e, _, _ in hits}:
            seen[i, kind][label] += 1
    model.weights = [ratio(seen[i, 0][1], seen[i, 0][0]) for i in range(len(keep))]
    model.fuzzy = [max(0.0, ratio(seen[i, 1][1], seen[i, 1][0])) if sum(seen[i, 1]) else model.weights[i] / 2 for i in range(len(keep))]
    x = np.array([vector(hits, n, model) for _, n, hits in rows])
    model.scale = np.maximum(x.max(axis=0), 1e-9)
    model.beta = logistic(x / model.scale, np.array([r[0] for r in rows], float))
    return model


def _hits(sample: DataFrame, model: Model) -> list[tuple[int, int, list[tuple[int, int, float, int]]]]:
    """(label, words, tally of all hits) of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms, any_first=True)
        for batch in batches:
            rows = []
            for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                hits, n = hits_of(text, automaton)
                rows.append({"label": int(label >= 1), "n": n, "hits": [x for h in tally(hits) for x in map(float, h)]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("label", pa.int32()), ("n", pa.int64()), ("hits", pa.list_(pa.float64()))]))

    got = sample.mapInArrow(released(run), "label int, n bigint, hits array<double>").collect()
    four = lambda v: [(int(v[i]), int(v[i + 1]), v[i + 2], int(v[i + 3])) for i in range(0, len(v), 4)]
    return sorted(((r["label"], r["n"], four(r["hits"])) for r in got), key=repr)


def covering(rows: list, n_terms: int, times: int = 4) -> list[int]:
    """Fewest terms, greedily, that hit every toxic document up to `times` times; leaves chance companions out."""
    docs = [{t for t, e, _, _ in hits if not e} for _, _, hits in rows]
    need = [min(times, len(d)) for d in docs]
    of: dict[int, list[int]] = {}
    for i, d in enumerate(docs):
        for t in d:
            of.setdefault(t, []).append(i)
    kept: list[int] = []
    while of:
        gain = {t: sum(need[i] > 0 for i in ids) for t, ids in of.items()}
        best = max(gain, key=lambda t: (gain[t], -t))
        if not gain[best]:
            break
        kept.append(best)
        for i in of.pop(best):
            need[i] -= need[i] > 0
    return sorted(kept)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Class-balanced logistic regression by Newton's method; the last coefficient is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge @ beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def scores_of(texts: list[str | None], model: Model, automaton: Automaton) -> tuple[np.ndarray, list]:
    """Score and hits of each text."""
    found = [hits_of(t or "", automaton) if model.terms else ([], 0) for t in texts]
    x = np.array([vector(tally(h), n, model) for h, n in found]).reshape(len(found), N_FEATURES) / model.scale
    z = np.clip(x @ model.beta[:-1] + model.beta[-1], -30, 30)
    return 1 / (1 + np.exp(-z)) if model.terms else np.zeros(len(found)), [h for h, _ in found]


def keep_below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs that score below the limit, all columns as given; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value.terms, any_first=True)
        for batch in batches:
            for part in words.slices(batch):
                p, _ = scores_of(part.column("text").to_pylist(), shared.value, automaton)
                yield part.filter(pa.array(p < limit))

    return docs.mapInArrow(released(run), docs.schema)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, carried columns, score and hits for every whole text of docs(doc_id, text).

    hits: array of (term, edits, quoted, at), at in code points of the lower-case
    text. A null text counts as empty; a text without a hit gets the score of no
    evidence. Without a learned lexicon every score is 0. Repeated rows repeat;
    other columns are ignored.
    """
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few terms for each sampled toxic document
    hit_type = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        automaton = Automaton(m.terms, any_first=True)
        for batch in batches:
            for part in words.slices(batch):
                p, found = scores_of(part.column("text").to_pylist(), m, automaton)
                hits = [[{"term": m.terms[t][0], "edits": e, "quoted": f < 1, "at": at} for t, e, f, at in h] for h in found]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ["doc_id", *carry]), pa.array(p, pa.float64()), pa.array(hits, hit_type)], ["doc_id", *carry, "score", "hits"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", *carry])
    return docs.select("doc_id", *carry, "text").mapInArrow(
        released(run), f"{types}, score double, hits array<struct<term string, edits int, quoted boolean, at bigint>>")
