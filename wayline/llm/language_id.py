"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 2, 3 and 4 characters of lower-case words, borders
included. A text is the average of its subwords' embeddings; a linear softmax
over it gives the language. Training is stochastic gradient descent in numpy on
a bounded sample, the probabilities are then calibrated by a temperature, and a
text is rejected below the score at which the calibration fold reaches the
wanted precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayline.llm import words

C = F.col
BITS = 15
GRAMS = (2, 3, 4)
PIECE_WORDS = 6
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


class Subwords:
    """Hashed subwords of some texts: per length, bucket and validity at every character."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
        codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letter = _letters()[codes]
        self.codes = np.where(self.letter, codes, 32).astype(np.uint64)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, ok = self.codes, self.letter
        for n in GRAMS:
            count = len(c) - n + 1
            if count <= 0:
                continue
            h = np.full(count, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + c[j : j + count]
            inner = np.ones(count, bool)
            for j in range(1, n - 1):
                inner &= ok[j : j + count]
            inner &= ok[:count] | ok[n - 1 : n - 1 + count]
            yield (words.mix(h) >> np.uint64(64 - BITS)).astype(np.int32), inner

    def has_letter(self) -> np.ndarray:
        return np.add.reduceat(self.letter, self.at[:-1]) > 0 if len(self.at) > 1 else np.zeros(0, bool)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and how often each occurs."""
    sub = Subwords([text])
    found = [b[ok] for b, ok in sub.grams()]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket x language: embedding times output layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities per text, and whether it has a letter."""
        sub = Subwords(texts)
        n = len(texts)
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for bucket, ok in sub.grams():
            doc = np.repeat(np.arange(n), np.diff(sub.at))[: len(bucket)][ok]
            bucket = bucket[ok]
            count += np.bincount(doc, minlength=n)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc, self.weights[bucket, k], minlength=n)
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True), sub.has_letter()


def held_out(part: int, of: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(C("doc_id").cast("string"), F.lit("")).cast("binary")) % of == part


def _pieces(text: str, most: int) -> list[str]:
    """The whole text and up to `most` runs of a few words spread over it, so that short texts are learned too."""
    parts = text.split()
    if len(parts) <= PIECE_WORDS:
        return [text]
    step = max(PIECE_WORDS, len(parts) // most)
    return [text] + [" ".join(parts[i : i + 1 + k % PIECE_WORDS]) for k, i in enumerate(range(0, len(parts) - PIECE_WORDS, step))][: most + 1]


def training_rows(docs: DataFrame, per_lang: int, pieces: int) -> tuple[list[str], list[tuple[int, int, bytes, bytes]]]:
    """Subword counts of about per_lang labelled documents of each language, chosen by a hash of the id.

    What reaches the driver is bounded: languages x per_lang x (pieces + 2)
    rows of at most 2**BITS counts. More than 1,000 labels are refused.
    """
    labelled = docs.where(C("lang").isNotNull() & C("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("over 1,000 distinct languages: not a language label")
    langs = sorted(counts)
    if not langs:
        return [], []
    rate = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))])
    chance = F.pmod(F.xxhash64(C("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                out = [(number[lang], n, *(x.astype(np.int32).tobytes() for x in features(piece)))
                       for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist())
                       for n, piece in enumerate(_pieces(text, pieces))]
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "piece", "buckets", "counts"), r)) for r in out], schema=pa.schema(
                    [("lang", pa.int32()), ("piece", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())]))

    sample = labelled.where(chance < F.element_at(rate, C("lang"))).select("lang", "text").mapInArrow(
        count, "lang int, piece int, buckets binary, counts binary")
    return langs, sorted((r["lang"], r["piece"], bytes(r["buckets"]), bytes(r["counts"])) for r in sample.collect())


def fit(docs: DataFrame, per_lang: int = 400, pieces: int = 6, dim: int = 12, epochs: int = 8, precision: float = 0.99, seed: int = 7) -> Model:
    """Train on docs(doc_id, text, lang); at most about per_lang documents of each language are used."""
    langs, rows = training_rows(docs, per_lang, pieces)
    size = 1 << BITS
    if not langs:
        return Model([], np.zeros((size, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    x = [(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32)) for _, _, b, c in rows]
    y = np.array([r[0] for r in rows])
    fold = max(1, len(rows) // 5) if len(rows) >= 20 else 0
    train, check = np.arange(fold, len(rows)), np.arange(fold)
    emb, out, bias = rng.normal(0, 0.1, (size, dim)), rng.normal(0, 0.1, (dim, len(langs))), np.zeros(len(langs))
    weight = 1.0 / np.maximum(1, np.bincount(y, minlength=len(langs)))
    weight *= len(rows) / len(langs)
    steps, at = epochs * ((len(train) + 31) // 32), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, (len(train) + 31) // 32)):
            part = [i for i in part if len(x[i][0])]
            if not part:
                continue
            rate, at = 8.0 * (1 - at / (steps + 1)), at + 1
            idx = np.concatenate([x[i][0] for i in part])
            share = np.concatenate([x[i][1] / x[i][1].sum() for i in part])
            ends = np.concatenate([[0], np.cumsum([len(x[i][0]) for i in part])])
            hidden = np.add.reduceat(emb[idx] * share[:, None], ends[:-1])
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[y[part]][:, None] / len(part)
            back = np.repeat(p @ out.T, np.diff(ends), axis=0) * share[:, None]
            touched, inverse = np.unique(idx, return_inverse=True)
            for d in range(dim):
                emb[touched, d] -= rate * np.bincount(inverse, back[:, d], minlength=len(touched))
            out -= rate / 8 * hidden.T @ p
            bias -= rate / 8 * p.sum(axis=0)
    table = emb @ out
    logits = np.array([(table[b] * (c / max(1, c.sum()))[:, None]).sum(axis=0) + bias for b, c in (x[i] for i in check)]).reshape(len(check), len(langs))
    temperature, reject = calibrate(logits, y[check], precision)
    return Model(langs, table.astype(np.float32), bias, temperature, reject)


def calibrate(logits: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, float]:
    """Temperature of the lowest log loss, and the lowest score from which on the wanted share is right."""
    if not len(y):
        return 1.0, 0.0

    def probabilities(t):
        z = logits / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    grid = 2.0 ** np.arange(-4, 4.1, 0.25)
    t = min(grid, key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean())
    p = probabilities(t)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum(p.argmax(axis=1)[order] == y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= precision)
    return float(t), float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """lang_pred, score and rejected for every whole text of docs(doc_id, text), with the columns in carry.

    A null text, or one without a letter, is 'und' with score 0 and rejected.
    With no language learned every text is 'und'. A rejected text keeps its best
    guess in lang_pred. Repeated rows repeat; other columns are ignored.
    """
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x languages x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in words.slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                if m.langs:
                    p, letters = m.scores(texts)
                    best = p.argmax(axis=1)
                    score = np.where(letters, p.max(axis=1), 0.0)
                    lang = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                else:
                    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                rejected = (score < m.reject_below) | (np.array(lang) == UNKNOWN)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ["doc_id", *carry]), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", *carry, "lang_pred", "score", "rejected"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ["doc_id", *carry])
    return docs.select("doc_id", *carry, "text").mapInArrow(run, f"{types}, lang_pred string, score double, rejected boolean")
