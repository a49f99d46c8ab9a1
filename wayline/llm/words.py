"""Words and word n-grams of many texts at once, as numpy arrays.

A slice of texts becomes one byte array. Words are the runs of bytes other than
space and 0x09-0x0D; UTF-8 keeps those bytes for themselves, so splitting bytes
equals splitting code points. Hashes are 64-bit polynomials over random byte
values, computed for all words of a slice by prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_U = np.uint64
_RNG = np.random.default_rng(20_240_817)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE2 = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each; a longer text is a part of its own."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, min(upto, batch.num_rows) - at)
        at = min(upto, batch.num_rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n + 65536, 2**19)
        inverse = _U(pow(int(base), -1, 2**64))
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
        if size <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have


class Words:
    """All words of some texts: byte bounds of each word, word bounds of each text."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
        self.raw = _LOWER[raw] if lower else raw
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        gap = _SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(raw) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)
        self.counts = np.diff(self.first)

    def hashes(self, second: bool = False) -> np.ndarray:
        """One 64-bit value per word."""
        table, base = (_BYTE2, _BASE2) if second else (_BYTE, _BASE)
        power, inverse = _powers(base, len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(table[self.raw] * power[: len(self.raw)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; runs may cross texts, the caller leaves those out."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out *= _BASE
        out += words[j : j + count]
    return mix(out + _U(n))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
