"""Secret scan: fixed patterns, and strings that a primed compressor cannot shorten.

A candidate near a sensitive word is compressed together with the text around it
by zstandard primed with a dictionary of common identifiers. Its marginal bytes
(with the candidate minus without) say how new it is: words, paths and repeated
names cost few bytes, keys cost almost one byte per character.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wayline.llm import words

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: what makes the context of a candidate sensitive, and the candidate itself
SENSITIVE = re.compile(r"key|token|secret|passw|pwd|auth|cred|bearer|private|signature|session", re.ASCII | re.IGNORECASE)
SENSITIVE_WORDS = ("key", "token", "secret", "passw", "pwd", "auth", "cred", "bearer", "private", "signature", "session")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
#: a candidate right behind a sensitive word of the same string, as in a path or token_...
BEHIND = re.compile(r"(?<=[+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
SEPARATORS = re.compile(r"[+/_-]*")
#: between the lines of a wrapped value; a backslash also stands before the n of an escaped line end
WRAP = frozenset(" \t\r\n\"'\\")

IDENTIFIERS = (
    "import from return class def function public private static final void string int long double boolean true false null "
    "None self this const let var async await export default module require include struct enum interface extends implements "
    "try except catch finally throw raise with open close read write file path name value index count length size type data "
    "config settings environment variable default_value user_name user_id account_id client_id client_secret access_key "
    "access_token refresh_token auth_token api_key api_token secret_key private_key public_key session_id session_token "
    "password username database connection_string host port localhost http https www com org net json xml yaml html utf-8 "
    "application content-type authorization bearer basic signature certificate BEGIN END RSA KEY example changeme placeholder "
    "your_api_key_here your_token_here insert_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef request response server client message error warning debug info timestamp"
)


class Novelty:
    """Marginal compressed bytes of a string, given what surrounds it."""

    def __init__(self, dictionary: str, level: int = 3):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def marginal(self, around: str, candidate: str) -> int:
        raw = around.encode("utf-8", "replace")
        return len(self.zstd.compress(raw + b"\n" + candidate.encode("utf-8", "replace"))) - len(self.zstd.compress(raw))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind; too short matches are dropped."""
    found = []
    if any(w in (low := text.lower()) for w in ASSIGN_WORDS) and (":" in low or "=" in low):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, reach: int, around: int, ratio: float) -> list[tuple[int, int, int]]:
    """Incompressible strings that a sensitive word stands before, outside the spans already found.

    The word ends within `reach` characters before the string, on its line or an
    earlier one, or opens the string itself; or the string goes on with a secret
    wrapped over lines.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    hits = [m.end() for m in SENSITIVE.finditer(text)]
    found: dict[int, int] = {}
    ends = {e for _, _, e in taken}
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        k = bisect.bisect_right(hits, at)  # the word before the candidate is hits[k - 1]
        back = at
        while back and at - back < reach and text[back - 1] in WRAP:
            back -= 1
        near = k and at < hits[k - 1] + reach or back in ends
        starts = [at] if near else []
        for h in hits[k:]:
            if h >= end:
                break
            behind = BEHIND.match(text, SEPARATORS.match(text, h).end())
            if behind and behind.end() == end:
                starts.append(behind.start())
        for start in starts:
            if any(s < end and start < e for _, s, e in taken):
                continue
            beside = text[max(0, start - around) : start] + text[end : end + around]
            if novelty.marginal(beside, text[start:end]) >= ratio * (end - start):
                found[start] = end
                ends.add(end)
                break
    return [(3, s, e) for s, e in found.items()]


def find_secrets(docs: DataFrame, dictionary: str = IDENTIFIERS, reach: int = 48, around: int = 256, ratio: float = 0.7) -> DataFrame:
    """Spans of secrets in every whole text of docs(doc_id, text): doc_id, spans.

    spans: array of (kind, start, end, novelty) by start, then kind in the order
    of KINDS; code points, end exclusive. novelty is the marginal compressed
    bytes per character of the string, also for the fixed patterns. A null text
    counts as empty and has no spans; rows that repeat give the same row again;
    other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            for part in words.slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    spans += novel_spans(text, spans, novelty, reach, around, ratio)
                    rows.append([
                        {"kind": KINDS[k], "start": s, "end": e,
                         "novelty": novelty.marginal(text[max(0, s - around) : s] + text[e : e + around], text[s:e]) / (e - s)}
                        for s, k, e in sorted((s, k, e) for k, s, e in spans)
                    ])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, SPANS)], ["doc_id", "spans"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {doc_type}, spans array<struct<kind string, start bigint, end bigint, novelty double>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
