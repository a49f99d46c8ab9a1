"""Spelling variants of words by a variable-length gram index.

Grams that are frequent in the vocabulary are extended, so the dictionary keeps
short grams only where they are selective. A word is decomposed at each position
into its longest dictionary gram, without those inside an earlier one. For each
place of an edit it is known which of a word's grams the edit can affect; a word
one edit away is on the inverted lists of all the others, at the same places.
Those lists are merged at once: the grams that stay, with their places, are one
key, so a word has about as many keys as grams and its lists hold little but
near words. Words that meet under a key are verified.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wayline.workspace import written

C = F.col
Q_MIN, Q_MAX = 2, 4
#: at most so many grams of one length are frequent: one that starts at more than 1/MOST_FREQUENT of all positions
MOST_FREQUENT = 2_000
#: longer words meet by their halves: of some hundred letters, and one key instead of one per place
LONG = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LISTS = "word string, size int, key long, longer boolean"
_LISTS = pa.schema([("word", pa.string()), ("size", pa.int32()), ("key", pa.int64()), ("longer", pa.bool_())])


def frequent_grams(words: DataFrame, least: int = 20) -> dict[str, int]:
    """Grams of Q_MIN to Q_MAX - 1 letters that are extended, with their number of places in the vocabulary.

    A gram is frequent if it starts at more than max(least, positions /
    MOST_FREQUENT) positions, so at most MOST_FREQUENT grams of each length are:
    a bound that does not grow with the vocabulary.
    """
    starts = lambda q: F.when(F.length("word") >= q, F.transform(F.sequence(F.lit(1), F.length("word") - (q - 1)), lambda i: F.substring("word", i, F.lit(q))))
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    floor = max(least, total // MOST_FREQUENT)
    counts = words.select(F.explode(F.flatten(F.filter(F.array(*[starts(q) for q in range(Q_MIN, Q_MAX)]), lambda a: a.isNotNull()))).alias("gram")).groupBy("gram").count()
    return {r.gram: r["count"] for r in counts.where(C("count") > floor).toLocalIterator()}


def decompose(word: str, frequent: Mapping[str, int]) -> list[tuple[int, str]]:
    """(position, gram): at each position the longest gram, unless it lies inside an earlier one."""
    grams, reach, n = [], 0, len(word)
    for i in range(n - Q_MIN + 1):
        end = i + Q_MIN
        while end < n and end - i < Q_MAX and word[i:end] in frequent:
            end += 1
        if end > reach:
            grams.append((i, word[i:end]))
            reach = end
    return grams


def intact(word: str, grams: list[tuple[int, str]], start: int, end: int, tails: frozenset[str]) -> tuple[int, int]:
    """(e, p): an edit of word[start:end] leaves the grams of word[:e] and of word[p:] as they are.

    start = end is an insertion. Grams that end before the edit stay: one that
    could grow over it does so already. A gram behind the edit may be hidden inside
    a longer one that starts at the edit or before; all of that one but its last
    letter is frequent, so the letters from the edit to there end a frequent gram.
    A side on which no gram stays is listed by its grams of the least length.
    The edited word is cut in the same way, since only letters outside the edit count.
    """
    left = max((at + len(g) for at, g in grams if at + len(g) <= start), default=start if start >= Q_MIN else 0)
    right = min((at for at, g in grams if at >= end and not (at + len(g) - end < Q_MAX and word[end : at + len(g) - 1] in tails)),
                default=end if len(word) - end >= Q_MIN else len(word))
    return left, right


def keys_of(word: str, frequent: Mapping[str, int], tails: frozenset[str]) -> set[tuple[int, int, bool]]:
    """(size, key, longer) of the merged lists of a word.

    Under its own size: the word with any letter replaced, or (longer) left out.
    Under the next size: the word with a letter put in anywhere.
    """
    n = len(word)

    def key(left: int, right: int, kind: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}:{word[:left]}:{word[right:]}".encode(), digest_size=8).digest(), "big", signed=True)

    def halves(size: int, cut: int, kind: int, longer: bool):
        """Of `size` letters that the word has apart from the edit, one half is left alone."""
        return {(size + kind, key(cut, n, kind), longer), (size + kind, key(0, n - (size - cut), kind), longer)}

    grams = decompose(word, frequent) if n < LONG else []
    out: set[tuple[int, int, bool]] = set()
    if n < LONG:
        cuts = {intact(word, grams, i, i + 1, tails) for i in range(n)}
        out |= {(n, key(*c, 0), True) for c in cuts}
    else:
        out |= halves(n, n // 2, 0, True) | halves(n - 1, (n - 1) // 2, 1, True)
    if n + 1 < LONG:
        out |= {(n + 1, key(*c, 0), False) for c in {intact(word, grams, i, i, tails) for i in range(n + 1)}}
    else:
        out |= halves(n, n // 2, 1, False)
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, other) for all words that differ by exactly one inserted, deleted or replaced code point, both ways round.

    words: a stored table with a column word, distinct.
    """
    spark = words.sparkSession
    frequent = frequent_grams(words)
    tails = frozenset(g[i:] for g in frequent for i in range(1, len(g)))
    known = spark.sparkContext.broadcast((frequent, tails))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ends = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = [[], [], [], []]
                for word in batch.column("word").slice(at, 1000).to_pylist():
                    keys = keys_of(word, counts, ends)
                    out[0] += [word] * len(keys)
                    for column, values in zip(out[1:], zip(*keys)):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LISTS)], schema=_LISTS)

    lists = written(words.select("word").repartition(spread(spark)).mapInArrow(listed, LISTS), "gram-lists")
    known.destroy()
    # each list is sorted once: words of the list's size, against all on it
    longer = lists.where("longer").select(C("word").alias("other"), "size", "key")
    order = (F.length("word") < F.length("other")) | ((F.length("word") == F.length("other")) & (C("word") < C("other")))
    met = lists.select("word", "size", "key").hint("merge").join(longer, ["key", "size"]).where(order & (F.levenshtein("word", "other", 1) == 1))
    pairs = written(met.select("word", "other").distinct(), "near")
    return pairs.unionByName(pairs.select(C("other").alias("word"), C("word").alias("other")))


def spread(spark) -> int:
    """Tasks for work that is large for its bytes."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_words(docs: DataFrame, runs: Column, least_length: int, least: int) -> DataFrame:
    """(word, n) of the words in an array column of runs: at least least_length code points, at least `least` times."""
    return docs.select(F.explode(runs).alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(C("n") >= least)


def edited_runs(doc_id: str = "doc_id", text: str = "text", every: int = 199) -> Column:
    """Runs of letters with A-Z lower-cased; of those whose checksum with the document's id `every` divides, one letter is left out."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))

    def edit(run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(C(doc_id).cast("string"), F.lit("")), F.lit(":"), run))
        at = (h % F.length(run)).cast("int")
        return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return F.transform(runs, edit)


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (word, n); other columns are ignored.

    form: the near word (one inserted, deleted or replaced code point) of largest
    n, if that is at least `ratio` times the word's n; of equal n the first in
    code-point order; else null. root: the last word when forms are followed, the
    word itself without a form. Rows with a null word or n take no part; of rows
    with the same word the largest n counts.
    """
    spark = words.sparkSession
    words = written(words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")), "words")
    pairs = near_words(words)
    counted = pairs.join(words.select(C("word").alias("other"), C("n").alias("m")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-C("m")).alias("m"), "other")).alias("b"))
    forms = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-C("b.m") >= ratio * C("n"), C("b.other")).alias("form"), F.when(-C("b.m") >= ratio * C("n"), -C("b.m")).alias("form_n")), "forms")
    # each step to a form multiplies n by the ratio, so chains are short; every round doubles the steps taken
    ends = forms.agg(F.max("n"), F.min(F.when(C("form").isNotNull(), C("n")))).first()
    steps = math.floor(math.log(max(ends[0] / max(ends[1], 1), 1), ratio) + 1e-9) + 1 if ends[1] is not None else 0
    reach = forms.where("form IS NOT NULL").select("word", C("form").alias("root"))
    taken = 1
    while taken < steps:
        on = reach.select(C("word").alias("root"), C("root").alias("further"))
        reach = written(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        taken *= 2
    return forms.join(reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
