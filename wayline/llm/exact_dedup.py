"""Exact copies by progressive refinement: length, then prefix hash, then full hash.

Each step keeps only groups of two or more, so the full content is hashed for
documents that still have a possible copy. Everything is native column code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayline.llm.spread import spread_join
from wayline.workspace import written

C = F.col
#: tasks that share the rows of one length, prefix or text
SALTS = 16


def possible_copies(docs: DataFrame, prefix_chars: int = 64) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, n_bytes, prefix_hash) of all documents, and the distinct ids whose (length, prefix) repeats.

    Group counts are combined before the shuffle, and the rows of a length or
    prefix are dealt over many tasks by their id where they meet its one row, so
    a length that a third of the documents share costs no task more than another.
    """
    text = F.coalesce(C("text"), F.lit(""))
    narrow = written(
        docs.select("doc_id", F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash")), "lengths"
    )
    lengths = narrow.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    same_length = spread_join(narrow, lengths, ["n_bytes"], "left_semi", C("doc_id"), SALTS)
    prefixes = same_length.groupBy("n_bytes", "prefix_hash").count().where("count > 1").select("n_bytes", "prefix_hash")
    ids = spread_join(same_length, prefixes, ["n_bytes", "prefix_hash"], "left_semi", C("doc_id"), SALTS).select("doc_id").distinct()
    return narrow, ids


def exact_copies(docs: DataFrame, prefix_chars: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_hash.

    Texts are equal when identical; null counts as empty, so all null and empty
    texts form one group. The largest doc_id of a group stays; a null id is the
    smallest. Rows that repeat both id and text are one document given more than
    once: each carries the same flags and counts in group_size. text_hash is the
    SHA-256 of the text, null for documents that no full hash was needed for
    unless hash_all is set. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce(C("text"), F.lit("")).alias("text"))
    narrow, ids = possible_copies(docs, prefix_chars)
    ids = written(ids.withColumnRenamed("doc_id", "possible_id"), "possible")
    same = C("doc_id").eqNullSafe(C("possible_id"))
    full = F.sha2("text", 256).alias("text_hash")
    if hash_all:
        # the hash goes through the exchange, not the text
        hashed = written(docs.select("doc_id", full), "hashes")
        alone = hashed.join(ids, same, "left_anti")
        among = hashed.join(ids, same, "left_semi")
    else:
        alone = narrow.join(ids, same, "left_anti").select("doc_id", F.lit(None).cast("string").alias("text_hash"))
        among = written(docs.join(ids, same, "left_semi").select("doc_id", full), "hashes")
    groups = among.groupBy("text_hash").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", C("doc_id").eqNullSafe(C("keep_id")).alias("kept"), "text_hash"]
    return spread_join(among, groups, ["text_hash"], "inner", C("doc_id"), SALTS).select(*columns).unionByName(
        alone.select("doc_id", C("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_hash")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as given; one row where id and text repeat.

    Texts move once, to meet the ids that stay; only rows whose id repeats are
    grouped by their text.
    """
    staying = exact_copies(docs).where("kept")
    kept = written(staying.groupBy(C("doc_id").alias("kept_id"), C("text_hash").alias("kept_hash")).agg(F.count("*").alias("times")), "kept")
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (kept["kept_hash"].isNull() | (kept["kept_hash"] == F.sha2(F.coalesce(docs["text"], F.lit("")), 256)))
    found = docs.join(kept, same, "left_semi")
    many = written(kept.groupBy("kept_id").agg(F.sum("times").alias("times")).where("times > 1").select("kept_id"), "repeated")
    if many.isEmpty():
        return found
    again = docs["doc_id"].eqNullSafe(many["kept_id"])
    return found.join(many, again, "left_anti").unionByName(found.join(many, again, "left_semi").dropDuplicates(["doc_id", "text"]))
