"""Training corpus in five stages: from documents to packed sequences.

Each stage works on all that the one before kept, and is written as Parquet and
read again before the next one starts, so a lost executor costs part of a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import best_fit, exact_dedup, jaccard_join, language_id, mixing, toxicity
from wayline.workspace import written

REJECT_FROM = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below REJECT_FROM; the labels of one third (by the id's checksum) are never learned from."""
    learn = ~language_id.held_out(1, 3)
    model = toxicity.fit(docs.where(learn), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn))
    return toxicity.keep_below(docs, model, REJECT_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.75."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of 2048."""
    return best_fit.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: no SQL: the first stage learns a model, the last one packs greedily
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
