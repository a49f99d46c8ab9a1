"""Scoring and deduplication of results while their files keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.functions.core import present
from wayline.operators.evaluation import score_rows
from wayline.operators.joins import CELL


def scored_stream(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of streamed answers; ``truth`` is a static table with gt_* fields."""
    usable = results.where(present(F.col("error")).isNull())
    return score_rows(usable.join(truth, "sample_id"), ["ordinal", "sample_id", "model_id"])


def unique_stream(results: DataFrame) -> DataFrame:
    """One row per run identity: no repeat comes through, however late or far apart, and nothing else is dropped.

    The identities seen are kept for good in the state under the checkpoint
    folder, dealt out by hash, so the state grows with the distinct identities.
    """
    cells = results.withColumns({c: present(F.col(c)) for c in ("variant", "augment")})
    return cells.dropDuplicates(CELL)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has landed, then stop; a restart resumes.

    Progress lives in the checkpoint folder, so every file counts once.
    """
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
