"""Scans of the JSON and image files of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import schemas
from wayline.functions.core import WHITE, first_present, present
from wayline.operators.manifest import fill_legacy_frames
from wayline.operators.ordered import first_by


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Typed sample rows; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schemas.SAMPLE).option("mode", "FAILFAST").json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file, place and order.

    A task reads one block of one file from its start, so the row number of the
    task rises with the line; files and blocks order everything else.
    """
    return (
        spark.read.text(path)
        .select(
            "value", F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("line"),
        )
        .where(~F.col("value").rlike(f"^{WHITE}*$"))
    )


def _parsed(text: Column, schema: str) -> Column:
    """One JSON object per line, or null.

    Read as the only element of an array: text behind the object makes the line
    malformed instead of being ignored.
    """
    fields = F.from_json(F.concat(F.lit("["), text, F.lit("]")), _array_of(schema))
    return F.when(F.size(fields) == 1, F.get(fields, F.lit(0)))


def _array_of(ddl: str):
    from pyspark.sql.types import ArrayType, StructType

    return ArrayType(StructType.fromDDL(ddl))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Usable answers of result files: malformed lines and error rows are left out."""
    rows = _lines(spark, path).withColumn("r", _parsed(F.col("value"), schemas.RESULT))
    flat = rows.where(F.col("r").isNotNull()).select("file", "line", "r.*")
    flat = flat.withColumn("sample_id", first_present(F.col("id"), F.col("sample_id"))).drop("id")
    return flat.where(
        F.col("sample_id").isNotNull() & present(F.col("model_id")).isNotNull()
        & present(F.col("error")).isNull()
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Manual labels; the last line of a sample holds."""
    rows = _lines(spark, path).withColumn("r", _parsed(F.col("value"), schemas.GROUND_TRUTH))
    flat = rows.select("line", "r.*").where(~F.coalesce("is_auto", F.lit(False)))
    return first_by(flat, ["sample_id"], F.col("line"), last=True).drop("line")


def read_manifest(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """Manifest steps, one per row, with legacy frame fields filled in.

    Route rows (as the sink here writes them) are read line by line.  With
    ``documents`` each file is one JSON document and is parsed by one task.
    """
    if documents:
        docs = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
        routes = docs.select(F.explode("routes").alias("m")).select("m.*")
    else:
        routes = spark.read.schema(schemas.MANIFEST_ROUTE).json(path)
    steps = routes.select("route_id", F.explode("steps").alias("s")).select("route_id", "s.*")
    return fill_legacy_frames(steps)


def read_registry(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Models of the registry; ``lines`` where each line is a document of its own."""
    docs = spark.read.schema(schemas.REGISTRY).option("multiLine", not lines).json(path)
    return docs.select(F.explode("models").alias("m")).select("m.*")


def read_splits(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(sample_id, split); a sample in several lists gets the later split."""
    docs = spark.read.schema(schemas.SPLITS).option("multiLine", not lines).json(path)
    return merge_splits(docs)


def merge_splits(lists: DataFrame) -> DataFrame:
    names = ["train", "val", "test"]
    listed = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("split"), F.col(n).alias("ids")) for i, n in enumerate(names)]
    )
    rows = lists.select(F.explode(listed).alias("l")).select("l.rank", "l.split", F.explode("l.ids").alias("sample_id"))
    return rows.groupBy("sample_id").agg(F.max_by("split", "rank").alias("split"))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(schemas.ASSIGNMENT).option("multiLine", True).json(path)
    return docs.select(F.explode("assignments").alias("route_id", "augment"))


def list_files(spark: SparkSession, path: str, glob: str = "*.{jpg,png}") -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path)
    )
    return files.select("path", "length")


def files_per_folder(files: DataFrame) -> DataFrame:
    folder = F.regexp_replace("path", r"/[^/]*$", "").alias("folder")
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def file_digests(spark: SparkSession, path: str, glob: str = "*.{jpg,png}") -> DataFrame:
    """MD5 of every image, computed where the file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.md5("content").alias("digest"))
