"""Take in new files of a folder, each of them once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from obsforge.functions.names import parse_name


MAX_FILES = 10_000  # of a batch, however many files wait


def _bounded(stream: DataStreamReader, max_files: int, max_bytes: str | None) -> DataStreamReader:
    """One bound decides: Spark takes either a number of files or of bytes."""
    return stream.option("maxBytesPerTrigger", max_bytes) if max_bytes else stream.option("maxFilesPerTrigger", max_files)


def ingest_new_files(
    spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str, pattern: str = "*.parquet", fmt: str = "parquet",
    max_files: int = MAX_FILES, max_bytes: str | None = None,
) -> None:
    """Append the rows of files not seen before to the table at `target`, then stop.

    The stream's checkpoint remembers the files. What waits is taken in as many batches as max_files, or max_bytes
    (such as "10g") if given, ask for. A batch is written to a folder named after its number and overwrites it when it
    is run again, so a lost driver or executor leaves no double rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    stream = _bounded(reader, max_files, max_bytes).load(folder)
    named = stream.withColumn("file_key", F.element_at(F.split(F.input_file_name(), "/"), -1))
    query = (
        named.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest_exports(
    spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*.{tif,tiff}", max_files: int = MAX_FILES
) -> None:
    """Register newly exported files: name, parsed name parts, size. Content is not read."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = (
        spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(name.alias("file_key"), parse_name(name).alias("n"), "length").select("file_key", "n.*", "length")
    query = (
        listed.where(F.col("id").isNotNull())
        .writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _merged(spark: SparkSession, target: str) -> int | None:
    """The last batch of the newest merged folder; None when there is none."""
    try:
        return spark.read.schema("through BIGINT").parquet(f"{target}-merges").agg(F.max("through")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _batches(spark: SparkSession, target: str, after: int | None) -> DataFrame:
    """Rows of the batches behind a number, with the number; the folders before it are not read."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    return rows if after is None else rows.where(F.col("batch") > after)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All rows taken in so far, each once, from the newest merged folder and the batches behind it."""
    through = _merged(spark, target)
    behind = _batches(spark, target, through).drop("batch")
    return behind if through is None else spark.read.parquet(f"{target}-merged/{through}").unionByName(behind)


def merge_batches(spark: SparkSession, target: str) -> int | None:
    """Write the rows of all batches so far as few files of a sensible size; returns the last batch that is part of them.

    The merged folder counts once a row of its own says so, which is written last: a run that breaks off changes nothing, and
    rows are read once at any time. Folders that a newer one replaces stay, and can be removed when no reader is left.
    """
    through = _merged(spark, target)
    last = _batches(spark, target, through).agg(F.max("batch")).first()[0]
    if last is None:
        return through
    now = _batches(spark, target, through).where(F.col("batch") <= last).drop("batch")
    whole = now if through is None else spark.read.parquet(f"{target}-merged/{through}").unionByName(now)
    whole.hint("rebalance").write.mode("overwrite").parquet(f"{target}-merged/{last}")
    spark.createDataFrame([(int(last),)], "through BIGINT").coalesce(1).write.mode("append").parquet(f"{target}-merges")
    return int(last)
