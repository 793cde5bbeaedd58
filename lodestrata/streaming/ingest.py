"""Ingest as a stream of files: each batch is an idempotent insert-or-ignore into the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrata.operators.ingest import insert_or_ignore


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest_stream(stream: DataFrame, target: str, state: str, keys: Sequence[str], ordinal: str) -> StreamingQuery:
    """Starts a run over the files there are now; a batch that is run again adds nothing.

    A batch is written to its own folder of the target, so a retry replaces what a failed try left.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            existing = spark.read.option("basePath", target).parquet(target).filter(F.col("batch") < number)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            existing = batch.limit(0)
        fresh, _ = insert_or_ignore(batch, existing, keys, ordinal)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and kind; rows later than the watermark are left out, windows close behind it."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
