"""Row counts, null counts and sizes of Parquet tables out of their footers; tasks read them, and no data page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _footers(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet scans answer aggregates from footers."""
    other = spark.newSession()
    other.conf.set("spark.sql.sources.useV1SourceList", "")
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return other


def column_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(column, n_rows, n_nulls) of the columns whose values stand in the footers; nested ones are left out.

    Counts are exact, as each footer holds its row groups' values and nulls.
    """
    table = _footers(spark).read.parquet(path)
    names = [f.name for f in table.schema if f.dataType.typeName() not in ("struct", "array", "map", "variant")]
    counts = table.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{n}")).alias("n_nulls")) for n, c in enumerate(names)])
    return counts.select(F.inline(rows))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(n_files, n_bytes): the sizes that the file listing gives, without opening a file."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_bytes"))
