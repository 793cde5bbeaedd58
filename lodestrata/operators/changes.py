"""Changes between two versions of a table, as a log that can be replayed forwards and undone.

The log holds rows with a signed count: how often the row was added (above zero) or taken away. It is
made by one aggregate over both versions, so repeated rows are told apart by how often they come and
nothing is compared pair by pair. Applying a log is the same aggregate over the table and the log.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA = "__delta"


def _summed(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum(DELTA).alias(DELTA))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The log that leads from one version to the next: their columns and how often each row came or went.

    Both have the same columns in any order; equal rows, nulls included, cancel out. Columns that
    cannot be grouped by (maps, variants) are not supported.
    """
    parts = [before.withColumn(DELTA, F.lit(-1).cast("long")), after.withColumn(DELTA, F.lit(1).cast("long"))]
    return _summed(parts, before.columns).filter(F.col(DELTA) != 0)


def applied(table: DataFrame, log: DataFrame, undo: bool = False) -> DataFrame:
    """The table after a log, or before it with ``undo``. Fails if the log takes away what is not there."""
    sign = -1 if undo else 1
    parts = [table.withColumn(DELTA, F.lit(1).cast("long")), log.withColumn(DELTA, F.col(DELTA) * sign)]
    rows = _summed(parts, table.columns)
    times = F.when(F.col(DELTA) >= 0, F.col(DELTA)).otherwise(F.raise_error(F.lit("the log takes away rows that the table does not have")).cast("long"))
    return rows.withColumn(DELTA, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop(DELTA)


def operations(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key of a log the kind of change (insert, delete, update) and how many rows came and went."""
    came, went = F.sum(F.greatest(F.col(DELTA), F.lit(0))).alias("came"), F.sum(F.greatest(-F.col(DELTA), F.lit(0))).alias("went")
    kind: Column = F.when(F.col("went") == 0, "insert").when(F.col("came") == 0, "delete").otherwise("update")
    return log.groupBy(*keys).agg(came, went).withColumn("op", kind)


def dry_run(table: DataFrame, change: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(report, log) of a change that is not made: operations counted, and the log with which to make or undo it."""
    log = difference(table, change)
    return operations(log, keys).groupBy("op").agg(F.count("*").alias("n")), log
