"""Cascades and mappings: each step decides what earlier ones left, and every value has to be mapped."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.shared import shared_path

Step = Callable[[DataFrame], DataFrame]


def decided(rows: DataFrame, key: str, steps: Sequence[tuple[str, Step]], otherwise: str, result: str = "target") -> DataFrame:
    """(key, reason, result): the first step that takes a key gives its reason and result.

    A step gets the rows that no earlier one took and returns (key, result); of several results of a
    key the least counts, a null one too. Decisions and the rest are written to the shared folder after each step, so a step is planned and
    run once, and rows are never decided twice. Keys must tell rows apart; null keys get ``otherwise``.
    """
    spark, path, rest, parts = rows.sparkSession, shared_path(rows.sparkSession, "ladder"), rows, []
    for n, (reason, step) in enumerate(steps):
        step(rest).groupBy(key).agg(F.min(result).alias(result)).select(key, F.lit(reason).alias("reason"), result).write.parquet(f"{path}/decided-{n}")
        parts.append(spark.read.parquet(f"{path}/decided-{n}"))
        rest.join(parts[-1].select(key), key, "left_anti").write.parquet(f"{path}/rest-{n}")
        rest = spark.read.parquet(f"{path}/rest-{n}")
    kind = parts[0].schema[result].dataType if parts else "string"
    parts.append(rest.select(key, F.lit(otherwise).alias("reason"), F.lit(None).cast(kind).alias(result)))
    return reduce(DataFrame.unionByName, parts)


def mapped(c: Column, mapping: Mapping[str | None, str | None], what: str) -> Column:
    """A value by an exhaustive mapping, null too if it is named; a value that is not mapped stops the query with an error."""
    out = F.raise_error(F.concat(F.lit(f"{what} is not mapped: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("string")
    for old, new in reversed(mapping.items()):
        out = F.when(c.isNull() if old is None else c == F.lit(old), F.lit(new)).otherwise(out)
    return out


def unmapped(df: DataFrame, column: str, mapping: Mapping[str | None, str | None]) -> DataFrame:
    """(value, n): what a mapping does not cover; no row means that it is exhaustive."""
    known = [v for v in mapping if v is not None]
    covered = F.coalesce(F.col(column).isin(*known), F.lit(None in mapping))
    return df.filter(~covered).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def note(*parts: tuple[str, Column]) -> Column:
    """A note of the parts that are there: ``label: value`` with semicolons between; null of none."""
    made = F.concat_ws("; ", *[F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), F.concat(F.lit(f"{label}: "), F.trim(c.cast("string")))) for label, c in parts])
    return F.nullif(made, F.lit(""))


def visible(links: DataFrame, entities: DataFrame, key: str, entity_key: str) -> DataFrame:
    """Links whose entity is shown, as a semi-join; a selective filter on the entities cuts the links' scan by a runtime Bloom filter."""
    return links.join(entities.select(F.col(entity_key).alias("__shown")), F.col(key) == F.col("__shown"), "left_semi")
