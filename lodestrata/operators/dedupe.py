"""One row of a group, by priority, position or recency; unique and ambiguous key matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__rank = 1").drop("__rank")


def by_source_priority(df: DataFrame, keys: Sequence[str], source: str, year: str, row_id: str, preferred: Sequence[str] = ("official", "xuequzhushou")) -> DataFrame:
    """Preferred sources first, then the newest year (nulls last), then the least id."""
    first = F.lit(False)
    for prefix in preferred:
        first = first | F.coalesce(F.col(source).startswith(prefix), F.lit(False))
    return best_per_key(df, keys, first.desc(), F.col(year).desc_nulls_last(), F.col(row_id).asc())


def latest(df: DataFrame, keys: Sequence[str], time: str, row_id: str) -> DataFrame:
    """The newest row of each key; of equal times the highest id. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(time), F.col(row_id))).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def first_seen(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return best_per_key(df, keys, F.col(ordinal).asc())


def last_seen(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return best_per_key(df, keys, F.col(ordinal).desc())


def carry_forward(df: DataFrame, groups: Sequence[str], ordinal: str, column: str) -> Column:
    """The last non-null value of a column up to each row of its group."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*groups).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))


def key_hits(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str = "key") -> DataFrame:
    """(left id, n_hits, right id of a single hit): how many rows of ``right`` share each left row's key."""
    hits = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_hits"), F.min(right_id).alias(right_id))
    joined = left.filter(F.col(key).isNotNull()).join(hits, key)
    return joined.select(left_id, "n_hits", F.when(F.col("n_hits") == 1, F.col(right_id)).alias(right_id))


def merge_duplicates(links: DataFrame, merge: DataFrame, owner: str, target: str) -> DataFrame:
    """Links repointed by merge (pseudo, real); a link whose pair already exists is dropped, the first of equal ones stays.

    ``links`` has (id, owner, target). Rows of links keep their id.
    """
    moved = links.join(merge, F.col(target) == F.col("pseudo"), "left")
    moved = moved.select("id", owner, F.coalesce("real", target).alias(target), F.col("real").isNotNull().alias("__moved"))
    return best_per_key(moved, [owner, target], F.col("__moved").asc(), F.col("id").asc()).drop("__moved")
