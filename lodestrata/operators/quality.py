"""Completeness: shares per group, the grand total, weighted scores, row tags, gap lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import percent
from lodestrata.shared import shared_path

#: Fixed values of the data: the weights of the missing-data score; they sum to 100.
SCORE_WEIGHTS = {
    "schools": 5, "tiers": 5, "nature": 10, "enrollment_notes": 10, "school_location": 10, "school_communities": 10, "source_coverage": 10,
    "community_location": 5, "coordinates": 15, "verified_assignments": 10, "reviewed_feeders": 5, "policy_sources": 5,
}


def completeness(df: DataFrame, group: str, checks: dict[str, Column], total: bool = False) -> DataFrame:
    """Per group the row count, and for every check its count and percentage; ``total`` adds a row for all, with a null group.

    The total's percentages come from its own counts, never from those of the groups.
    """
    grouped = df.rollup(group) if total else df.groupBy(group)
    counted = grouped.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"n_{name}") for name, c in checks.items()])
    shares = [percent(F.col(f"n_{name}"), F.col("total")).alias(f"pct_{name}") for name in checks]
    out = counted.select(group, "total", *[f"n_{name}" for name in checks], *shares)
    mean = reduce(lambda a, b: a + b, [F.col(f"pct_{name}") for name in checks]) / len(checks)
    return out.withColumn("pct_overall", F.floor(mean * 10 + 0.5) / 10)


def row_quality(df: DataFrame, checks: dict[str, Column]) -> tuple[Column, Column]:
    """(percentage of passed checks, whole; tags of the failed ones in the order of the checks)."""
    passed = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks.values()])
    tags = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()])
    return F.floor(passed / len(checks) * 100 + 0.5).cast("long"), tags


def weighted_score(shares: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of percentages, one decimal."""
    whole = sum(weights[name] for name in shares)
    return F.floor(reduce(lambda a, b: a + b, [c * weights[name] for name, c in shares.items()]) / whole * 10 + 0.5) / 10


def gaps(df: DataFrame, failed: Column, *order: Column, limit: int | None = None) -> DataFrame:
    found = df.filter(failed).orderBy(*order)
    return found if limit is None else found.limit(limit)


def index_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the values at the places floor(n * share) of its sorted non-null values: no interpolation.

    Equal values are counted before they meet, so a group costs its distinct values and no list is built.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__c"))
    own = Window.partitionBy(group)
    counted = counted.withColumn("__upto", F.sum("__c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("__n", F.sum("__c").over(own))
    place = {name: F.least(F.floor(F.col("__n") * share), F.col("__n") - 1) for name, share in shares.items()}
    return counted.groupBy(group).agg(*[F.min(F.when(F.col("__upto") > at, F.col(value))).alias(name) for name, at in place.items()])


def spread_percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of the values at the places floor(n * share) of all sorted non-null values; nulls where there is none.

    Equal values are counted, dealt by ranges to many tasks and written to the shared folder. The ranges' sums, one row each,
    tell which range holds a place; only within it values are summed up one after the other.
    """
    path = shared_path(df.sparkSession, "percentiles")
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counted = df.sparkSession.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = counted.groupBy("part").agg(F.sum("c").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    whole = sums.agg(F.sum("c").alias("n"))
    places = whole.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * share), F.col("n") - 1).alias("place")) for name, share in shares.items()])).alias("s")).select("s.*")
    held = places.join(sums, (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c"))).select("name", "place", "part", "before")  # some names by some ranges
    inside = counted.join(F.broadcast(held), "part")  # a row a name
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto", upto).filter("upto > place")
    return found.agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
