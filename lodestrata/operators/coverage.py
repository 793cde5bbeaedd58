"""Coverage of groups over years, and the sources that vouch for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.classify import audit_status, has_scope
from lodestrata.functions.labels import status_rank
from lodestrata.functions.text import percent
from lodestrata.operators.dedupe import first_seen


def literal_years(spark: SparkSession, years: Sequence[int]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))


def grid(spark: SparkSession, entities: DataFrame, links: DataFrame, years: Sequence[int]) -> DataFrame:
    """Years by groups: entities (entity_id, grp, boundary) and links (entity_id, year), aggregated before they are joined.

    Totals do not depend on the year, so the links' side is one small row per group and year.
    """
    totals = entities.groupBy("grp").agg(F.count("*").alias("total"), F.count_if("boundary").alias("n_boundary"))
    per_entity = links.filter(F.col("year").isin(*years)).groupBy("year", "entity_id").agg(F.count("*").alias("n_links"))
    linked = per_entity.join(entities.select("entity_id", "grp"), "entity_id").groupBy("year", "grp").agg(F.count("*").alias("n_linked"), F.sum("n_links").alias("n_links"))
    rows = totals.crossJoin(F.broadcast(literal_years(spark, years))).join(linked, ["year", "grp"], "left")
    rows = rows.select("year", "grp", "total", "n_boundary", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    status = audit_status(F.col("total"), F.col("n_linked"), F.col("n_boundary"), F.lit(0))
    return rows.withColumn("pct_linked", percent(F.col("n_linked"), F.col("total"))).withColumn("status", status)


def merge_sources(parts: Sequence[DataFrame], city_wide: str, groups: Sequence[str]) -> DataFrame:
    """Sources (ordinal, year, grp, title, url, category) of several origins: first of each key, city-wide ones fanned out to all groups."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    union = union.withColumn("url", F.coalesce("url", F.lit("")))
    once = first_seen(union, ["year", "grp", "url", "title", "category"], "ordinal")
    spread = F.when(F.col("grp") == city_wide, F.array(*map(F.lit, groups))).otherwise(F.array("grp"))
    return once.withColumn("grp", F.explode(spread)).withColumn("has_scope", has_scope(F.col("category")))


def yearly(rows: DataFrame) -> DataFrame:
    """Yearly sums of a grid, percentages made anew."""
    sums = rows.groupBy("year").agg(*[F.sum(c).alias(c) for c in ("total", "n_linked", "n_links")])
    return sums.withColumn("pct_linked", percent(F.col("n_linked"), F.col("total")))


def audit_view(rows: DataFrame, candidates: DataFrame, *last: Column) -> DataFrame:
    """A grid with each year's and group's candidates and its ``place`` in the year: worst status first, then least coverage, then most of ``last``.

    ``candidates`` (year, grp, n) may hold several rows a group. A year has one row per group, so its places are counted in one small window.
    """
    found = candidates.groupBy("year", "grp").agg(F.sum("n").alias("n_candidates"))
    order = [status_rank(F.col("status")).asc(), F.col("pct_linked").asc(), *[c.desc() for c in last], F.col("grp").asc()]
    out = rows.join(found, ["year", "grp"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("long"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy(*order)).cast("long"))


def guarded_all(condition: Column) -> Column:
    """An aggregate: whether a condition holds for all rows, and there is one; unknown counts as not."""
    return (F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(False))


def distinct_present(c: Column) -> Column:
    """An aggregate: distinct values, outer spaces aside, blank ones not counted."""
    return F.count_distinct(F.nullif(F.trim(c), F.lit("")))
