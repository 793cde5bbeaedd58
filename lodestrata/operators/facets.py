"""Search with facets: the counts of every choice, the number of hits and one page of them, from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestrata.shared import shared_path


@dataclass(frozen=True)
class Found:
    """A page of hits with ``position`` from 1, and what was counted on the way."""

    page: DataFrame
    number: int
    n_pages: int
    n_all: int
    n_visible: int
    counts: dict[str, int]


def any_contains(text: str, *columns: Column) -> Column:
    """Whether any column holds the text, case and outer spaces aside; every row for no text, nulls hold none."""
    wanted = text.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
    return hit if wanted else F.lit(True)


def faceted(df: DataFrame, choices: Mapping[str, Column], hit: Column, order: Sequence[Column], number: int = 1, size: int = 50) -> Found:
    """The page ``number`` (from 1, the last one if there are fewer) of the rows that ``hit``, and counts over all rows.

    ``order`` must tell all rows apart, so that pages are the same on every run. Counts are gathered
    by an observation while the top rows are found, so the table is scanned once; rows up to the
    page's end are kept, in a table in the shared folder, as a page beyond the last one is clamped only then.
    """
    number, size, path, seen = max(1, number), max(1, size), shared_path(df.sparkSession, "facets"), Observation()
    metrics = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{n}") for n, c in enumerate(choices.values())]
    marked = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    marked = marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("__hit").alias("hits"), *metrics)
    marked.filter("__hit").drop("__hit").orderBy(*order).limit(number * size).write.parquet(path)
    got = seen.get
    pages = max(1, -(-got["hits"] // size))
    number = min(number, pages)
    top = df.sparkSession.read.parquet(path).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))  # at most number * size rows
    page = top.filter(F.col("position").between((number - 1) * size + 1, number * size))
    return Found(page, number, pages, got["n"], got["hits"], {name: got[f"c{n}"] for n, name in enumerate(choices)})
