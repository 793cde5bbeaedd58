"""Generic table browsing: search, per-column filters, display columns of references, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestrata.registry import TableSpec

PAGE_SIZE, MAX_PAGE_SIZE = 30, 200


def clamp(value: object, fallback: int, most: int, least: int = 1) -> int:
    """A whole number from a request: the fallback if it is none, else kept within bounds."""
    try:
        return max(least, min(most, int(str(value))))
    except ValueError:
        return fallback


def any_column_contains(df: DataFrame, text: str, only_text: bool = True) -> Column:
    """Whether some column contains a text, case aside; % and _ in it are wildcards."""
    names = [f.name for f in df.schema if not only_text or isinstance(f.dataType, StringType)]
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(n).cast("string").ilike(f"%{text}%"), F.lit(False)) for n in names], F.lit(False))


def each_column_contains(df: DataFrame, wanted: dict[str, str]) -> Column:
    """Whether every named column contains its text; unknown columns are ignored."""
    known = [F.col(n).cast("string").ilike(f"%{text}%") for n, text in wanted.items() if n in df.columns and text]
    return reduce(lambda a, b: a & b, known, F.lit(True))


def optional(column: Column, value: object) -> Column:
    """Equality, or no condition where the parameter is not set."""
    return F.lit(True) if value is None else column == F.lit(value)


def among(column: Column, values: list | None) -> Column:
    """Membership; no condition for None, no row for an empty list."""
    if values is None:
        return F.lit(True)
    return column.isin(*values) if values else F.lit(False)


def any_element_contains(items: Column, text: str) -> Column:
    """Whether some element of a list contains a text, case aside; a null list has none."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(x.ilike(f"%{text}%"), F.lit(False))), F.lit(False))


def first_present_contains(text: str, *columns: Column) -> Column:
    """Whether the first of the columns that is not null contains a text, case aside; it hides those after it."""
    return F.coalesce(*columns, F.lit("")).ilike(f"%{text}%")


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def tables_named(spark: SparkSession, text: str) -> DataFrame:
    """(name, kind) of the session's tables and views whose name contains a text, by name."""
    found = sorted((t.name, t.tableType) for t in spark.catalog.listTables() if text.strip().lower() in t.name.lower())
    return spark.createDataFrame(found, "name string, kind string")


def with_labels(df: DataFrame, table: TableSpec, others: dict[str, DataFrame]) -> DataFrame:
    """Adds ``__fk_<column>``, the label of the row that each reference points to."""
    for column, (other, key, label) in table.refs.items():
        if other in others:
            dim = others[other].select(F.col(key).alias(f"__key_{column}"), F.col(label).cast("string").alias(f"__fk_{column}"))
            df = df.join(dim, F.col(column) == F.col(f"__key_{column}"), "left").drop(f"__key_{column}")
    return df


def page(df: DataFrame, number: object = 1, size: object = PAGE_SIZE, order: str | None = None, descending: bool = True, key: tuple[str, ...] = ("id",), most: int = MAX_PAGE_SIZE) -> DataFrame:
    """One page in a total order: the chosen column, then the key. An unknown order column is an error."""
    if order is not None and order not in df.columns:
        raise ValueError(f"unknown column: {order}")
    names = ([order] if order else []) + [k for k in key if k != order]
    turned = [F.col(n).desc_nulls_last() if descending else F.col(n).asc_nulls_last() for n in names]
    size = clamp(size, PAGE_SIZE, most)
    return df.orderBy(*turned).offset((clamp(number, 1, 1 << 31) - 1) * size).limit(size)


def clamped_page(df: DataFrame, number: object = 1, size: object = 50, **options: object) -> DataFrame:
    """A page, the last one for numbers beyond it."""
    size = clamp(size, 50, MAX_PAGE_SIZE)
    return page(df, min(clamp(number, 1, 1 << 31), max(1, -(-df.count() // size))), size, **options)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """(total, total_pages); no pages of nothing."""
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def top(df: DataFrame, count: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(count)


def counter(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
