"""Tables by name: keys, references, and the checks that Spark itself does not make."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """A table's keys. ``refs`` maps a column to (table, column, label column)."""

    name: str
    key: tuple[str, ...]
    uniques: tuple[tuple[str, ...], ...] = ()
    refs: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    writable: bool = True


STAGES = ("primary", "middle", "nine_year")
MODES = ("assign", "placement", "direct", "partial", "unknown")

#: The domain tables and the star schema they are tested on.
TABLES = {
    spec.name: spec
    for spec in (
        TableSpec("schools", ("id",), (("source_key",),), domains={"type": STAGES, "pit_risk_level": ("low", "medium", "high", "unknown")}),
        TableSpec("communities", ("id",), (("name", "district"),)),
        TableSpec("school_communities", ("id",), (("school_id", "community_id"),), {"school_id": ("schools", "id", "name"), "community_id": ("communities", "id", "name")}),
        TableSpec("school_pathways", ("id",), (("primary_school_id", "middle_school_id", "admission_mode"),), {"primary_school_id": ("schools", "id", "name"), "middle_school_id": ("schools", "id", "name")}, {"admission_mode": MODES}),
        TableSpec("policy_documents", ("id",), (("legacy_id",),), {"district_id": ("districts", "id", "display_name"), "school_id": ("schools", "id", "name")}),
        TableSpec("web_data_source", ("id",), (("school_id", "source_url", "source_type"),), {"school_id": ("schools", "id", "name")}),
        TableSpec("districts", ("id",), (("canonical_name",),)),
        TableSpec("community_price_snapshots", ("id",), (("community_id", "source_name", "source_period"),), {"community_id": ("communities", "id", "name")}),
        TableSpec("community_price_sources", ("id",), (), {"community_id": ("communities", "id", "name")}),
        TableSpec("district_boundaries", ("id",), (), {"school_id": ("schools", "id", "name")}),
        TableSpec("region", ("r_regionkey",), writable=False),
        TableSpec("nation", ("n_nationkey",), (), {"n_regionkey": ("region", "r_regionkey", "r_name")}, writable=False),
        TableSpec("customer", ("c_custkey",), (), {"c_nationkey": ("nation", "n_nationkey", "n_name")}),
        TableSpec("supplier", ("s_suppkey",), (), {"s_nationkey": ("nation", "n_nationkey", "n_name")}),
        TableSpec("part", ("p_partkey",)),
        TableSpec("orders", ("o_orderkey",), (), {"o_custkey": ("customer", "c_custkey", "c_name")}, {"o_orderstatus": ("F", "O", "P")}),
        TableSpec("lineitem", ("l_orderkey", "l_linenumber"), (), {"l_orderkey": ("orders", "o_orderkey", "o_orderstatus"), "l_partkey": ("part", "p_partkey", "p_name"), "l_suppkey": ("supplier", "s_suppkey", "s_name")}),
        TableSpec("events", ("event_id",)),
        TableSpec("documents", ("doc_id",)),
        TableSpec("labels", ("doc_id",), (), {"doc_id": ("documents", "doc_id", "source")}),
        TableSpec("pages", ("page_id",)),
        TableSpec("benchmark", ("item_id",)),
        TableSpec("conversations", ("conv_id", "turn")),
        TableSpec("embeddings", ("vec_id",)),
    )
}


def spec(name: str) -> TableSpec:
    """The spec of a registered table; others are refused."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return TABLES[name]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{spec(name).name}.parquet")


def columns(df: DataFrame) -> list[dict]:
    """Name, position, type and nullability of every column."""
    return [{"name": f.name, "ordinal": n, "type": f.dataType.simpleString(), "nullable": f.nullable} for n, f in enumerate(df.schema, 1)]


def referencing(name: str) -> list[tuple[str, str, str]]:
    """(table, column, referenced column) of every reference to a table."""
    return [(t.name, column, ref[1]) for t in TABLES.values() for column, ref in t.refs.items() if ref[0] == name]


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): exact row counts, one plan for all."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def violations(name: str, df: DataFrame, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, n): duplicate keys (nulls never conflict), orphans and values outside a domain."""
    table, parts = spec(name), []
    for rule, key in (("key", table.key), *(("unique", u) for u in table.uniques)):
        groups = df.na.drop(subset=list(key)).groupBy(*key).count().filter("count > 1")
        parts.append(groups.agg(F.count("*").alias("n")).select(F.lit(f"{rule}({','.join(key)})").alias("rule"), "n"))
    for column, (other, target, _) in table.refs.items():
        if others and other in others:
            parts.append(orphans(df, column, others[other], target).agg(F.count("*").alias("n")).select(F.lit(f"ref({column})").alias("rule"), "n"))
    for column, values in table.domains.items():
        parts.append(df.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*values)).alias("n")).select(F.lit(f"domain({column})").alias("rule"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def orphans(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null reference has no row in the target."""
    keys = target.select(F.col(key).alias("__key"))
    return df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__key"), "left_anti")
