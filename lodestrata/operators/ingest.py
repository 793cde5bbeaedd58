"""Idempotent ingest and snapshot writes: insert-or-ignore, upsert, replace-by-source, guarded row edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.dedupe import best_per_key, first_seen
from lodestrata.registry import TableSpec, referencing, spec

MAX_RECORDS, MAX_DELETES = 2000, 1000


def payloads(bodies: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON request bodies: (key, ordinal, source, record_type, record_key, school_id, community_id, committee, year, url, quote) and (key, error).

    A body is taken whole or not at all; its error is the first of: no object, a bad source key, no source name, no
    records, more than ``MAX_RECORDS`` of them, and the first record that lacks a type, a key or an id above zero.
    """
    def text(v: Column, path: str) -> Column:
        """A text of at least one character; null for values of other types."""
        x = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit("")))

    def number(v: Column, path: str) -> Column:
        """A whole number above zero, given as a number or as text."""
        x = F.try_variant_get(v, path, "variant")
        value = F.when(~F.schema_of_variant(x).isin("BOOLEAN", "VOID"), F.try_variant_get(x, "$", "string")).try_cast("double")
        return F.when((value > 0) & (value == F.floor(value)) & (value < 2.0**63), value.cast("long"))

    def fault(r: Column, i: Column) -> Column:
        said = F.concat(F.lit("records["), i.cast("string"), F.lit("]"))
        return (
            F.when(~F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False)), F.concat(said, F.lit(" must be an object")))
            .when(text(r, "$.recordType").isNull(), F.concat(said, F.lit(".recordType is required"))).when(text(r, "$.sourceKey").isNull(), F.concat(said, F.lit(".sourceKey is required")))
            .when(number(r, "$.schoolId").isNull(), F.concat(said, F.lit(".schoolId must be a positive integer"))).when(number(r, "$.communityId").isNull(), F.concat(said, F.lit(".communityId must be a positive integer")))
        )

    rows = bodies.select(F.col(key).alias("key"), F.try_parse_json(body).alias("v"))
    rows = rows.select("key", "v", F.try_variant_get("v", "$.records", "array<variant>").alias("records"))
    faults = F.filter(F.transform("records", fault), lambda x: x.isNotNull())
    error = (
        F.when(~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "body must be a JSON object")
        .when(~F.coalesce(text(F.col("v"), "$.sourceKey").rlike("^[a-z0-9._-]{1,64}$"), F.lit(False)), "sourceKey must match ^[a-z0-9._-]{1,64}$").when(text(F.col("v"), "$.sourceName").isNull(), "sourceName is required")
        .when(F.coalesce(F.size("records"), F.lit(0)) <= 0, "records must be a non-empty array").when(F.size("records") > MAX_RECORDS, f"records exceeds {MAX_RECORDS} per request").otherwise(F.get(faults, F.lit(0)))
    )
    told = rows.withColumn("error", error)
    good = told.filter("error is null").select("key", text(F.col("v"), "$.sourceKey").alias("source"), F.posexplode("records").alias("ordinal", "r"))
    r, year = F.col("r"), F.try_variant_get("r", "$.year", "string").try_cast("double")
    raw = F.try_variant_get("r", "$.raw", "variant")
    records = good.select(
        "key", F.col("ordinal").cast("long").alias("ordinal"), "source", text(r, "$.recordType").alias("record_type"), text(r, "$.sourceKey").alias("record_key"), number(r, "$.schoolId").alias("school_id"), number(r, "$.communityId").alias("community_id"),
        F.try_variant_get("r", "$.committeeName", "string").alias("committee"), F.when(year > 2000, year.cast("int")).otherwise(F.year(F.current_date())).alias("year"), F.try_variant_get("r", "$.sourceUrl", "string").alias("url"),
        F.coalesce(F.try_variant_get("r", "$.sourceQuote", "string"), F.to_json(raw)).alias("quote"),
    )
    return records, told.filter("error is not null").select("key", "error")


def insert_or_ignore(received: DataFrame, existing: DataFrame, keys: Sequence[str], ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(rows to add, one row of counters): the first of each key that is not there yet."""
    unique = first_seen(received, keys, ordinal)
    fresh = unique.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    counters = (
        received.agg(F.count("*").alias("received"))
        .crossJoin(unique.agg(F.count("*").alias("n_unique")))
        .crossJoin(fresh.agg(F.count("*").alias("added")))
        .select("received", "added", (F.col("n_unique") - F.col("added")).alias("unchanged"), (F.col("received") - F.col("n_unique")).alias("skipped"))
    )
    return fresh, counters


def with_defaults(records: DataFrame, source_key: str) -> DataFrame:
    """Fills in what ingest records may leave out."""
    year = F.when(F.col("year") > 2000, F.col("year")).otherwise(F.year(F.current_date()))
    quote = F.coalesce("sourceQuote", "raw")
    made = {"year": year, "source_quote": quote, "source_name": F.lit(source_key), "verified": F.lit(False), "source_date": F.date_format(F.current_date(), "yyyy-MM-dd")}
    return records.withColumns(made)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *newest: Column) -> DataFrame:
    """All keys of both, each with its newest row; equal ones go to the incoming side."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return best_per_key(both, keys, *newest, F.col("__new").desc()).drop("__new")


def replace_source(existing: DataFrame, incoming: DataFrame, source: str, value: str) -> DataFrame:
    """Drops the source's own rows and adds the incoming ones."""
    return existing.filter(~F.col(source).eqNullSafe(F.lit(value))).unionByName(incoming)


def fill_missing(df: DataFrame, found: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Takes found values only where a column is blank."""
    renamed = found.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    kinds = dict(df.dtypes)
    old = {c: F.nullif(F.btrim(c), F.lit("")) if kinds[c] == "string" else F.col(c) for c in columns}
    return df.join(renamed, list(keys), "left").withColumns({c: F.coalesce(old[c], F.col(f"__{c}")) for c in columns}).select(*df.columns)


# --- guarded row edits on snapshots: the caller writes the returned frame as the next version ---


def _typed(df: DataFrame, values: Mapping[str, object], fixed: Sequence[str]) -> dict[str, Column]:
    """Coerced literals of the known columns; what the table fills in by itself is left out."""
    kinds = dict(df.dtypes)
    out = {}
    for name, value in values.items():
        if name not in kinds or name in fixed:
            continue
        blank = value is None or (value == "" and kinds[name] != "string")
        out[name] = F.lit(None).cast(kinds[name]) if blank else F.lit(str(value) if not isinstance(value, bool | int | float) else value).cast(kinds[name])
    if not out:
        raise ValueError("no known column to write")
    return out


def _writable(name: str) -> TableSpec:
    table = spec(name)
    if not table.writable:
        raise ValueError(f"{name} is read-only")
    return table


def _one(df: DataFrame, key: Mapping[str, object], table: TableSpec) -> Column:
    if set(key) != set(table.key):
        raise ValueError(f"the whole key is needed: {', '.join(table.key)}")
    match = F.lit(True)
    for name, value in key.items():
        match = match & (F.col(name) == F.lit(value))
    if (n := df.filter(match).limit(2).count()) != 1:
        raise LookupError(f"{n or 'no'} row has this key")
    return match


def insert_row(df: DataFrame, name: str, values: Mapping[str, object]) -> DataFrame:
    table = _writable(name)
    row = _typed(df, values, ("id", "created_at", "updated_at"))
    key = table.key[0]
    if len(table.key) == 1 and key not in row:
        row[key] = F.lit((df.agg(F.max(key)).first()[0] or 0) + 1).cast(dict(df.dtypes)[key])
    new = df.sparkSession.range(1).select(*[row.get(c, F.lit(None).cast(k)).alias(c) for c, k in df.dtypes])
    return df.unionByName(new)


def update_row(df: DataFrame, name: str, key: Mapping[str, object], values: Mapping[str, object]) -> DataFrame:
    table = _writable(name)
    changes = _typed(df, values, (*table.key, "created_at", "updated_at"))
    match = _one(df, key, table)
    return df.withColumns({c: F.when(match, v).otherwise(F.col(c)) for c, v in changes.items()})


def blockers(df_key: object, name: str, others: Mapping[str, DataFrame]) -> list[tuple[str, int]]:
    """(table.column, rows) of the references to a key, most first."""
    found = [(f"{t}.{c}", others[t].filter(F.col(c) == F.lit(df_key)).count()) for t, c, _ in referencing(name) if t in others]
    return sorted(((t, n) for t, n in found if n), key=lambda x: (-x[1], x[0]))


def delete_row(df: DataFrame, name: str, key: Mapping[str, object], others: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Without the row; refused while other rows refer to it."""
    table = _writable(name)
    match = _one(df, key, table)
    if others and len(table.key) == 1 and (held := blockers(key[table.key[0]], name, others)):
        raise PermissionError("still referred to by " + ", ".join(f"{t} ({n})" for t, n in held))
    return df.filter(~match)


def delete_rows(df: DataFrame, name: str, keys: Sequence[Mapping[str, object]]) -> DataFrame:
    """Without all of the rows, or an error if one is not there."""
    table = _writable(name)
    if not 0 < len(keys) <= MAX_DELETES:
        raise ValueError(f"1 to {MAX_DELETES} rows at a time")
    kinds = dict(df.dtypes)
    wanted = df.sparkSession.createDataFrame([tuple(k[c] for c in table.key) for k in keys], ", ".join(f"{c} {kinds[c]}" for c in table.key)).distinct()
    if df.join(F.broadcast(wanted), list(table.key), "left_semi").count() != wanted.count():
        raise LookupError("some rows are not there")
    return df.join(F.broadcast(wanted), list(table.key), "left_anti").select(*df.columns)


def save_version(df: DataFrame, spark: SparkSession, root: str, name: str) -> str:
    """Writes the next version of a table and returns its path; earlier ones stay for going back."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    number = 1 + max([int(d[1:]) for d in done if d[:1] == "v" and d[1:].isdigit()], default=0)
    df.write.mode("error").parquet(target := f"{root}/{name}/v{number:06d}")
    return target
