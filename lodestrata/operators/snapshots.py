"""Published snapshots: data, manifest and a pointer that is swapped in one step.

A snapshot's data are written below a name of their own; a content hash, the number of rows and
statistics are gathered while they are written. The manifest follows, and last the pointer: a file
that is written beside the old one and renamed over it. Readers follow the pointer, so they see
whole snapshots only; what a killed run leaves behind is never pointed at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "latest.json"


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row's values, of nested and missing ones too."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if f.dataType.typeName() in ("map", "struct", "array", "variant") else F.col(f"`{f.name}`") for f in df.schema], *[F.col(f"`{f.name}`").isNull() for f in df.schema])


def content_metrics(df: DataFrame) -> list[Column]:
    """Aggregates that do not depend on the order of rows and tell repeated rows apart from single ones."""
    h = row_hash(df)
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum_low"), F.coalesce(F.sum(F.shiftrightunsigned(h, 31).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum_high")]


def _hash(df: DataFrame, got: Mapping[str, object]) -> str:
    import hashlib

    return hashlib.sha256(f"{df.schema.simpleString()};{got['n_rows']};{got['sum_low']};{got['sum_high']}".encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """The hash of a relation's rows, whatever their order; that of a published snapshot stands in its manifest."""
    return _hash(df, df.agg(*content_metrics(df)).first().asDict())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def publish(df: DataFrame, root: str, stats: Mapping[str, Column] | None = None, **about: object) -> dict[str, object]:
    """Writes a snapshot of df below ``root`` and points readers to it; returns its manifest.

    ``stats`` are aggregates gathered in the same pass; ``about`` (scope, parser version, source URL and
    so on) is kept in the manifest. An unchanged content makes a new snapshot with the same hash.
    """
    spark, name, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    metrics = [c.alias(f"s_{n}") for n, c in (stats or {}).items()]
    df.observe(seen, *content_metrics(df), *metrics).write.parquet(f"{root}/{name}/data")
    got = seen.get
    manifest = {"snapshot": name, "contentHash": _hash(df, got), "rows": got["n_rows"], "stats": {n: got[f"s_{n}"] for n in stats or {}}, **about}
    _write_text(spark, f"{root}/{name}/manifest.json", json.dumps(manifest, ensure_ascii=False, default=str))
    _point(spark, root, name)
    return manifest


def _point(spark: SparkSession, root: str, name: str) -> None:
    """Swaps the pointer: the new file is renamed over the old one."""
    fresh = f"{root}/{POINTER}.{name}"
    _write_text(spark, fresh, json.dumps({"snapshot": name}))
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, option = hadoop.Path(fresh), hadoop.Options.Rename
    files = hadoop.FileContext.getFileContext(source.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    files.rename(source, hadoop.Path(f"{root}/{POINTER}"), options)


def manifest(spark: SparkSession, root: str) -> dict[str, object]:
    """The manifest of the snapshot that readers see, or FileNotFoundError."""
    try:
        name = json.loads(_read_text(spark, f"{root}/{POINTER}"))["snapshot"]
    except Py4JJavaError:
        raise FileNotFoundError(f"nothing is published below {root}") from None
    return json.loads(_read_text(spark, f"{root}/{name}/manifest.json"))


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the snapshot that readers see."""
    return spark.read.parquet(f"{root}/{manifest(spark, root)['snapshot']}/data")


def report(manifests: Sequence[Mapping[str, object]], spark: SparkSession) -> DataFrame:
    """Manifests as rows: snapshot, content_hash, rows, and the statistics as JSON."""
    rows = [(str(m["snapshot"]), str(m["contentHash"]), int(m["rows"]), json.dumps(m["stats"], default=str)) for m in manifests]
    return spark.createDataFrame(rows, "snapshot string, content_hash string, rows long, stats string")
