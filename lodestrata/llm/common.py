"""Shared plumbing of the training-data operators: reading, shipping, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space and U+0009 to U+000D. Fixed by the contracts.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_CLASS = r"[\x20\x09-\x0D]"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of an Arrow batch; with the longest text it bounds what a Python worker holds at once.
ARROW_ROWS = 1024

_fallback_shared: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable on the executors and bounds Arrow batches. Idempotent."""
    context = spark.sparkContext
    if not getattr(context, "_lodestrata_shipped", False):
        here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(here):
            archive = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), f"lodestrata-{uuid.uuid4().hex[:8]}.zip")
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
                for folder, _, names in os.walk(here):
                    for name in names:
                        if name.endswith(".py"):
                            path = os.path.join(folder, name)
                            out.write(path, os.path.relpath(path, os.path.dirname(here)))
            context.addPyFile(archive)
        context._lodestrata_shipped = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    key = spark.sparkContext.applicationId
    if key not in _fallback_shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _fallback_shared[key] = tempfile.mkdtemp(prefix="lodestrata-shared-")
    return _fallback_shared[key]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage, so a lost executor costs a re-read only."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def hash_sample(rows: DataFrame, n: int, *key: str, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, chosen and ordered by a hash of ``key``; the same rows on every run.

    A threshold on the hash, from a count (``total``, if it is known), leaves about half as many
    again as are wanted over all tasks together, so what the final sort collects is bounded by
    ``n`` and not by the number of tasks.
    """
    total = rows.count() if total is None else total
    hashed = rows.withColumn("__order", F.xxhash64(*key, F.lit("sample")))
    if total > 2 * n + 100:
        share = (1.5 * n + 50) / total
        hashed = hashed.filter(F.pmod("__order", F.lit(1 << 40)) < int(share * (1 << 40)))
    rest = [c for c in rows.columns if c not in key]
    return hashed.orderBy("__order", *key, *rest).limit(n).drop("__order")
