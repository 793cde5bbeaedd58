"""A training corpus from ``documents``: screened by language, deduplicated, redacted, mixed, packed.

Every stage but the last takes and returns the columns of ``documents``; each is written as Parquet
and read again as the next one's input, so a lost executor costs at most the stage under way.

``language`` drops documents without a determined language (null texts, texts without letters) or
with a pooled probability below ``LEAST_SCORE``, and fills in null languages. ``near_duplicates``
keeps the least doc_id of each group of texts linked by a Jaccard similarity of 0.8 or more of their
five-word shingles, which bit-sliced comparison of SimHash fingerprints proposes. ``personal_data`` replaces every found span by its kind and sets n_chars anew.
``mixing`` puts the documents in mixed order. ``packing`` returns the pieces of sequences of 2048
tokens with their token ids, so a sequence is trained on by joining its pieces at their offsets;
sequences follow the mixed order, but for pieces of up to 1024 documents that are fitted together.

Null doc_ids pass every stage; other columns than those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import langid, mixing, nearcopies, packing, pii
from lodestrata.llm.common import DOCUMENT_COLUMNS, shared_path, table

#: Documents in two or three languages score about a half; noise without a language scores less.
LEAST_SCORE = 0.35

#: SQL has no recurrent network; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*DOCUMENT_COLUMNS)
    return langid.screen(docs, langid.fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicate(docs.select(*DOCUMENT_COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs.select(*DOCUMENT_COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.ordered(mixing.mix(docs.select(*DOCUMENT_COLUMNS))).select(*DOCUMENT_COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ordinary=False, with_ids=True, small=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing_sources),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stages hand on lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
