"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import html, langid, mixing, packing, phrases, pii, quality, runs, secrets, simhash, tokencounts, warc, webp
from lodestrata.llm.common import shared_path, table
from lodestrata.llm.sql import ORACLES


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ordinary=False)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.digest(langid.identify(documents, langid.fit(documents)))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.digest(quality.judge(documents, rules))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.bundles(table(spark, sf_dir, "pages")).write.option("compression", "uncompressed").parquet(path)
    return warc.read_bundles(spark.read.parquet(path))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokencounts.write_blocks(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    return tokencounts.named(tokencounts.count(written.filter("data is not null")), written)


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.from_media(webp.to_media(table(spark, sf_dir, "documents")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(*phrases.frequent(spark, table(spark, sf_dir, "documents")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_packing, op3_langid, op4_html, op5_mixing, op6_quality, op7_simhash, op8_warc, op9_tokens, op10_webp, op11_secrets, op12_phrases, op13_runs)
}
ORACLE_SQL: dict[str, str] = ORACLES
