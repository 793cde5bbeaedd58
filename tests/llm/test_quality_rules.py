"""Quality rules: what is learned from few labels, and conjunctions where one threshold is not enough."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestrata.llm import entries, quality


def test_rules_are_learned_at_every_scale(spark, sf):
    for scale in ("sf0.01", "sf0.1"):
        folder = sf.replace("sf0.001", scale)
        df, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
        rules = quality.fit(df, labels)
        assert rules, scale
        got = entries.op6_quality(spark, folder).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
        n = {(r["quality"], r["kept"]): r["count"] for r in got}
        assert n.get((0, True), 0) <= 0.05 * (n.get((0, True), 0) + n.get((0, False), 0)) and n.get((1, False), 0) <= 0.01 * n[1, True]


def test_a_conjunction_is_grown_and_rejects(spark):
    rng = random.Random(2)
    rows = []
    for n in range(900):
        many_symbols, long_words = rng.random() < 0.3, rng.random() < 0.3
        letters = 1200 if long_words else 500
        rows.append((100, letters, letters // 10 if many_symbols else 0, int(not (many_symbols and long_words)), n % 3))
    names = "n_words long, word_chars long, n_symbols long, quality int, fold int"
    sample = spark.createDataFrame(rows, names).withColumns({c: F.lit(0).cast("long") for c in ("n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")}).withColumn("n_distinct", F.lit(80).cast("long"))
    rules = quality.learn(sample)
    assert len(rules) == 1 and {x.feature for x in rules[0]} == {"mean_word", "symbol_share"}
    wrong = sample.filter(quality.verdict(rules).isNotNull() != (F.col("quality") == 0)).count()
    assert wrong == 0
