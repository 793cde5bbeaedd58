"""Operator 12's words as numbers: which rows are counted, and numbers that two words share."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import phrases


def documents(spark, texts):
    return spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)


def test_counts_of_pairs_grow_with_the_input(spark, monkeypatch):
    """Pairs that are rare in a small table and frequent in one of five times the rows make five times the rows in it."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 500)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices("abcdefghijklmnopqrst", k=100)) for _ in range(30)]
    plain, calls = phrases._summed, []

    def counted(counts, *by):
        if by != ("bucket",):
            calls.append(counts.count())
        return plain(counts, *by)

    monkeypatch.setattr(phrases, "_summed", counted)

    def pairs(copies):
        calls.clear()
        found, _ = phrases.frequent(spark, documents(spark, texts * copies), least=30)
        assert all(n <= 3000 * copies for n in calls[-3:])  # at most as many rows as words
        return calls[-3], found.filter("size = 2").count()

    (small, few), (large, many) = pairs(1), pairs(5)
    assert few < 5 and many > 200 and 0 < small and large <= 6 * small


def test_words_that_share_a_number_are_numbered_anew(spark, monkeypatch, tmp_path):
    df = documents(spark, ["a b c d e f g h a b c", "a b, a"]).unionByName(spark.createDataFrame([("de", "a b a")], "lang string, text string"))
    for bits, turn in ((2, 1), (64, 0)):
        monkeypatch.setattr(phrases, "BUCKET_BITS", bits)
        path = f"{tmp_path}/{bits}"
        lists, words = phrases._counted_words(spark, df, path, 1)
        assert (tmp_path / str(bits) / f"words-{turn}").exists() and not (tmp_path / str(bits) / f"words-{turn + 1}").exists()
        rows = {(r["lang"], r["phrase"]): r["f"] for r in words.collect()}
        assert rows["en", "a"] == 4 and rows["de", "a"] == 2 and rows["en", "h"] == 1 and len(rows) == 10
        assert words.select("id").distinct().count() == 10
        assert {r["id"] for r in lists.select(F.explode("ids").alias("id")).collect()} == {r["id"] for r in words.collect()}


def test_hashes_of_several_numbers_are_those_of_spark(spark):
    rng = np.random.default_rng(4)
    rows = rng.integers(-(1 << 63), 1 << 63, (200, 3))
    df = spark.createDataFrame([(n, *map(int, r)) for n, r in enumerate(rows)], "n int, a long, b long, c long")
    want = [r["h"] for r in df.orderBy("n").select(F.xxhash64("a", "b", "c").alias("h")).collect()]
    hashes = phrases._hashed_longs(rows[:, 0])
    for column in (1, 2):
        hashes = phrases._hashed_longs(rows[:, column], hashes)
    assert hashes.view(np.int64).tolist() == want
