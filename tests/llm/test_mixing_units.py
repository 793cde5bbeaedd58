"""Mixing by the characters that are dealt, against the wanted weights."""

from __future__ import annotations

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import mixing


def made_docs(spark, n=6000, sources="aab"):
    rng = random.Random(3)
    size = lambda i: 30_000 if i == 77 else int(rng.paretovariate(1.2) * 50) % 4000
    rows = [(i if i % 50 else None, sources[i % len(sources)], size(i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size int")
    return docs.select("doc_id", "source", F.expr("concat(cast(rand(1) as string), repeat('x', size))").alias("text")).cache()


def dealt(mixed):
    """(slot, source, characters) in mixed order, and the longest text."""
    rows = mixed.select("mix_slot", "source", F.length("text").alias("u")).filter("mix_slot is not null").collect()
    return sorted((r["mix_slot"], r["source"], r["u"]) for r in rows), max(r["u"] for r in rows)


def most_deviation(mixed, weights, block):
    """The most characters that a source, while it lasts, is away from its weight of the slots so far."""
    rows, longest = dealt(mixed)
    total = sum(weights.values())
    most = 0.0
    for source in {s for _, s, _ in rows}:
        done, share = 0, weights[source] / total * block
        for slot, parts in groupby((r for r in rows if r[1] == source), key=lambda r: r[0]):
            most = max(most, abs(done - slot * share))
            done += sum(u for *_, u in parts)
            most = max(most, abs(done - (slot + 1) * share))
    return most, longest


@pytest.mark.parametrize("window_rows", [100, 10_000])
def test_characters_stay_near_the_weights(spark, monkeypatch, window_rows):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", window_rows)
    docs, weights, block = made_docs(spark), {"a": 2.0, "b": 1.0}, 2000
    mixed = mixing.mix(docs, weights, block_units=block)
    assert mixed.count() == docs.count()
    most, longest = most_deviation(mixed, weights, block)
    assert longest > 10 * block and most < block + longest
    most, longest = most_deviation(mixing.mix(docs.filter(F.length("text") < block), weights, block_units=block), weights, block)
    assert most < block + longest


def test_schedule_follows_the_wanted_weights():
    for weights in ({"hot": 0.5, **{f"s{n}": 0.5 / 99 for n in range(99)}}, {"a": 0.9995, "b": 0.0005}, {"a": 0.1, "b": 0.2, "c": 0.7}):
        total = sum(weights.values())
        done = dict.fromkeys(weights, 0)
        for s, block, slot, release, deadline in mixing.schedule(mixing.quotas(weights), {s: int(6000 * w / total) + 1 for s, w in weights.items()}):
            assert release <= slot < deadline and block == done[s]
            assert abs(done[s] - slot * weights[s] / total) < 1 + 1e-6
            done[s] += 1
            assert abs(done[s] - (slot + 1) * weights[s] / total) < 1 + 1e-6
        assert all(n == int(6000 * weights[s] / total) + 1 for s, n in done.items())


def test_given_weights_are_kept_zero_included(spark):
    docs = made_docs(spark, 900, "abc")
    mixed = mixing.mix(docs, {"a": 0.9995, "b": 0.0005, "c": 0.0}, block_units=500).cache()
    assert mixed.count() == 900 and mixed.filter("(mix_slot is null) != (source = 'c')").count() == 0
    ordered = mixing.ordered(mixed)
    assert ordered.count() == 600 and ordered.filter("source = 'c'").count() == 0
    assert mixed.filter("source = 'b' and mix_block = 1").select("mix_release").first()[0] in (None, 2000) and mixed.filter("source = 'b' and mix_block > 1 and mix_release < 2000 * mix_block - 1").count() == 0
    with pytest.raises(ValueError):
        mixing.quotas({"a": 1.0, "b": -1.0})


def test_many_sources_are_not_refused(spark):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 12_000).alias("source"), F.lit("some text").alias("text"))
    placed = mixing.mix(docs).select("source", "mix_block", "mix_slot", "mix_release", "mix_deadline").distinct().collect()
    assert len(placed) == len({r["mix_slot"] for r in placed}) == 12_000
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in placed)
