"""Operator 12 against counting every phrase, and its query against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestrata.llm import phrases
from lodestrata.llm.entries import ORACLE_SQL, QUERIES


def brute(rows, least=30, top=2000, longest=4):
    """The contract's result, from counts of all phrases."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\t]", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def run(spark, rows, least=30, top=2000):
    df = spark.createDataFrame([(i, t, lang, "x", t) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, words string, phrase string")
    return sorted(map(tuple, phrases.collocations(*phrases.frequent(spark, df, least=least), top=top).collect()))


def test_small_texts_equal_counting(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 200)
    rnd = random.Random(1)
    words = ["a", "B", "b", "c", "\U0001f600", "ä", "Ä", "x y", "d\x00"]
    rows = [(rnd.choice(["en", "de", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", ". ", "\n", " , ", "\x0b", ""]) for _ in range(rnd.randrange(60)))) for _ in range(250)]
    rows += [("en", "new york city hall"), ("en", None), ("en", ""), ("fr", " .\t,\n")] + [("en", "in New York city today. New york")] * 12 + [("es", "a a a a a a a a")] * 3
    assert run(spark, rows, least=5) == brute(rows, least=5)
    assert run(spark, rows, least=5, top=3) == brute(rows, least=5, top=3)
    assert run(spark, rows[:0]) == []
    assert run(spark, [("en", None), (None, "")]) == []


def test_a_long_text_and_a_full_filter(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [("en", " ".join(rnd.choices("abcdefghijkl", k=20_000))), ("en", "q " * 50)]
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 100
    monkeypatch.setattr(phrases, "MOST_FILTER_BITS", phrases.BITMAP_BITS)
    monkeypatch.setattr(phrases, "BUCKET_BITS", 3)
    assert run(spark, rows) == want  # full buckets
    monkeypatch.setattr(phrases.Filter, "holds", lambda self, hashes: np.ones(len(hashes), bool))  # a filter that lets all pass
    assert run(spark, rows) == want


def test_filter_holds_what_it_was_built_of(spark):
    rows = [("en", f"w{i} v") for i in range(5000)]
    texts = [p for _, p in rows]
    made = phrases.Filter.of(spark.createDataFrame(rows, "lang string, phrase string"), "lang", "phrase")
    assert made.holds(phrases._hashes("en", texts)).all() and made.holds(phrases._hashes("de", texts)).mean() < 0.01
    assert not phrases.Filter.of(spark.createDataFrame([], "lang string, phrase string"), "lang", "phrase").holds(phrases._hashes("en", ["a"])).any()
    numbers = spark.range(0, 1 << 40, (1 << 40) // 3000 + 1)
    made = phrases.Filter.of(numbers, "id")
    ids = np.array([r["id"] for r in numbers.collect()], np.uint64)
    assert made.holds(phrases._hashed_longs(ids)).all() and made.holds(phrases._hashed_longs(ids + np.uint64(1))).mean() < 0.01


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)]
    df = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    out = phrases.collocations(df, spark.createDataFrame([("en", big)], "lang string, n long")).collect()
    assert [r.score for r in out] == [2_000_000 * (big - 3) // (2 * big - 1)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    result = duck.execute(ORACLE_SQL["op12_phrases"])
    names = [d[0] for d in result.description]
    df = QUERIES["op12_phrases"](spark, folder)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())
