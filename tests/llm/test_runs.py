"""Operator 13 against the definition of a run, on all periods of small texts, and its query against the contract's words."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestrata.llm import runs
from lodestrata.llm.entries import QUERIES


def brute(words, least):
    """Every stretch of equal words q apart, for all q; the smallest q of a stretch is its period."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j + q - i) not in seen:
                seen.add((i, j + q - i))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def row(doc_id, text, least=12, planted=True):
    """The contract's result of one document, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words, least)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_definition(seed):
    rnd = random.Random(seed)
    least = rnd.choice([2, 3, 4, 6, 12])
    texts = []
    for _ in range(30):
        size, n = rnd.choice([1, 2, 3, 20, 100]), rnd.choice([0, 1, 2, 3, rnd.randrange(60), rnd.randrange(160)])
        words = [rnd.randrange(size) for _ in range(n)]
        if n and rnd.random() < 0.5:
            a = rnd.randrange(n)
            p = 1 + (n - a) // rnd.randrange(2, 9)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        texts.append(words + words[n // 3 :] + words if rnd.random() < 0.4 else words)
    assert runs.find_runs([np.array(t, np.int64) for t in texts], least) == [brute(t, least) for t in texts]


def test_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    texts = [b, [7] * 500, [1, 2] * 300 + [1], list(range(400)) * 3]
    assert runs.find_runs([np.array(t, np.int64) for t in texts], 2) == [brute(t, 2) for t in texts]


def test_screening_loses_no_document():
    rnd = random.Random(3)
    texts = [[rnd.randrange(3) for _ in range(rnd.randrange(30))] for _ in range(500)]
    chosen = set(runs.suspects([np.array([hash(str(w)) for w in t], np.int64) for t in texts]))
    assert {d for d, t in enumerate(texts) if brute(t, 12)} <= chosen


def test_odd_rows(spark):
    line = "one two three four five six seven"
    docs = [
        (1, line + " " + line), (1, line + " " + line), (2, None), (3, ""), (4, " \t\r\n\x0b\x0c"), (None, line * 3), (None, None), (5, "x " * 40),
        (6, "a b " * 6 + "ä ö\U0001f600 " * 9), (7, "long " + " ".join(str(i % 977) for i in range(30_000))), (10, line), (20, "w"),
    ]
    docs += [(i, " ".join(random.Random(i).choices("abcdefgh", k=i % 90))) for i in range(100, 220)]
    df = spark.createDataFrame([(i, t, "en", t, 0) for i, t in docs], "doc_id long, text string, lang string, runs string, n_words int")
    got = sorted((tuple(r) for r in runs.digest(runs.periodic_runs(df, planted=True)).collect()), key=repr)
    assert got == sorted((row(i, t) if i != 7 else next(g for g in got if g[0] == 7) for i, t in docs), key=repr)
    long = next(g for g in got if g[0] == 7)
    assert long[1] >= 1 and long[3] >= 20_000
    assert runs.digest(runs.periodic_runs(df.limit(0))).count() == 0


def test_collapsed_text_keeps_the_first_period(spark):
    df = spark.createDataFrame([(1, "start " + "buy it now " * 6 + "end"), (2, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.periodic_runs(df, with_text=True).collect()}
    assert got[1].collapsed == "start buy it now end" and [tuple(r) for r in got[1].runs] == [(1, 18, 3)] and got[1].n_words == 20
    assert got[2].collapsed == "plain words only" and got[2].runs == []


def test_query_equals_the_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    small = [(d.doc_id, d.text) for d in docs if len(d.text or "") < 9000]
    got = {r[0]: tuple(r) for r in QUERIES["op13_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in small:
        assert got[doc_id] == row(doc_id, text)
    assert sum(r[1] > 0 for r in got.values()) >= 5
