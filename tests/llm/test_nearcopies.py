"""The near_duplicates stage of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import string

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import nearcopies, simhash


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows, least=0.8):
    """Ids that are the least of those reachable by pairs of a similarity of ``least`` or more."""
    sets = {i: slow_shingles(t) for i, t in rows}
    own = {i: i for i in sets}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    ids, n = sorted(sets), 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= least * len(x | y):
                n += 1
                p, q = sorted((root(a), root(b)))
                own[q] = p
    return {i for i in ids if root(i) == i}, n


def made_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=5))
    texts = []
    for n in range(30):
        base = [word() for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(60 if n == 0 else 4):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
    chain = [word() for _ in range(200)]
    for n in range(12):
        chain = [*chain[:n * 15], word(), *chain[n * 15 + 1 :]]
        texts.append(" ".join(chain))
    texts += ["", " ", "one two", "One  TWO", "one"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_finds_every_near_copy(spark):
    rows = made_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*rows, (None, rows[0][1])]], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want, pairs = slow_kept(rows)
    assert pairs > 500 and len(want) < len(rows) - 60
    assert sorted(got, key=repr) == sorted(want, key=repr)  # the row without an id is a copy


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == slow_kept(rows)[0]


def test_a_bucket_gives_a_forest_of_its_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - 9 * n], rng.integers(0, 1 << 63, 9 * n, np.uint64)])) for n in range(20)] + [np.unique(rng.integers(0, 1 << 63, 400, np.uint64)) for _ in range(100)]
    prints = np.array([nearcopies.wide_fingerprint(s) for s in sets])
    kind, none = np.arange(120), np.zeros(120, np.int64)
    linked = {(x, y) for x in range(120) for y in range(x) if nearcopies.similarity(sets[x], sets[y]) >= 0.8}
    got = nearcopies.bucket_links(none, kind, none, prints, sets)
    assert {tuple(sorted(p, reverse=True)) for p in got} <= linked
    forest = simhash.Forest(120)
    forest.link(*np.array(got).T)
    whole = simhash.Forest(120)
    whole.link(*np.array(sorted(linked)).T)
    assert forest.root.tolist() == whole.root.tolist() and len(got) == 120 - len(set(whole.root.tolist()))
    given = (kind % 3 == 0).astype(np.int64)
    assert all(given[x] and not given[y] for x, y in nearcopies.bucket_links(none, kind, given, prints, sets))


def test_fingerprints_keep_what_is_similar():
    rng = np.random.default_rng(8)
    for size in (5, 9, 12, 30, 200, 3000):
        for _ in range(200 if size < 200 else 10):
            one = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            drop = int(rng.integers(0, max(1, size // 9) + 1))
            two = np.unique(np.concatenate([one[drop:], rng.integers(0, 1 << 63, drop, np.uint64)]))
            if nearcopies.similarity(one, two) >= 0.8:
                assert np.bitwise_count(nearcopies.wide_fingerprint(one) ^ nearcopies.wide_fingerprint(two)).sum() <= nearcopies.RADIUS


def test_wide_distances():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (130, 4), np.uint64)
    for row in range(1, 130):  # from equal to far away
        bits = rng.choice(256, min(256, 2 * row), replace=False)
        base[row] = base[0]
        for bit in bits:
            base[row, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    planes, blocks = simhash.wide_planes(base), np.arange(3)
    lanes = np.array([0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF, 3], np.uint64)
    for radius in (0, 3, 67, 127, 200):
        hits = simhash.within_wide(planes, blocks, np.repeat(base[:1], 3, axis=0), lanes, radius)
        got = np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little")).tolist()
        assert got == [row for row in range(130) if np.bitwise_count(base[row] ^ base[0]).sum() <= radius]


@pytest.mark.parametrize("hot", [1 << 16, 8])
def test_hot_buckets_in_chunks_lose_no_link(spark, hot):
    rows = made_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in nearcopies.classes(docs, hot=hot).collect():
        got.setdefault(r["class"], []).append(r["id"])
    assert {min(ids) for ids in got.values()} == slow_kept(rows)[0]


def test_rows_with_one_id_and_two_texts(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "quite another text of a few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {rows[0], rows[2]}


def test_awkward_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "x " * 60_000), (5, "x  " * 60_000), (6, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"key": F.lit(1), "class": F.lit(2), "th": F.lit(3), "bucket": F.lit(4)})
    got = sorted(((r["doc_id"], (r["text"] or "")[:9]) for r in nearcopies.deduplicate(docs).collect()), key=repr)
    assert got == sorted([(1, text[:9]), (2, ""), (4, "x x x x x")], key=repr)
    assert nearcopies.deduplicate(docs).columns == docs.columns and nearcopies.deduplicate(docs.limit(0)).count() == 0


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    text = " ".join(f"w{n}" for n in range(60))
    rows = [(1, text, "b"), (1, text, "a"), (1, text + " more", "a"), (2, text, "a"), (None, text, "a"), (None, text, "a"), (None, "another text with no id at all", "a"), (None, "another text with no id at all", "a"), (7, "a third one alone here now", "z")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in nearcopies.deduplicate(docs).collect()]
    assert sorted((r[0] for r in got), key=repr) == [1, 7, None]
    again = [tuple(r) for r in nearcopies.deduplicate(docs.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
