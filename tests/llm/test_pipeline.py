"""The corpus pipeline from end to end against plain Python, stage by stage, awkward rows included."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import langid, pii, tokens
from test_nearcopies import slow_kept

AWKWARD = [
    (9000, None, None, None), (9001, "", "en", "a"), (9002, " \t\n 12 34", None, "a"), (9003, "word", "en", None), (9003, "word", "en", None), (9004, "mail me at a@b.co <|endoftext|> now", None, "b"),
    (9005, "the longest of all " * 9000, "en", "b"), (None, "no id here, but a text", "en", None), (9006, "mail me at a@b.co <|endoftext|> now", "en", "c"), (9007, "a text with a clash of ids", "en", "c"), (9007, "quite another text of that id", "en", "c"),
]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    extra = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra).withColumns({"fp": F.lit(1), "class": F.lit("x"), "mix_slot": F.lit(2)})
    rows.write.parquet(f"{path}/documents.parquet")
    return path


def test_every_document_arrives_whole(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    model = langid.fit(spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.DOCUMENT_COLUMNS))
    lettered = [(i, t) for i, t in docs if langid.has_letter(t)]
    scores, _, _ = langid.label_batch(model, [t.encode() for _, t in lettered])
    spoken = [row for row, p in zip(lettered, scores, strict=True) if p.max() >= corpus_pipeline.LEAST_SCORE]
    assert len(spoken) > 0.95 * len(docs)
    numbered = list(enumerate(sorted(set(spoken), key=lambda row: (row[0] is None, row[0] or 0, row[1]))))
    kept, _ = slow_kept([(n, t) for n, (_, t) in numbered])  # the least place is the least id; rows alike are one
    survivors = [row for n, row in numbered if n in kept]
    from tokenizers import Tokenizer

    plain, want = Tokenizer.from_file(tokens.default_path()), Counter()
    for doc_id, text in survivors:
        ids = np.array([*plain.encode(pii.redact_text(text, pii.find_spans(text)), add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if piece == 0 else start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    assert not {9000, 9001, 9002, 9006} & {r["doc_id"] for r in got} and sum(r["doc_id"] == 9007 and r["piece"] == 0 for r in got) == 2
    assert sum(r["doc_id"] == 9003 and r["piece"] == 0 for r in got) == 1
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 2048 for parts in placed.values())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_no_rows_and_keep_the_columns(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.DOCUMENT_COLUMNS)
    stage = dict(corpus_pipeline.STAGES)[name]
    none = stage(spark, docs.limit(0), folder)
    assert none.count() == 0
    if name != "packing":
        assert none.columns == docs.columns and stage(spark, docs.limit(40), folder).schema.simpleString() == docs.schema.simpleString()


def test_screen_drops_what_has_no_language(spark):
    rows = [(1, "the and of", None), (2, None, "en"), (3, "123 !", "en"), (4, "", None), (None, "der die das", None), (1, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train([("the and of to in " * 9, "en"), ("der die das und ist " * 9, "de")])
    got = sorted(((r["doc_id"], r["lang"]) for r in langid.screen(docs, model, 0.0).collect()), key=repr)
    assert [i for i, _ in got] == [1, 1, None] and all(lang in ("en", "de") for _, lang in got)
    assert langid.screen(docs, None, 0.0).count() == 0


def test_fast_inference_equals_the_traced_pass():
    model = langid.new_model(["a", "b"], 4)
    texts = [b"one text of more than one segment", b"xy", "é中".encode()]
    fast, votes, _ = langid.label_batch(model, texts, segment=8)
    for text, p, vote in zip(texts, fast, votes, strict=True):
        total, weight, counts = np.zeros(2), 0.0, np.zeros(2, int)
        for at in range(0, len(text), 8):
            codes = np.frombuffer(text[at : at + 8], np.uint8)[:, None]
            ahead, back = model.forward.trace(codes)[0][1:], model.reverse.trace(codes[::-1])[0][:0:-1]
            logits = np.einsum("lh,thb->tl", model.out, np.concatenate([ahead, back], axis=1)) + model.bias
            own = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
            letters = langid.LETTER_BYTE[codes[:, 0]]
            total, weight, counts = total + (own * letters[:, None]).sum(axis=0), weight + letters.sum(), counts + np.bincount(own.argmax(axis=1), minlength=2)
        assert p == pytest.approx(total / weight, abs=1e-4) and vote.tolist() == counts.tolist()
