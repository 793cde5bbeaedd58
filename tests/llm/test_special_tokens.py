"""Strings of special tokens in texts: special for packing, ordinary for counting tokens of flat files."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodestrata.llm import entries, tokencounts, tokens

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z\n<|endoftext|>", "plain words", "a <|endoftext| > b"]


def fresh(ordinary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    if ordinary:
        plain.encode_special_tokens = True
    return [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]


@pytest.mark.parametrize("ordinary", [False, True])
def test_both_readings_equal_a_fresh_tokenizer(ordinary):
    assert [ids.tolist() for ids in tokens.tokenizer(tokens.default_path(), ordinary).encode(TEXTS)] == fresh(ordinary)
    assert fresh(False)[0] == [64, 220, 50256, 275]


def test_a_small_tokenizer_holds_few_pieces():
    from tokenizers import Tokenizer

    small, plain = tokens.tokenizer(tokens.default_path(), False, small=True), Tokenizer.from_file(tokens.default_path())
    texts = [" ".join(f"w{n * 500 + i}" for i in range(500)) for n in range(400)] + [None, "", "a  b", "<|endoftext|> x"]
    got = [ids for at in range(0, len(texts), 101) for ids in small.encode(texts[at : at + 101])]
    assert [ids.tolist() for ids in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(small.numbers) <= tokens.FEW_PIECES + 500 * tokens.FEW_TEXTS and all(ids.base is None for ids in got)


def test_packing_reads_special_tokens_and_counting_does_not(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in entries.op2_packing(spark, str(tmp_path)).collect()}
    assert got == {n: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for n, ids in enumerate(fresh(False))}
    written = tokencounts.write_blocks(docs).cache()
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencounts.named(tokencounts.count(written.filter("data is not null")), written).collect()}
    assert counts == {n: len(ids) for n, ids in enumerate(fresh(True))}
