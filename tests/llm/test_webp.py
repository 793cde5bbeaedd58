"""Operator 10: how a media column's images are written and read, and that their bytes stay as they were."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest

from lodestrata.llm import webp


def payloads():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("etaoinshrdlucmfwypvbgkjqxz", k=rnd.randrange(1, 9))) for _ in range(300)]
    texts = ["", "q" * 500, "ab" * 300, " ".join(rnd.choices(words, k=400)), ("A line that stands here again and again.\n" * 3 + "Another.\n") * 40]
    texts += ["".join(map(chr, rnd.choices(range(1, 3000), k=2000))), bytes(rnd.choices(range(0, 128), [2.0**-k for k in range(128)], k=9000)).decode()]
    return [raw.ljust(max(webp.ROW, -(-len(raw) // webp.ROW) * webp.ROW)) for raw in (t.encode() for t in texts)]


def test_bytes_of_media_stay_as_they_were():
    media = [webp.encode_payload(p) for p in payloads()]
    assert [webp.decode_payload(m).tobytes() for m in media] == payloads()
    assert sha256(b"".join(media)).hexdigest() == "838225df939065200247b7d5e629e6eef859214093bca76d7ee4698a49f5cd12"


def test_a_text_costs_few_single_fields(monkeypatch):
    """A palette's colours have one code of one sequence of steps; all else of a text's image goes through arrays."""
    calls = {"put": 0, "peek": 0}

    def counted(owner, name):
        plain = getattr(owner, name)

        def run(self, *args):
            calls[name] += 1
            return plain(self, *args)

        monkeypatch.setattr(owner, name, run)

    counted(webp.BitWriter, "put")
    counted(webp.BitReader, "peek")
    payload = payloads()[3]
    levels = len(set(payload))
    media = webp.encode_payload(payload)
    assert webp.decode_payload(media).tobytes() == payload
    assert levels > 20 and calls["put"] < levels + 120 and calls["peek"] < 60


@pytest.mark.parametrize("seed", range(3))
def test_fields_of_all_widths_lie_one_after_another(seed):
    rng = np.random.default_rng(seed)
    widths = rng.integers(0, 19, 500)
    values = rng.integers(0, 1 << 18, 500) & ((1 << widths) - 1)
    out, want, size = webp.BitWriter(), 0, 0
    for start in range(0, 500, 100):
        out.put(5, 3)
        out.many(values[start : start + 100], widths[start : start + 100])
        out.many(values[:0], widths[:0])
        for value, width in ((5, 3), *zip(values[start : start + 100].tolist(), widths[start : start + 100].tolist(), strict=True)):
            want |= value << size
            size += width
    assert out.finish() == want.to_bytes(-(-size // 8), "little")
