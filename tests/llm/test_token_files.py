"""Token counts of flat files: documents over many blocks and parts, files read by ranges."""

from __future__ import annotations

import numpy as np
import pytest

from lodestrata.llm import tokencounts


@pytest.mark.parametrize(("block", "scan"), [(1, 1), (2, 2), (3, 4), (7, 2), (1000, 4096)])
def test_blocks_and_parts_are_stitched(spark, tmp_path, monkeypatch, block, scan):
    monkeypatch.setattr(tokencounts, "SCAN_BLOCKS", scan)
    rng = np.random.default_rng(block)
    want = []
    for name in "abc":
        lengths = rng.choice([0, 0, 1, 2, 5, 40], 30)
        ids = np.concatenate([np.append(rng.integers(0, 9, n), 9) for n in lengths] + [rng.integers(0, 9, 3)]).astype("<u2")
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        want += [(name, n, int(x)) for n, x in enumerate(lengths)]
    (tmp_path / "empty.bin").write_bytes(b"")
    counts = tokencounts.count(tokencounts.read_flat_files(spark, str(tmp_path), block_tokens=block), end_id=9)
    assert sorted((r["file"][-5], r["ordinal"], r["n_tokens"]) for r in counts.collect()) == want
