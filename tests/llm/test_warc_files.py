"""Archives: rows with equal ids and different payloads, reading by the index, files of their own and of other writers."""

from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import warc

BODY = "<p>" + "é" * 60


def test_equal_ids_with_different_payloads_keep_both(spark):
    own = "<p>" + "own text " * 20
    rows = [(3, "a", BODY), (5, "b", BODY), (5, "c", own), (5, "b", BODY), (7, "d", own), (None, "e", own)]
    stored = warc.bundles(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()
    got = sorted((tuple(r) for r in warc.read_bundles(stored).collect()), key=repr)
    sizes = {t: (len(t.encode()), sha256(t.encode()).hexdigest()) for t in (BODY, own)}
    want = [(3, *sizes[BODY], "response", None), (5, *sizes[BODY], "revisit", 3), (5, *sizes[own], "response", None), (5, *sizes[BODY], "revisit", 3), (7, *sizes[own], "revisit", 5), (None, *sizes[own], "response", None)]
    assert got == sorted(want, key=repr)


def test_reading_uses_the_index(spark):
    rows = [(n, "u", f"{n} " * 200) for n in range(50)]
    stored = warc.bundles(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), frame_bytes=2000)
    some = stored.withColumn("index", F.expr("filter(index, e -> cast(e.id as int) % 7 = 0)"))
    assert sorted(r["page_id"] for r in warc.read_bundles(some).collect()) == list(range(0, 50, 7))
    wrong = stored.withColumn("index", F.expr("transform(index, e -> struct('x' as id, e.frame, e.offset, e.length))"))
    with pytest.raises(Exception, match="does not point at"):
        warc.read_bundles(wrong).collect()


def test_files_of_their_own_come_back(spark, tmp_path):
    rows = [(n, f"http://x/a {n}", f"{n} <p>text</p> " * (1 + 40_000 * (n == 5))) for n in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    saved = warc.save_files(warc.bundles(pages, frame_bytes=500, bundle_bytes=500), str(tmp_path / "out")).collect()
    assert len(saved) > 1 and {r["path"] for r in saved} == {str(p) for p in (tmp_path / "out").iterdir()}
    got = warc.read_files(spark, str(tmp_path / "out")).collect()
    assert {(r["record_id"], r["block"].partition(b"\r\n\r\n")[2].decode(), r["url"]) for r in got} == {(f"<urn:page:{n}>", html, url.replace(" ", "%20")) for n, url, html in rows}


def test_files_of_another_writer(spark, tmp_path):
    import zstandard

    records = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", warc.record("response", "2", "u", b"x" * 300_000, "d", None)]
    (tmp_path / "one.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(b"".join(records)))
    got = warc.read_files(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["record_type"], len(r["block"].partition(b"\r\n\r\n")[2])) for r in got] == [("warcinfo", 0), ("response", 300_000)]
