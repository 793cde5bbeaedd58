"""Every training-data operator against a brute-force version, and on awkward rows."""

from __future__ import annotations

import re
import zlib
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import entries, html, langid, mixing, packing, pii, quality, simhash, tokencounts, tokens, warc, webp

SPACES = " \t\n\x0b\x0c\r"
AWKWARD = [
    (1000, None, None, None), (1001, "", "en", "a"), (1002, " \t\n", None, "a"), (1003, "word", "en", None), (1003, "word", "en", None), (1004, "a  b\n\n\tc　d <|endoftext|> é\x01x", "xx", "b"),
    (1005, "x " * 30_000, "en", "b"), (None, "no id here", None, None), (None, None, None, None), (1006, "😀 " * 60 + "\n" + "same line\nsame line", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    """The smallest documents, awkward rows, and columns whose names clash with the operators' own."""
    extra = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    own = {"spans": F.lit("x"), "score": F.lit(1), "fp": F.lit(2), "w": F.lit(3), "mix_slot": F.lit(4), "words": F.lit(5), "h": F.lit(6), "fingerprint": F.lit("7"), "media": F.lit(8), "t": F.lit(9), "s": F.lit(1), "n": F.lit(2)}
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra).withColumns(own).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1: personal data ---------------------------------------------------------------------------


def base_spans(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            else:
                ok = {"email": True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_pii_base_spans(docs, rows):
    got = table(pii.digest(pii.find_pii(docs)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for doc_id, text in rows:
        spans = base_spans(text)
        count = [sum(s[0] == kind for s in spans) for kind in pii.BASE_KINDS]
        want.append((doc_id, *count, sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(sum(w[1:5]) for w in want) > 20


@pytest.mark.parametrize("text", ["a@b.c@d.e f", "a@b@c.d", "x@-.-", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 234 567 89 +1.2", "4111 1111-1111 1111", "41111111111111111111", "é a.b+c@d-e.f😀g@h.i", "@", "+12345678901234567"])
def test_pii_hard_cases(text):
    assert [s[:3] for s in pii.find_spans(text) if s[4]] == base_spans(text)


def test_pii_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda text: {s[0] for s in pii.find_spans(text)}
    assert "iban" in kinds("account DE89 3704 0044 0532 0130 00") and "iban" not in kinds("account DE88 3704 0044 0532 0130 00")
    assert "national_id" in kinds("her SSN 123-45-6789") and "national_id" not in kinds("part 123-45-6789")


def test_pii_redaction(docs, spark):
    clean = pii.redact(spark.createDataFrame([(1, "mail a@b.co now"), (2, None)], "doc_id int, text string"))
    assert table(clean, "doc_id", "text") == [(1, "mail [EMAIL] now"), (2, None)]
    assert all(not base_spans(r["text"]) for r in pii.redact(docs.select("doc_id", "text")).collect())


# --- 2 and 9: tokens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_path())
    plain.encode_special_tokens = True
    return [np.array(plain.encode(t or "", add_special_tokens=False).ids, np.uint32) for _, t in rows]


def test_cached_tokens_equal_the_tokenizers(rows, ids):
    odd = ["a  b", " a", "a ", "\n", "a\n b", "a \nb", "x\n\ny", "don't 123 4,5", "é　ü", "\x01a b", "a\x1cb c", "a\x85b", "  ", "it's  \n ok"]
    encoder = tokens.PieceTokenizer(tokens.default_path())
    whole = [np.array(encoder.whole.encode(t, add_special_tokens=False).ids) for t in odd]
    for got, want in zip(encoder.encode([t for _, t in rows] + odd), ids + whole, strict=True):
        assert got.tolist() == want.tolist()


def test_packing(docs, rows, ids):
    got = packing.pack(docs.coalesce(2)).collect()
    want = []
    for (doc_id, _), own in zip(rows, ids, strict=True):
        own = np.append(own, 0).astype("<u4")
        first = len(own) % 2048 or 2048
        for piece, start in enumerate([0, *range(first, len(own), 2048)]):
            part = own[start : first if piece == 0 else start + 2048]
            want.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(parts)) and sum(n for _, n in parts) <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 2048) + 4


def test_packing_closes_the_fullest_first():
    packer = packing.BestFit(10, 2)
    placed = [packer.place(n) for n in (6, 5, 9, 4, 5)]
    assert placed == [(0, 0), (1, 0), (2, 0), (0, 6), (1, 5)]  # the bin of nine closes at once, being the fullest
    assert packer.count == 0 and packer.bits == 0


def test_token_counts(docs, rows, ids):
    written = tokencounts.write_blocks(docs.coalesce(2), block_tokens=64, blocks_of_file=8).cache()
    got = tokencounts.named(tokencounts.count(written.filter("data is not null")), written)
    assert table(got, "doc_id", "n_tokens") == sorted(((i, len(own)) for (i, _), own in zip(rows, ids, strict=True)), key=repr)


def test_flat_files_of_any_origin(spark, tmp_path):
    data = np.array([1, 2, 9, 9, 3, 4, 5, 6, 9, 7], "<u2")
    (tmp_path / "a.bin").write_bytes(data.tobytes())
    counts = tokencounts.count(tokencounts.read_flat_files(spark, str(tmp_path), block_tokens=3), end_id=9)
    assert table(counts, "ordinal", "n_tokens") == [(0, 2), (1, 0), (2, 4)]


# --- 3: language --------------------------------------------------------------------------------


def test_language(docs, rows):
    model = langid.fit(docs, windows=1500)
    got = langid.digest(langid.identify(docs, model))
    found = {r["doc_id"]: r for r in got.collect()}
    for doc_id, text in rows:
        r = found[doc_id]
        assert r["held_out"] == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if doc_id is not None:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    test = docs.join(got.filter("held_out").select("doc_id", F.col("lang_pred").alias("p")), "doc_id").filter("lang is not null and doc_id < 1000").select("lang", "p").collect()
    assert sum(r["lang"] == r["p"] for r in test) >= 0.9 * len(test) > 10
    blind = langid.digest(langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model))
    assert table(blind, "doc_id", "lang_pred") == table(got, "doc_id", "lang_pred")


def test_language_learns_nothing_from_held_out_rows(docs):
    turned = docs.withColumn("lang", F.when(langid.is_held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = langid.fit(docs, windows=200), langid.fit(turned, windows=200)
    assert a.languages == b.languages and all((x == y).all() for x, y in zip(langid.parameters(a), langid.parameters(b), strict=True))


def test_backpropagation_gives_the_slope_of_the_loss():
    model = langid.new_model(["a", "b", "c"], 4)
    rng = np.random.default_rng(3)
    codes, labels = rng.integers(97, 104, (9, 5)), rng.integers(0, 3, 5)
    for p in langid.parameters(model):
        p[...] = p.astype(np.float32)
    _, grads = langid.loss_and_gradients(model, codes, labels)
    for values, grad in zip(langid.parameters(model), grads, strict=True):
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = values[spot], 1e-2
        values[spot] = kept + step
        up, _ = langid.loss_and_gradients(model, codes, labels)
        values[spot] = kept - step
        down, _ = langid.loss_and_gradients(model, codes, labels)
        values[spot] = kept
        assert (up - down) / (2 * step) == pytest.approx(grad[spot], rel=0.05, abs=1e-4)


def test_every_place_gets_a_label(docs):
    model = langid.fit(docs, windows=200)
    texts = [b"one text of several segments " * 20, b"x"]
    _, votes, places = langid.label_batch(model, texts, segment=32, places=True)
    assert [len(p) for p in places] == [len(t) for t in texts]
    assert all(np.bincount(p, minlength=len(model.languages)).tolist() == v.tolist() for p, v in zip(places, votes, strict=True))


# --- 4: pages -----------------------------------------------------------------------------------


def test_best_region_is_the_highest_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-5, 6, rng.integers(1, 12)).astype(float).tolist()
        a, b = html.best_region(scores)
        assert sum(scores[a:b]) == max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_html_main_text():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top</header><nav><a href=/>Home</a> <a href=/x>More</a></nav>
    <div class="cookie-notice">We use cookies on this site</div><div id="sidebar">Side words here</div>%s<form>Write <input> to us</form><div class="comments"><p>First! what a text</p></div><footer>&copy; us</footer></body></html>"""
    body = "<h1>A &amp; B</h1><p>One\n  two <b>three</b>four&nbsp;five.<div class='ad'>Buy now</div><p>Six &#x4e2d;&#25991; seven eight nine ten.</p>"
    want = "A & B One two threefour five. Six 中文 seven eight nine ten."
    for wrapped in (f"<article>{body}</article>", f"<div id=content>{body}</div>", f"<main>{body}</main>"):
        assert html.main_text(page % wrapped, html.DEFAULT_WEIGHTS) == want
    assert [html.main_text(p, html.DEFAULT_WEIGHTS) for p in (None, "", "<p></p>", "plain words", "a < b and c > d")] == ["", "", "", "plain words", "a < b and c > d"]


def test_html_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame([(9000, None, None), (None, "u", ""), (9001, "u", "<div>" * 5000 + "deep")], "page_id long, url string, html string"))
    weights = html.fit(pages)
    assert all(weights[k] < 0 for k in weights if k[0] != "#") and weights[html.WORD] > 0
    got = {r["page_id"]: r for r in html.extract(pages, weights).collect()}
    assert len(got) == pages.count() and got[9000]["text"] == "" and got[9001]["text"] == "deep" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    for r in pages.filter("html like '%<article>%'").collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        plain = " ".join(html.references.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", re.sub(r"(?s)<!--.*?-->|<(aside|div|form|script|style|nav)\b.*?</\1>", " ", inside)))).split())
        assert got[r["page_id"]]["text"] == plain
    assert html.fit(pages.limit(0)) == html.DEFAULT_WEIGHTS


# --- 5: mixing ----------------------------------------------------------------------------------


def test_frames_deviate_by_less_than_a_block():
    for weights in ({"a": 5.0, "b": 3.0, "c": 1.0}, {"a": 1.0}, {f"s{n}": n + 1.0 for n in range(40)}):
        quota = mixing.quotas(weights, 400)
        slots, frame = mixing.frame_slots(quota), sum(quota.values())
        assert sorted(x for s in slots.values() for x in s) == list(range(frame))
        for source, own in slots.items():
            for n, slot in enumerate(own):
                release, deadline = mixing.window(n, quota[source], frame)
                assert release <= slot < deadline
            done = np.searchsorted(own, np.arange(frame + 1))
            assert (np.abs(done - np.arange(frame + 1) * quota[source] / frame) < 1).all()


def test_mixing_keeps_every_row(docs, rows, none):
    mixed = mixing.mix(docs, block_units=2000)
    assert table(mixed, "doc_id", "text") == sorted(rows, key=repr)
    placed = mixed.select(F.coalesce("source", F.lit("")).alias("source"), "mix_block", "mix_slot", "mix_release", "mix_deadline").distinct().collect()
    assert len({r["mix_slot"] for r in placed}) == len(placed)  # a slot holds one block of one source
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in placed)
    order = [(r["mix_slot"], r["mix_order"]) for r in mixing.ordered(mixed).collect()]
    assert order == sorted(order)
    assert mixing.mix(none).count() == 0


def test_mixing_follows_given_weights(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 3, "a").otherwise("b").alias("source"), F.lit("x" * 100).alias("text"))
    order = [r["source"] for r in mixing.ordered(mixing.mix(many, {"a": 1.0, "b": 1.0}, block_units=1000, frame=20)).collect()]
    assert abs(sum(s == "a" for s in order[:1500]) - 750) < 100


# --- 6: quality ---------------------------------------------------------------------------------


def counted(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACES}]", text) if w]
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {}
    for w in windows:
        many[w] = many.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(docs, rows):
    judged = quality.digest(quality.judge(docs, []))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert table(judged, *columns) == sorted(((i, *counted(t)) for i, t in rows), key=repr)
    assert judged.filter("kept = base_failed").count() == 0


def test_quality_rules(spark, sf):
    # at sf0.01 there are 27 bad rows beyond the base rule, and no rule is precise on a third of them; that is too few to learn from
    df = entries.op6_quality(spark, sf.replace("sf0.001", "sf0.1"))
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/labels.parquet")
    got = df.join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, False), 0) >= 0.8 * sum(v for (q, _), v in n.items() if q == 0)
    assert quality.learn(df.limit(0).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[F.lit(0).alias(c) for c in ("n_lines", "n_capitals", "n_exclaims", "n_distinct", "quality", "fold")])) == []


# --- 7: near duplicates -------------------------------------------------------------------------


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(f"[{SPACES}]", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Least id reachable; ``prints`` is a list of (id, fingerprint)."""
    own = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if own[b] < own[a] and (x ^ y).bit_count() <= 3:
                    own[a], changed = own[b], True
    return own


def test_simhash(docs, rows):
    got = simhash.digest(simhash.near_duplicates(docs)).collect()
    prints = {text: slow_fingerprint(text) for _, text in rows}
    assert sorted(((r["doc_id"], r["fingerprint"]) for r in got), key=repr) == sorted(((i, f"{prints[t]:016x}") for i, t in rows), key=repr)
    own = slow_components(sorted({(i, prints[t]) for i, t in rows if i is not None}))
    assert all(r["component_id"] == (own[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)


@pytest.mark.parametrize("hot", [4096, 4])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)}
    signed = [(n, p - (1 << 64) if p >> 63 else p) for n, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "rep long, fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, hot=hot)).collect()}
    want = slow_components([(n, p) for n, p in enumerate(sorted(prints))])
    assert all(got.get(n, n) == c for n, c in want.items())


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 1 << 63, 64, dtype=np.uint64)
    asked = np.array([int(block[k]) ^ sum(1 << int(b) for b in rng.choice(64, k % 6, replace=False)) for k in range(40)], np.uint64)
    planes = simhash.bit_planes(block[None, :])
    everything = np.full(len(asked), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for radius in range(4):
        hits = simhash.within(planes, np.zeros(len(asked), np.int64), asked, everything, radius)
        for a, hit in zip(asked.tolist(), hits.tolist(), strict=True):
            assert hit == sum(1 << lane for lane, b in enumerate(block.tolist()) if (a ^ b).bit_count() <= radius)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(n + 1, n) for n in range(200)] + [(500, 400)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {**{n: 0 for n in range(201)}, 400: 400, 500: 400}


# --- 8: archives --------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    body = "<p>" + "é" * 60
    rows = [(5, "u5", body), (3, "u 3\n", body), (4, None, "x" * 99), (6, "u6", "x" * 99), (7, "u7", None), (None, "n", body), (8, "u8", ""), (9, "u9", body + "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("digest", F.lit("x"))
    got = {r["page_id"]: tuple(r[1:]) for r in warc.read_bundles(warc.bundles(pages, frame_bytes=200)).collect()}
    assert len(got) == 8
    for page_id, _, text in rows:
        raw = (text or "").encode()
        revisit = page_id == 5
        assert got[page_id] == (len(raw), sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
    assert warc.read_bundles(warc.bundles(pages.limit(0))).count() == 0


def test_warc_index_finds_single_records(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html_of = {str(r["page_id"]): (r["html"] or "").encode() for r in pages.collect()}
    seen = 0
    for bundle in warc.bundles(pages.coalesce(1), frame_bytes=20_000).collect():
        assert len(warc.seek_table(bundle["content"])) > 1
        for entry in bundle["index"]:
            head, block = warc.read_record(bundle["content"], entry["frame"], entry["offset"])
            assert head["WARC-Record-ID"] == f"<urn:page:{entry['id']}>"
            assert head["WARC-Type"] == "revisit" or block.partition(b"\r\n\r\n")[2] == html_of[entry["id"]]
            seen += 1
    assert seen == len(html_of)


def test_frames_are_plain_zstandard():
    import io

    import zstandard

    writer = warc.BundleWriter(frame_bytes=50)
    records = [warc.record("response", str(n), "u", b"payload %d" % n, "d", None) for n in range(9)]
    for n, r in enumerate(records):
        writer.add(str(n), r)
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(writer.finish()), read_across_frames=True) as stream:
        assert stream.read() == b"".join(records)


# --- 10: media ----------------------------------------------------------------------------------


def test_media(docs, rows):
    stored = webp.to_media(docs).cache()
    got = webp.from_media(stored).collect()
    want = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        want.append((doc_id, len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    media = {(r["n_bytes"], r["media"]) for r in stored.collect()}
    assert {(r["n_bytes"], r["media_bytes"], r["media_sha256"]) for r in got} == {(n, len(m), sha256(m).hexdigest()) for n, m in media}
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})


def test_long_media_become_several_images():
    payload = bytes(range(192)) * (webp.MOST_ROWS + 3)
    assert webp.decode_payload(webp.encode_payload(payload)).tobytes() == payload


@pytest.mark.parametrize("seed", range(4))
def test_images_come_back(seed):
    rng = np.random.default_rng(seed)
    shape = (int(rng.integers(1, 30)), int(rng.integers(1, 40)))
    noise = rng.integers(0, 1 << 32, shape, dtype=np.uint64).astype(np.uint32)
    smooth = (np.add.outer(np.arange(shape[0]), np.arange(shape[1])).astype(np.uint32) * np.uint32(0x010203)) | np.uint32(0xFF000000)
    few = noise.ravel()[:5][rng.integers(0, min(5, noise.size), shape)]
    blocks = (-(-shape[0] // 4), -(-shape[1] // 4))
    modes = rng.integers(0, 14, blocks).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    cross = rng.integers(0, 1 << 24, blocks).astype(np.uint32) | np.uint32(0xFF000000)
    for image in (noise, smooth, few):
        for options in ({}, {"predictor": modes}, {"cross": cross}, {"subtract_green": True}, {"predictor": modes, "cross": cross, "subtract_green": True}, {"cache_bits": 5}, {"copies": True}, {"copies": True, "cache_bits": 3}):
            assert (webp.decode(webp.encode_argb(image, **options)) == image).all()
    for options in ({"palette": True}, {"palette": True, "copies": True}):
        assert (webp.decode(webp.encode_argb(few, **options)) == few).all()


def test_code_lengths_are_complete_and_bounded():
    for counts in ([1], [0, 3], [1, 1], [1 << n for n in range(30)], [5, 0, 2, 9, 1]):
        lengths = webp.code_lengths(counts)
        used = [x for x in lengths if x]
        assert max(used, default=0) <= webp.MAX_CODE and (len(used) < 2 or sum(2.0**-x for x in used) == 1)


# --- empty tables -------------------------------------------------------------------------------


def test_empty_tables(none):
    assert pii.digest(pii.find_pii(none)).count() == 0
    assert pii.redact(none.select("doc_id", "text")).count() == 0
    assert packing.pack(none).count() == 0
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert quality.judge(none, quality.fit(none, none.select("doc_id", F.lit(1).alias("quality")))).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert webp.from_media(webp.to_media(none)).count() == 0
    written = tokencounts.write_blocks(none)
    assert tokencounts.named(tokencounts.count(written.filter("data is not null")), written).count() == 0
