"""Near copies among whole texts: operator 7 over five-word shingles, every link confirmed exactly.

Two texts link when their sets of five-word shingles (lowered as in ``simhash``) have a Jaccard
similarity of ``LEAST`` or more. The work is done on distinct sets, so exact copies cost one row.

Buckets: texts meet in buckets of the least of their shingles' hashes: 24 keys of four minima. A pair
of similarity s has no bucket in common with probability (1 - s^4)^24, which is 3 in a million at 0.8
and less above. (At the radius of 0.8 no blocks of a fingerprint's own bits can be cut.) Of buckets
that hold the same sets one is kept.

Fingerprints: SimHash of 1024 bits. Two sets at 0.8 differ in at most 165 bits on average, with a
deviation of 12; ``RADIUS`` lies 4.7 deviations above, so the comparison misses about one in a
million. Sets of fewer than ``SMALL_SET`` shingles, to which that does not apply, are let through.

Comparison is bit-sliced (``simhash.within_wide``) and made twice. First every bucket's most connected
member, the one that meets most others, is compared with all others, and each set's nearest pivot is
confirmed by the exact similarity of the two texts: one pair a set, which connects copies with what
they are copies of. Then, in buckets that are still of several components, the members outside of the
largest are compared with all others, nearest first, and the exact similarity of the sets decides
inside the task; only links between components leave it, so a bucket costs rows in proportion to its
members. No candidate is dropped. Buckets of more than ``HOT_BUCKET`` members or ``HOT_SHINGLES``
shingles are dealt to several tasks, each with the pivots or a part of the members outside.

Defined results: texts without words have the empty set and are copies of each other. Of each group
one row stays: the least by id (null ids last), then by hashes of the text and of the other columns; of
rows alike in all columns any one. Rows of equal ids whose texts are no copies are different rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import checkpoint, prepare, shared_path
from lodestrata.llm.simhash import SEED, components, wide_planes, within_wide

WORDS = 5
LEAST = 0.8
FINGERPRINT_WORDS = 16
RADIUS = 220
SMALL_SET = 5
BANDS, MINIMA = 24, 4
HOT_BUCKET, HOT_SHINGLES = 1 << 14, 1 << 22
#: Shingles multiplied by all factors at once, (fingerprint, block) pairs compared at once, and words whose hashes a worker keeps.
SHINGLES_AT_ONCE = 1 << 10
PAIRS_AT_ONCE = 1 << 13
CACHED_WORDS = 1 << 19
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA + FINGERPRINT_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_LEAST_FACTORS, _BIT_FACTORS = _FACTORS[: BANDS * MINIMA, None], _FACTORS[None, BANDS * MINIMA :]
_WORD_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """A hash of every word met so far; it starts anew beyond ``CACHED_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = number = xxh64_intdigest(word, SEED)
        return number


_hashes = _WordHashes()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; a shorter text is one shingle."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(own))
    mixed = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        mixed ^= own[k : len(own) - size + 1 + k]
        mixed *= _WORD_FACTOR
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def key_of(own: np.ndarray) -> int:
    """A signed number of a set."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def bands(own: np.ndarray) -> list[int]:
    """The set's bucket in each band; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(own):
        return []
    least = np.full(len(_LEAST_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), SHINGLES_AT_ONCE):
        np.minimum(least, (own[at : at + SHINGLES_AT_ONCE] * _LEAST_FACTORS).min(axis=1), out=least)
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """The words of the set's SimHash: a bit is set if over half of the shingles have it."""
    counts = np.zeros(64 * FINGERPRINT_WORDS, np.int64)
    for at in range(0, len(own), SHINGLES_AT_ONCE):
        mixed = own[at : at + SHINGLES_AT_ONCE, None] * _BIT_FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= _BIT_FACTORS
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 of empty ones."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return shared / (len(one) + len(two) - shared)


def _keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), _rest_hash(df, id_column, text_column).alias("rh"), F.col(text_column).cast("binary").alias("text"))


def _rest_hash(df: DataFrame, id_column: str, text_column: str) -> Column:
    """A hash of the columns that are neither id nor text."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_column, text_column)]
    return F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")


def signed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, rh, key, n, bands) of every row; th is a hash of the text as it stands, rh one of the other columns, n the size of its set."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text) for text in batch.column(3).to_pylist()]
            made = [pa.array(map(key_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["id", "th", "rh", "key", "n", "bands"])

    rows = _keyed(df, id_column, text_column)
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, th long, rh long, key long, n long, bands array<long>")


def _described(texts: DataFrame, sets: bool) -> DataFrame:
    """(key, n, print) of (key, text), and ``own``, the set itself, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text) for text in batch.column(1).to_pylist()]
            made = [batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([wide_fingerprint(x).tobytes() for x in found], pa.binary())]
            if sets:
                made.append(pa.array([x.tobytes() for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(made, names=["key", "n", "print", "own"][: len(made)])

    return texts.select("key", "text").mapInArrow(run, "key long, n long, print binary" + ", own binary" * sets)


def compared(first: np.ndarray, last: np.ndarray, pivots: np.ndarray, prints: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot row, other row, bits between them) of pivots whose fingerprint is near that of a row in [first, last), and whose sizes allow the similarity."""
    planes = wide_planes(prints)
    small = np.packbits(np.pad(sizes < SMALL_SET, (0, -len(sizes) % 64)).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    many = np.where(last > first, (last - 1) // 64 - first // 64 + 1, 0)
    at = np.repeat(np.arange(len(pivots)), many)
    blocks = np.repeat(first // 64, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    low, high = np.maximum(first[at] - blocks * 64, 0), np.minimum(last[at] - blocks * 64, 64)
    lanes = (full << low.astype(np.uint64)) & (full >> (64 - high).astype(np.uint64))
    found = [(np.empty(0, np.int64),) * 3]
    for n in range(0, len(at), PAIRS_AT_ONCE):
        own, block, lane = pivots[at[n : n + PAIRS_AT_ONCE]], blocks[n : n + PAIRS_AT_ONCE], lanes[n : n + PAIRS_AT_ONCE]
        hits = within_wide(planes, block, prints[own], lane, RADIUS)
        hits |= lane & np.where(sizes[own] < SMALL_SET, full, small[block])
        which, spot = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = own[which], block[which] * 64 + spot
        fit = (a != b) & (np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]) - 1e-9)
        a, b = a[fit], b[fit]
        bits = np.concatenate([np.bitwise_count(prints[a[k : k + 4096]] ^ prints[b[k : k + 4096]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), 4096)] or [np.empty(0, np.int64)])
        found.append((a, b, bits))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def star_pairs(bucket: np.ndarray, score: np.ndarray, given: np.ndarray, sizes: np.ndarray, prints: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by bucket: (row, pivot, bits between them) of rows near their bucket's pivot, the given one or that of the highest score."""
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.append(begin[1:], len(bucket))
    order = np.lexsort((-score, -given, bucket))  # the pivot first
    pivots = order[begin]
    pivot, other, bits = compared(begin, end, pivots, prints, sizes, least)
    plain = given[other] == 0
    return other[plain], pivot[plain], bits[plain]


def bucket_links(part: np.ndarray, kind: np.ndarray, given: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Of rows sorted by bucket (``part``): links that connect, bucket by bucket, all the classes that links connect, a forest over them.

    If a bucket has given rows, they are compared with its others; else the rows outside of the largest class with all.
    """
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0, [True]]))
    chosen = []
    for at, to in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if given[at:to].any():
            chosen.append(at + np.flatnonzero(given[at:to]))
        else:
            _, of, many = np.unique(kind[at:to], return_inverse=True, return_counts=True)
            chosen.append(at + np.flatnonzero(of != many.argmax()))
    pivots = np.concatenate(chosen)
    place = np.searchsorted(cuts, pivots, "right") - 1
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    a, b, bits = compared(cuts[place], cuts[place + 1], pivots, prints, sizes, least)
    apart = np.flatnonzero((kind[a] != kind[b]) & (given[b] == 0))
    order = apart[np.lexsort((bits[apart], part[a[apart]]))]  # by bucket, nearest first
    root: dict[int, int] = {}
    out, seen, now = [], set(), None

    def top(n: int) -> int:
        while (up := root.setdefault(n, n)) != n:
            root[n] = n = root[up]
        return n

    for x, y, bucket, p, q in zip(a[order].tolist(), b[order].tolist(), part[a[order]].tolist(), kind[a[order]].tolist(), kind[b[order]].tolist(), strict=True):
        if bucket != now:
            now = bucket
            root.clear()
            seen.clear()
        p, q = top(p), top(q)
        if p != q and (y, x) not in seen:
            seen.add((x, y))
            if similarity(sets[x], sets[y]) >= least - 1e-9:
                root[p] = q
                out.append((x, y))
    return out


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int, columns: list[str], shingles_at: int | None = None) -> Iterator[dict[str, np.ndarray | list]]:
    """Rows sorted by bucket, i and j in pieces of whole groups, as columns and ``part``, which numbers the groups."""
    held: list[pa.RecordBatch] = []

    def piece(table: pa.Table) -> dict[str, np.ndarray | list]:
        out = {c: table.column(c).combine_chunks().to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in columns}
        new = (np.diff(out["bucket"], prepend=out["bucket"][:1]) != 0) | (np.diff(out["i"], prepend=out["i"][:1]) != 0) | (np.diff(out["j"], prepend=out["j"][:1]) != 0)
        return {**out, "part": np.cumsum(new)}

    def last(table: pa.Table) -> int:
        """Where the last group begins."""
        at = np.ones(table.num_rows, bool)
        for c in ("bucket", "i", "j"):
            values = table.column(c).to_numpy()
            at &= values == values[-1]
        return int(np.flatnonzero(at)[0])

    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows or (shingles_at and held and sum(b.nbytes for b in held) >= shingles_at * 8):
            table = pa.Table.from_batches(held)
            if whole := last(table):
                yield piece(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
                count = sum(b.num_rows for b in held)
    if held:
        yield piece(pa.Table.from_batches(held))


def _stars(rows: DataFrame, least: float) -> DataFrame:
    """From (bucket, i, j, key, given, score, n, print) the pairs (a, b, bits, score) of keys and pivots near them."""
    names = ["bucket", "i", "j", "key", "given", "score", "n", "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _whole_groups(batches, 1 << 14, names):
            prints = np.frombuffer(b"".join(p["print"]), np.uint64).reshape(-1, FINGERPRINT_WORDS)
            row, pivot, bits = star_pairs(p["part"], p["score"], p["given"], p["n"], prints, least)
            yield pa.RecordBatch.from_arrays([pa.array(p["key"][row]), pa.array(p["key"][pivot]), pa.array(bits), pa.array(p["score"][pivot])], names=["a", "b", "bits", "score"])

    rows = rows.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")
    return rows.mapInArrow(run, "a long, b long, bits long, score long").filter("a <> b")


def _rest(rows: DataFrame, least: float) -> DataFrame:
    """From (bucket, i, j, key, given, class, print, own) the links (a, b) between classes."""
    names = ["bucket", "i", "j", "key", "given", "class", "print", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _whole_groups(batches, 1 << 12, names, HOT_SHINGLES):
            prints = np.frombuffer(b"".join(p["print"]), np.uint64).reshape(-1, FINGERPRINT_WORDS)
            sets = [np.frombuffer(x, np.uint64) for x in p["own"]]
            pairs = [(p["key"][x], p["key"][y]) for x, y in bucket_links(p["part"], p["class"], p["given"], prints, sets, least)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    rows = rows.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")
    return rows.mapInArrow(run, "a long, b long")


def _sized(rows: DataFrame, hot: int) -> DataFrame:
    """(bucket, chunks) of the buckets that are too large for one task."""
    chunks = F.ceil(F.greatest(F.count("*") / hot, F.sum("n") / HOT_SHINGLES)).cast("long")
    return checkpoint(rows.groupBy("bucket").agg(chunks.alias("chunks")).filter("chunks > 1"))


def _dealt(rows: DataFrame, sizes: DataFrame, stars: bool) -> DataFrame:
    """Rows with ``i``, ``j`` and ``given``. A bucket is one group; a large one is chunks of members (j), each with all its pivots.

    The pivots are the best-scored member, or all members outside of the largest class, in chunks of their own (i).
    """
    none = F.lit(0).cast("long")
    plain = rows.withColumns({"i": none, "j": none, "given": none})
    if sizes.isEmpty():
        return plain
    crowded = rows.join(sizes, "bucket")
    spot = F.pmod(F.xxhash64("key"), F.col("chunks"))
    if stars:
        row = F.struct(*[c for c in crowded.columns if c != "bucket"])
        pivots = crowded.groupBy("bucket").agg(F.max_by(row, F.struct("score", "key")).alias("r")).select("bucket", "r.*").withColumn("i", none)
    else:
        top = crowded.groupBy("bucket", "class").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("class", F.struct("c", "class")).alias("top"))
        pivots = crowded.join(top, "bucket").filter("class <> top").drop("top").withColumn("i", spot)
    cells = pivots.groupBy("bucket").agg(F.collect_set("i").alias("cells"))
    members = crowded.join(cells, "bucket").withColumn("i", F.explode("cells")).drop("cells").withColumn("j", spot).withColumn("given", none)
    pivots = pivots.withColumn("j", F.explode(F.sequence(none, F.col("chunks") - 1))).withColumn("given", F.lit(1).cast("long"))
    return plain.join(sizes.select("bucket"), "bucket", "left_anti").unionByName(members.drop("chunks")).unionByName(pivots.drop("chunks"))


def confirmed(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose texts' sets have a Jaccard similarity of ``least`` or more."""
    one, two = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, x, y in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True):
                if b != last:
                    last, own = b, shingles(y)
                keep.append(similarity(shingles(x), own) >= least - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST, hot: int = HOT_BUCKET) -> DataFrame:
    """(id, th, rh, key, class) of every row: the class is the least key reachable by links."""
    rows = checkpoint(signed(df, id_column, text_column))
    distinct = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    spots = distinct.select("key", "n", F.explode("bands").alias("bucket"))
    whole = spots.groupBy("bucket").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("m")).filter("c > 1")
    whole = whole.groupBy("c", "x", "m").agg(F.min("bucket").alias("bucket")).select("bucket", "c")  # one of those with the same members
    met = checkpoint(spots.join(whole, "bucket").select("bucket", "key", "n", "c"))
    texts = _texts(df, distinct.join(met.select("key").distinct(), "key").select("r.id", "r.th", "key"), id_column, text_column)

    scores = met.groupBy("key").agg(F.sum("c").alias("score"))
    known = checkpoint(_described(texts, False).join(scores, "key"))
    placed = met.select("bucket", "key").join(known, "key")
    near = _stars(_dealt(placed, _sized(met, hot), True), least)
    pairs = near.groupBy("a").agg(F.min_by("b", F.struct("bits", -F.col("score"), "b")).alias("b"))
    links = checkpoint(confirmed(pairs, texts, least).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    found = _connected(links)

    kind = F.coalesce("class", "key")
    told = met.select("bucket", "key", "n").join(found, "key", "left").withColumn("class", kind)
    open_ = told.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("bucket")
    left = checkpoint(told.join(open_, "bucket", "left_semi"))
    if not left.isEmpty():
        sets = _described(texts.join(left.select("key").distinct(), "key", "left_semi"), True).select("key", "print", "own")
        more = _rest(_dealt(left, _sized(left, hot), False).drop("n").join(sets, "key"), least)
        more = checkpoint(more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if not more.isEmpty():
            found = _connected(links.unionByName(more))
    return rows.select("id", "th", "rh", "key").join(found, "key", "left").select("id", "th", "rh", "key", kind.alias("class"))


def _texts(df: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(key, text) of the sets that meet others, one text each, written to the shared folder."""
    path = shared_path(df.sparkSession, "near-texts")
    wanted = wanted.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "key")
    _keyed(df, id_column, text_column).join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("key", "text").dropDuplicates(["key"]).write.parquet(path)
    return df.sparkSession.read.schema("key long, text binary").parquet(path)


def _connected(links: DataFrame) -> DataFrame:
    return checkpoint(components(links).select(F.col("node").alias("key"), F.col("component").alias("class")))


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each class of df: the least by id, nulls last, then by hashes of the text and of the rest."""
    rows = classes(df, id_column, text_column, least)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th", "rh")
    kept = rows.groupBy("class").agg(F.min(order).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = rows.join(kept, "class").groupBy("id", "th", "rh").agg(F.first(order.eqNullSafe(F.col("kept"))).alias("stays"), F.count("*").alias("n"))
    told = checkpoint(members.filter("not stays or n > 1").select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("rh").alias("__rh"), "stays"))
    own = (F.xxhash64(text_column) == F.col("__th")) & (_rest_hash(df, id_column, text_column) == F.col("__rh")) & F.col(id_column).eqNullSafe(F.col("__id"))
    left = df.join(told.filter("not stays").drop("stays"), own, "left_anti")
    repeated = told.filter("stays").drop("stays")
    if repeated.isEmpty():
        return left
    alike = left.join(repeated, own).dropDuplicates(["__id", "__th", "__rh"]).select(*df.columns)
    return left.join(repeated, own, "left_anti").unionByName(alike)
