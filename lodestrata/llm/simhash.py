"""Operator 7: SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

A fingerprint has a bit set if over half of the document's shingle hashes have it. Two documents
link when their fingerprints differ in at most three of 64 bits. The work is done on distinct
fingerprints, so exact copies cost one row.

Candidates: the 64 bits are cut into five blocks; fingerprints within three bits agree on at least
two of them, so ten tables of two blocks each bring every linked pair together in some bucket. A
bucket of more than ``HOT_BUCKET`` fingerprints is split again: its members agree on two blocks, so
the other bits are cut into four parts of which a linked pair agrees on at least one. That goes on
until no bucket is hot or its members agree on ``SPLIT_BITS`` bits, which bounds a bucket by the
distinct fingerprints of the bits left open (2^18). No bucket is capped.

Comparison: a bucket's fingerprints are stored vertically in blocks of 64, one word a bit plane. A
fingerprint meets a block plane by plane; carry-save counters hold all 64 distances at once, and a
(fingerprint, block) pair is abandoned when every lane is beyond the radius. Each bucket emits a
spanning forest of its links, never its pairs, and components follow by alternating star rounds.

Defined results: a null text, like one without words, has fingerprint zero and links like any
other. A null id has a null component and takes no part in links. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import checkpoint, prepare

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
HOT_BUCKET = 4096
SPLIT_BITS = 46
#: Shingles whose bits are unpacked at once, and (fingerprint, block) pairs compared at once.
SHINGLES_AT_ONCE = 1 << 15
PAIRS_AT_ONCE = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros(64, np.int64)
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    for at in range(0, len(spans), SHINGLES_AT_ONCE):
        part = spans[at : at + SHINGLES_AT_ONCE]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in part), "<u8", len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text) for text in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=[id_column, "fp"])

    rows = df.select(id_column, F.col(text_column).cast("binary").alias("__text"))
    return rows.mapInArrow(run, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, fp long")


class Forest:
    """Disjoint sets of 0..n-1 by arrays; every set's root is its least member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, blocks): word b of plane j has bit j of the 64 fingerprints of row b."""
    planes = np.empty((64, len(prints)), np.uint64)
    for j in range(64):
        bits = ((prints >> np.uint64(j)) & _ONE).astype(np.uint8)
        planes[j] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def within(planes: np.ndarray, blocks: np.ndarray, prints: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (fingerprint, block) the lanes of ``lanes`` at most ``radius`` (up to 3) bits away."""
    hits = np.zeros(len(blocks), np.uint64)
    alive = np.arange(len(blocks))
    ones = np.zeros(len(blocks), np.uint64)
    twos, over = ones.copy(), ones.copy()
    for j in range(64):
        differ = planes[j][blocks] ^ (np.uint64(0) - ((prints >> np.uint64(j)) & _ONE))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if j % 8 == 7:
            keep = np.flatnonzero((over & lanes) != lanes)
            if len(keep) < 0.75 * len(alive):  # abandon blocks whose lanes are all beyond the radius
                alive, blocks, prints, lanes, ones, twos, over = (x[keep] for x in (alive, blocks, prints, lanes, ones, twos, over))
    if radius < 3:
        over |= {0: ones | twos, 1: twos, 2: ones & twos}[radius]
    hits[alive] = ~over & lanes
    return hits


def wide_planes(prints: np.ndarray) -> np.ndarray:
    """(64 * words, blocks) of fingerprints (rows, words): 64 rows in a row are a block, the last one padded with zeros."""
    rows, words = prints.shape
    padded = np.zeros((-(-rows // 64), 64, words), np.uint64)
    padded.reshape(-1, words)[:rows] = prints
    return np.concatenate([bit_planes(padded[:, :, w]) for w in range(words)])


def within_wide(planes: np.ndarray, blocks: np.ndarray, prints: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """``within`` for fingerprints (rows, words) of several words and any radius.

    Eight planes at a time go through a tree of carry-save adders into ones, twos and fours, and
    what is carried out of them into counters of eights. The counters start at 2^n - 1 - radius, so
    a lane is beyond the radius when a carry leaves the highest of them.
    """
    hits, alive = np.zeros(len(blocks), np.uint64), np.arange(len(blocks))
    size = max(4, radius.bit_length())
    start = [np.full(len(blocks), _ALL if ((1 << size) - 1 - radius) >> bit & 1 else 0, np.uint64) for bit in range(size)]
    ones, twos, fours, eights = *start[:3], start[3:]
    over = np.zeros(len(blocks), np.uint64)

    def add(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x ^ y
        return half ^ z, (x & y) | (half & z)

    for at in range(0, len(planes), 8):
        d = [planes[j][blocks] ^ (np.uint64(0) - ((prints[:, j // 64] >> np.uint64(j % 64)) & _ONE)) for j in range(at, at + 8)]
        carried = []
        for a, b in ((d[0], d[1]), (d[2], d[3]), (d[4], d[5]), (d[6], d[7])):
            ones, carry = add(ones, a, b)
            carried.append(carry)
        twos, four_a = add(twos, carried[0], carried[1])
        twos, four_b = add(twos, carried[2], carried[3])
        fours, carry = add(fours, four_a, four_b)
        for bit in range(len(eights)):
            eights[bit], carry = eights[bit] ^ carry, eights[bit] & carry
        over |= carry
        keep = np.flatnonzero((over & lanes) != lanes)
        if len(keep) < 0.75 * len(alive):  # abandon blocks whose lanes are all beyond the radius
            alive, blocks, prints, lanes, ones, twos, fours, over = (x[keep] for x in (alive, blocks, prints, lanes, ones, twos, fours, over))
            eights = [x[keep] for x in eights]
    hits[alive] = ~over & lanes
    return hits


def bucket_links(buckets: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows sorted by bucket: for each row the least row that it is connected to inside its bucket."""
    n = len(buckets)
    first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    sizes = np.diff(np.concatenate([first, [n]]))
    forest = Forest(n)
    words = -(-sizes // 64)
    word0 = np.cumsum(words) - words
    bucket = np.repeat(np.arange(len(first)), sizes)
    place = np.arange(n) - first[bucket]
    own = word0[bucket] + place // 64
    padded = np.zeros((int(words.sum()), 64), np.uint64)
    row_of = np.full(padded.shape, -1, np.int64)
    padded[own, place % 64], row_of[own, place % 64] = prints, np.arange(n)
    planes = bit_planes(padded)
    valid = np.packbits(row_of >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
    ahead = words[bucket] - place // 64  # own block and those after it: each pair is met once
    done = np.cumsum(ahead)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        rows = np.repeat(np.arange(at, stop), ahead[at:stop])
        step = np.arange(len(rows)) - np.repeat(np.cumsum(ahead[at:stop]) - ahead[at:stop], ahead[at:stop])
        blocks = own[rows] + step
        after = _ALL << (place[rows] % 64).astype(np.uint64) << _ONE
        lanes = np.where(step == 0, after, _ALL) & valid[blocks]
        hits = within(planes, blocks, prints[rows], lanes, radius)
        while len(live := np.flatnonzero(hits)):
            lowest = hits[live] & (~hits[live] + _ONE)
            lane = np.bitwise_count(lowest - _ONE)
            forest.link(rows[live], row_of[blocks[live], lane])
            hits[live] &= hits[live] - _ONE
        at = stop
    return forest.root


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal runs of ``bits``."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def table_masks(radius: int = RADIUS) -> list[int]:
    """Masks of the tables."""
    parts = _blocks(list(range(64)), radius + 2)
    return [a | b for i, a in enumerate(parts) for b in parts[i + 1 :]]


def split_masks(agreed: list[int], radius: int = RADIUS) -> list[list[int]]:
    """For each mask of agreed bits the masks of which a linked pair agrees on at least one more."""
    return [_blocks([b for b in range(64) if not mask >> b & 1], radius + 1) for mask in agreed]


def bucketed(prints: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """(bucket, fp, rep): every linked pair meets in some bucket. Hot buckets are split until none is, or ``SPLIT_BITS`` bits agree."""
    from pyspark.sql import Window

    agreed = table_masks(radius)

    def key(number: Column, mask: Column) -> Column:
        return F.xxhash64(number, F.col("fp").bitwiseAND(mask))  # equal keys by chance only add comparisons

    first = F.array(*[F.struct(F.lit(t).alias("t"), key(F.lit(t), F.lit(_signed(m)).cast("long")).alias("bucket")) for t, m in enumerate(agreed)])
    rows, parts = prints.select("fp", "rep", F.explode(first).alias("k")).select("fp", "rep", "k.t", "k.bucket"), []
    while True:
        rows = checkpoint(rows.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1"))
        crowded = rows.filter(F.col("n") > hot)
        if bin(agreed[0]).count("1") >= SPLIT_BITS or crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.filter(F.col("n") <= hot))
        splits = split_masks(agreed, radius)
        masks = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in s]) for s in splits])
        again = F.posexplode(F.transform(F.get(masks, F.col("t")), lambda mask: key(F.col("bucket"), mask))).alias("part", "b")
        rows = crowded.select("fp", "rep", "t", "bucket", again).select("fp", "rep", (F.col("t") * (radius + 1) + F.col("part")).alias("t"), F.col("b").alias("bucket"))
        agreed = [mask | more for mask, own in zip(agreed, splits, strict=True) for more in own]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("bucket", "fp", "rep")


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT_BUCKET) -> DataFrame:
    """From distinct (fp, rep) a forest (a, b) of rep pairs, a > b, that connects what links connect."""
    rows = bucketed(prints, radius, hot).repartition("bucket").sortWithinPartitions("bucket", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def found(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            least = rep[bucket_links(bucket, fp.view(np.uint64), radius)] if len(rep) else rep
            joined = np.flatnonzero(least != rep)
            return pa.RecordBatch.from_arrays([pa.array(rep[joined]), pa.array(least[joined])], names=["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if whole >= 1 << 14:
                yield found(*(h[:whole] for h in held))
                held = [h[whole:] for h in held]
        yield found(*held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge, by large and small star rounds."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs if not large else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        met = both.join(least.select("a", F.least("a", "m").alias("m")), "a")
        if large:
            out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a > b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    pairs = checkpoint(edges.filter("a > b").distinct())
    before = state(pairs)
    while before[0]:
        pairs = checkpoint(star(star(pairs, True), False))
        after = state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) for every row. The id has to be a whole number."""
    prints = checkpoint(fingerprints(df, id_column, text_column))
    distinct = prints.groupBy("fp").agg(F.min(F.col(id_column).cast("long")).alias("rep")).filter("rep is not null")
    mapped = components(links(distinct, radius))
    classes = distinct.join(mapped, distinct["rep"] == mapped["node"], "left")
    classes = classes.select("fp", F.coalesce("component", "rep").alias("component"))
    joined = prints.join(classes, "fp", "left")
    return joined.select(id_column, "fp", F.when(F.col(id_column).isNotNull(), F.col("component")).alias("component"))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``near_duplicates``."""
    return found.select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
