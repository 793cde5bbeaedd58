"""Operator 12: phrase collocations from vertical positional inverted lists.

Index: documents are cut into blocks of about ``BLOCK_WORDS`` words. Words in a piece have
consecutive positions, pieces are at least one position apart. A block and language is one row:
its distinct words, their numbers, the length of each word's list, and the lists of positions, one after the other. The
index is written once to the shared folder, so texts are read once and a lost executor costs a
re-read of its rows.

Numbers: a word's number is a hash of its language and text. While words are counted all of them are looked at, and
should two share a number, all are numbered anew by another hash. So numbers stand for words exactly, phrases
are rows of numbers, and no texts are built, compared or shuffled until the frequent phrases are known.

Extension: a phrase's list holds the positions of its last word. Merge-joining the list with the
postings of the adjacent words gives the lists of the phrases longer by a word; the length of a list is
the phrase's frequency in its block, and the sum over blocks its exact frequency. A longer phrase
is as rare as its rarest part, so only phrases whose two parts without the first and the last word are frequent
everywhere are extended. Rows of counts are at most as many as words, for each length.

Which phrases are frequent everywhere is known after a sum over blocks, and goes back to the tasks as a
Bloom filter of ``FILTER_BITS`` bits a phrase and at most ``MOST_FILTER_BITS`` bits in all, so what is
broadcast is bounded. Beyond that size more rare phrases pass and are counted in vain; since every
count is exact and compared with ``least`` afterwards, results never depend on the filter.

Defined results: a null text is empty, a null language is ``und`` (joined with rows that say so);
repeated rows count as often as they come; other columns are ignored; an empty table gives no rows.
Texts are worked on whole; a text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import prepare, shared_path

LEAST_COUNT = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
#: A phrase goes when a longer one has at least this share of its occurrences, in per cent.
COVERED = 80
BLOCK_WORDS = 1 << 20
#: Phrases whose counts a task hands on at once.
ROWS_AT_ONCE = 1 << 15
#: Bits of the words' numbers at first, and of those of another hash where two words shared one.
BUCKET_BITS = 64
MOST_BUCKET_BITS = 64
FILTER_BITS = 24
MOST_FILTER_BITS = 1 << 30
#: Bits of a bitmap of Spark's ``bitmap_construct_agg``.
BITMAP_BITS = 1 << 15

#: Letters A-Z in lower case, all separators of pieces as line ends, tabs as spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_BREAK = b""


class _Numbers(dict):
    """Numbers words in the order in which they come; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, with an empty word after each piece that has any."""
    out: list[bytes] = []
    for piece in text.translate(_TABLE).split(b"\n"):
        if words := list(filter(None, piece.split(b" "))):
            out += words
            out.append(_BREAK)
    return out


def index(df: DataFrame, text_column: str = "text", lang_column: str = "lang", bits: int = BUCKET_BITS, seed: int = 42) -> DataFrame:
    """(lang, words, ids, counts, positions): the positional inverted lists of the blocks."""
    prepare(df.sparkSession)

    def lists(lang: str, numbers: _Numbers, ids: list[np.ndarray]) -> pa.RecordBatch:
        sequence = np.concatenate(ids)
        counts = np.bincount(sequence, minlength=len(numbers))[1:]
        places = np.argsort(sequence, kind="stable").astype("<i4")[len(sequence) - int(counts.sum()) :]
        words = [w.decode() for w in list(numbers)[1:]]
        own = (_hashes(lang, words, seed) >> np.uint64(64 - bits)).view(np.int64)
        columns = [[lang], [words], [own], [counts.astype(np.int32)], [places.tobytes()]]
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "words", "ids", "counts", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens(text.as_py())
                if not found:
                    continue
                numbers, ids = blocks.setdefault(lang, (_Numbers(), []))
                ids.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= BLOCK_WORDS:
                    yield from (lists(lang, *block) for lang, block in blocks.items())
                    blocks, size = {}, 0
        yield from (lists(lang, *block) for lang, block in blocks.items())

    rows = df.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("__text"))
    return rows.mapInArrow(run, "lang string, words array<string>, ids array<long>, counts array<int>, positions binary")


def _hashes(lang: str, phrases: list[str], seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64(lang, phrase)``, for its seed of 42."""
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang, seed)
    return np.fromiter((xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))


def _hashed_longs(numbers: np.ndarray, seed: np.ndarray | np.uint64 = np.uint64(42)) -> np.ndarray:
    """Spark's ``xxhash64`` of longs; with the hashes of the columns before as the seed, that of several columns. The constants are fixed by the published hash."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = (seed + (np.uint64(8) + five)) ^ turned(numbers.astype(np.uint64) * two, 31) * one
    h = turned(h, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


class Filter:
    """A Bloom filter of hashes, built by Spark's bitmap aggregates."""

    PROBES = 4

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def of(cls, rows: DataFrame, *columns: str) -> Filter:
        """The filter of some columns of a relation; its size follows the number of rows up to the bound."""
        wanted = max(BITMAP_BITS, FILTER_BITS * rows.count())
        mask = min(MOST_FILTER_BITS, 1 << (wanted - 1).bit_length()) - 1
        hashed = rows.select(F.xxhash64(*columns).alias("h"))
        low, step = F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)
        bit = hashed.select(F.explode(F.array(*[(low + step * i).bitwiseAND(mask) + 1 for i in range(cls.PROBES)])).alias("bit"))
        maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
        bits = np.zeros((mask + 1) // 8, np.uint8)
        for row in maps.toLocalIterator():
            part = np.frombuffer(row["map"], np.uint8)
            at = (row["part"] - 1) * (BITMAP_BITS // 8)
            bits[at : at + len(part)] = part
        return cls(bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be in the filter; those in it always are."""
        mask = np.uint64(len(self.bits) * 8 - 1)
        low, step = h & mask, (h >> np.uint64(32)) & mask
        out = np.ones(len(h), bool)
        for i in range(self.PROBES):
            place = (low + step * np.uint64(i)) & mask
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def extended(ends: np.ndarray, hashes: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the phrases longer by a word, as (ends, hashes of all their words).

    ``ends`` are the sorted positions of last words and ``hashes`` those of the phrases there; ``ids`` are the words'
    numbers and ``at`` says which of them a position has. A place is kept when a phrase ends there and
    another of the same length ends at the next position.
    """
    meets = np.flatnonzero(ends[1:] == ends[:-1] + 1)
    after = ends[meets + 1]
    return after, _hashed_longs(ids[at[after]], hashes[meets])


def longer_counts(lists: DataFrame, filters: list[Filter]) -> DataFrame:
    """The counts, by block, of the phrases one word longer than the last filter's: (w1, w2, ..., n)."""
    size = len(filters) + 1
    names = [f"w{n}" for n in range(1, size + 1)]
    shared = lists.sparkSession.sparkContext.broadcast([f.bits for f in filters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Filter(bits) for bits in shared.value]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values.to_numpy()
                counts = batch.column(1)[row].values.to_numpy()
                posted = np.frombuffer(batch.column(2)[row].as_py(), "<i4")
                spelled = _hashed_longs(ids)
                often = np.repeat(known[0].holds(spelled), counts)
                at = np.full(int(posted.max(initial=-1)) + 1, -1, np.int32)
                at[posted[often]] = np.repeat(np.arange(len(ids), dtype=np.int32), counts)[often]
                ends = np.flatnonzero(at >= 0)
                hashes = spelled[at[ends]]
                for level in known[1:]:
                    ends, hashes = extended(ends, hashes, at, ids)
                    keep = np.flatnonzero(level.holds(hashes))
                    ends, hashes = ends[keep], hashes[keep]
                ends, hashes = extended(ends, hashes, at, ids)
                ends = ends[np.argsort(hashes)]
                words = [ids[at[ends - back]] for back in range(size - 1, -1, -1)]
                other = np.ones(len(ends), bool)  # unlike the one before; the rows of one phrase need not meet, as they are summed up later
                other[1:] = reduce(np.logical_or, [w[1:] != w[:-1] for w in words])
                first = np.flatnonzero(other)
                columns = [*(w[first] for w in words), np.diff(first, append=len(ends))]
                for start in range(0, len(first), ROWS_AT_ONCE):
                    yield pa.RecordBatch.from_arrays([pa.array(c[start : start + ROWS_AT_ONCE], pa.int64()) for c in columns], names=[*names, "n"])

    return lists.select("ids", "counts", "positions").mapInArrow(run, ", ".join(f"{name} long" for name in (*names, "n")))


def _summed(counts: DataFrame, *by: str) -> DataFrame:
    """Sums of counts. They are sums of a block already, so few rows of a task are alike: they are summed after the shuffle alone."""
    return counts.repartition(*by).groupBy(*by).agg(F.sum("n").alias("f"))


def _counted_words(spark: SparkSession, df: DataFrame, path: str, least: int) -> tuple[DataFrame, DataFrame]:
    """The index, and (id, lang, phrase, f) of its frequent words; no two words of the index share an id."""
    for turn in count():
        index(df, bits=MOST_BUCKET_BITS if turn else BUCKET_BITS, seed=42 + turn).write.parquet(f"{path}/index-{turn}")
        lists = spark.read.parquet(f"{path}/index-{turn}")
        words = lists.select("lang", F.explode(F.arrays_zip("words", "ids", "counts")).alias("w"))
        words = words.select(F.col("w.ids").alias("id"), "lang", F.col("w.words").alias("phrase"), F.col("w.counts").cast("long").alias("n"))
        summed = words.repartition("id").groupBy("id", "lang", "phrase").agg(F.sum("n").alias("f"))
        alike = summed.withColumn("alike", F.count("*").over(Window.partitionBy("id")))
        alike.filter((F.col("f") >= least) | (F.col("alike") > 1)).write.parquet(f"{path}/words-{turn}")
        found = spark.read.parquet(f"{path}/words-{turn}")
        if found.filter("alike > 1").isEmpty():
            return lists, found.drop("alike")


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, size, f) of (ids, f)."""
    parts = phrases.select("ids", "f", F.posexplode("ids").alias("place", "id")).join(words.select("id", "lang", "phrase"), "id")
    found = parts.groupBy("ids", "f").agg(F.array_sort(F.collect_list(F.struct("place", "lang", "phrase"))).alias("parts"))
    return found.select(F.expr("parts[0].lang").alias("lang"), F.expr("array_join(parts.phrase, ' ')").alias("phrase"), F.size("ids").alias("size"), "f")


def frequent(spark: SparkSession, df: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases with at least ``least`` occurrences, and (lang, n) of all words."""
    path = shared_path(spark, "phrases")
    lists, words = _counted_words(spark, df, path, least)
    totals = lists.select("lang", F.expr("aggregate(counts, 0L, (s, c) -> s + c)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    filters = [Filter.of(words, "id")]
    parts = []
    for size in range(2, longest + 1):
        names = [f"w{n}" for n in range(1, size + 1)]
        where = f"{path}/frequent-{size}"
        _summed(longer_counts(lists, filters), *names).filter(F.col("f") >= least).write.parquet(where)
        found = spark.read.parquet(where)
        parts.append(found.select(F.array(*names).alias("ids"), "f"))
        if size < longest:
            filters.append(Filter.of(found, *names))
    sized = words.select("lang", "phrase", F.lit(1).alias("size"), "f")
    if parts:
        sized = sized.unionByName(_spelled(reduce(DataFrame.unionByName, parts), words))
    sized.write.parquet(f"{path}/frequent")
    return spark.read.parquet(f"{path}/frequent"), totals


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The best phrases of each language, from ``frequent``: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the lowest of its cuts in two, SCALE * a / (l + r) in whole numbers of up to
    38 digits. Phrases mostly found within a longer one are left out.
    """
    candidates = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(words, cut + 1, size - cut), ' ')").alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(38,0)) * {SCALE} div (cast(l as decimal(38,0)) + r)").alias("score")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "cut", "l", "r")).alias("best"))
    spans = "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), s -> array_join(slice(words, s, n), ' '))))"
    within = candidates.filter("size > 2").select("lang", F.explode(F.expr(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = best.join(within, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * {covered}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = alone.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score")).withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
