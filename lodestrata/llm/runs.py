"""Operator 13: all periodic runs of a document's words, by the LPF variant of Main's algorithm.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` words long, that
no neighbouring word extends. The documents of a batch are worked on together, as one sequence in
which no two documents share a word:

1. A document in which no ``least // 2`` words in a row come twice has no run and is done (all its
   longest previous factors are shorter).
2. Prefix doubling ranks all substrings of 1, 2, 4, ... words of the rest. The last order is the
   suffix array; the ranks of all levels give the LCP of its neighbours. A stack walk over both
   gives the longest-previous-factor array (LPF), which cuts the blocks of the LZ factorization.
3. Main's boundary extensions: a run that touches the border of the blocks u and v has a period
   below |u| + |v| and a period's length on one side of the border. All periods of all borders are
   extended to both sides at once, by the ranks. Extensions over ``least`` words are kept.
4. Runs strictly inside a block are copies: the block's earlier occurrence has them. Runs are put
   in buckets by start and copied forward, block by block.

Defined results: a null text, like one without words, has no run and the hash of nothing; a null id
stays null (and no word of it is moved by ``planted``); repeated rows give repeated rows; other
columns are ignored. Texts are worked on whole: a task holds about
``WORDS_AT_ONCE`` words, or one longer document, at four bytes a word and level.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import prepare

LEAST_WORDS = 12
#: Words of the documents that are ranked together, and pairs that are extended together.
WORDS_AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 20
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Levels:
    """Ranks of the substrings of 1, 2, 4, ... words of a sequence, and extensions by them. All
    substrings of the last level differ, so an extension takes the size of each level at most once.

    A rank is 1 and the number of smaller substrings, so only what still has equals is sorted for
    the next level. Documents share no words, so an extension never leaves its document: substrings
    that reach over a document's end differ from all others.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ends = ends
        self.levels = [self._refined(np.ones(len(ids), np.int32), np.arange(len(ids)), ids)]

    def double(self) -> bool:
        """Adds a level; False when all substrings of the last one differ."""
        last, step = self.levels[-1], 1 << (len(self.levels) - 1)
        equals = np.flatnonzero(np.bincount(last, minlength=len(last) + 1)[last] > 1)
        if not len(equals):
            return False
        after = equals + step
        second = np.where(after < len(last), last[np.minimum(after, len(last) - 1)], 0)
        self.levels.append(self._refined(last, equals, (last[equals].astype(np.int64) << 32) | second))
        return True

    @staticmethod
    def _refined(ranks: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The ranks with those of ``places``, which hold whole groups of equals, told apart by the keys."""
        out = ranks.copy()
        order = np.argsort(keys)
        keys, before = keys[order], ranks[places[order]]
        at = np.arange(len(order))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], before[1:] != before[:-1]]), at, 0))
        part = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), at, 0))
        out[places[order]] = before + (part - group)
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from the places a < b on; b may be at its document's end."""
        n = len(self.ends)
        at_a, at_b = a.copy(), b.copy()
        limit = self.ends[a]
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, size = self.levels[level], 1 << level
            fits = at_b + size <= limit
            same = fits & (ranks[at_a] == ranks[np.minimum(at_b, n - 1)])
            at_a += size * same
            at_b += size * same
        return at_b - b

    def backward(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Equal words before the places a < b, back to ``begin`` of the document."""
        at_a, at_b = a.copy(), b.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, size = self.levels[level], 1 << level
            fits = at_a - size >= begin
            same = fits & (ranks[np.maximum(at_a - size, 0)] == ranks[np.maximum(at_b - size, 0)])
            at_a -= size * same
            at_b -= size * same
        return b - at_b


def suspects(hashes: Sequence[np.ndarray], least: int = LEAST_WORDS) -> list[int]:
    """Documents, given as hashes of their words, in which ``least // 2`` words in a row come twice; all others have no run.

    A run of period q and L >= max(least, 2q) words holds L - q >= least / 2 words twice. Equal words
    have equal sums of hashes, so chance can add a document but never lose one.
    """
    half = max(1, least // 2)
    sizes = np.array([max(0, len(h) - half + 1) for h in hashes], np.int64)
    if not sizes.sum():
        return []
    sums = np.concatenate([h.view(np.uint64) for h in hashes if len(h) >= half])
    owner = np.repeat(np.arange(len(hashes), dtype=np.uint64), [len(h) if len(h) >= half else 0 for h in hashes])
    n = len(sums) - half + 1
    keys = owner[:n] * _SPREAD
    factor = np.uint64(1)
    for k in range(half):
        keys += sums[k : k + n] * factor
        factor = np.uint64(int(factor) * 0x9E3779B97F4A7C15 % (1 << 64))
    keys = keys[owner[:n] == owner[half - 1 :]]
    own = owner[:n][owner[:n] == owner[half - 1 :]]
    order = np.argsort(keys)
    twice = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(own[order[twice]]).astype(np.int64).tolist()


def longest_previous(levels: Levels) -> tuple[list[int], list[int]]:
    """LPF and the place of one such earlier factor, from the suffix array and LCP by a stack walk."""
    top = levels.levels[-1]
    n = len(top)
    order = np.empty(n, np.int64)
    order[top - 1] = np.arange(n)
    low, high = np.minimum(order[1:], order[:-1]), np.maximum(order[1:], order[:-1])
    shared = np.concatenate([levels.forward(low, high), [0]]) if n else np.zeros(1, np.int64)
    lpf, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = [(-1, 0)]  # (place, LCP with the entry below)
    for place, lcp in zip([*order.tolist(), -1], [0, *shared.tolist()], strict=True):
        at, with_below = stack[-1]
        while at > place:
            stack.pop()
            # neighbours with smaller places: the entry below and the one that comes
            below = stack[-1][0]
            if with_below >= lcp:
                lpf[at], source[at] = with_below, below
            else:
                lpf[at], source[at] = lcp, place
            if with_below < lcp:
                lcp = with_below
            at, with_below = stack[-1]
        if place >= 0:
            stack.append((place, lcp))
    return lpf, source


def factors(lpf: Sequence[int], begin: int, end: int) -> list[int]:
    """Starts of the LZ blocks of a document: the longest earlier factor, or one new word."""
    out, at = [], begin
    while at < end:
        out.append(at)
        at += lpf[at] or 1
    return out


def border_runs(levels: Levels, borders: np.ndarray, widths: np.ndarray, begins: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """(start, length, period) of all repetitions that touch a border with a period up to its width."""
    found = []
    ends_at = np.cumsum(widths)
    first = 0
    while first < len(borders):
        done = ends_at[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends_at, done + PAIRS_AT_ONCE, "right")))
        width = widths[first:last]
        begin = np.repeat(begins[first:last], width)
        border = np.repeat(borders[first:last], width)
        period = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + 1
        end = levels.ends[begin]
        for low, high in ((border, border + period), (border - period, border)):
            fits = np.flatnonzero((low >= begin) & (high <= end) & (low < end))
            a, b = low[fits], high[fits]
            left, right = levels.backward(a, b, begin[fits]), levels.forward(a, b)
            q = period[fits]
            keep = np.flatnonzero((left + right >= q) & (left + right + q >= least))
            found.append(np.stack([a[keep] - left[keep], left[keep] + right[keep] + q[keep], q[keep]], axis=1))
        first = last
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def copied(known: list[tuple[int, int, int]], blocks: list[tuple[int, int, int]], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """The runs of a document: those known, and their copies strictly inside later blocks.

    ``blocks`` holds (start, end, earlier place) in order. Copies made are copied again where a
    block's earlier occurrence reaches into it.
    """
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, length, period in known:
        buckets.setdefault(start, []).append((length, period))
    starts = sorted(buckets)
    for begin, end, earlier in blocks:
        if end - begin < least + 2 or earlier < 0:
            continue
        shift = begin - earlier
        at = bisect_right(starts, earlier)
        while at < len(starts) and starts[at] + shift < end:
            for length, period in buckets[starts[at]]:
                place = starts[at] + shift
                if place + length < end:
                    if place not in buckets:
                        buckets[place] = []
                        insort(starts, place)
                    if (length, period) not in buckets[place]:
                        buckets[place].append((length, period))
            at += 1
    return [(start, length, period) for start in starts for length, period in sorted(buckets[start], key=lambda run: run[1])]


def find_runs(documents: Sequence[np.ndarray], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each document, given as arrays of word numbers below 2^32, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    words, document = np.concatenate(documents).astype(np.int64), np.repeat(np.arange(len(documents)), sizes)
    starts = np.cumsum(sizes) - sizes
    levels = Levels((document << 32) | words, np.repeat(starts + sizes, sizes))  # no word is shared by two documents
    while levels.double():
        pass
    lpf, source = longest_previous(levels)
    blocks: list[list[tuple[int, int, int]]] = []
    borders, widths, begins = [], [], []
    for begin, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if not size:
            blocks.append([])
            continue
        cuts = [*factors(lpf, begin, begin + size), begin + size]
        blocks.append([(a, b, source[a] if lpf[a] else -1) for a, b in zip(cuts, cuts[1:], strict=False)])
        borders += cuts[1:]
        begins += repeat(begin, len(cuts) - 1)
        widths += [c - a - 1 for a, c in zip(cuts, cuts[2:], strict=False)] + [cuts[-1] - cuts[-2] - 1]
    border, width, begin_of = np.array(borders, np.int64), np.array(widths, np.int64), np.array(begins, np.int64)
    # a run ends within the next block and begins less than a period before the last one: it has under twice the width
    wide = np.flatnonzero(2 * width + 2 >= least)
    found = border_runs(levels, border[wide], width[wide], begin_of[wide], least)
    if len(found):
        order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
        found = found[order]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)  # of equal stretches the smallest period
        found = found[fresh]
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    known: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    for d, run in zip(owner.tolist(), map(tuple, found.tolist()), strict=True):
        known[d].append(run)
    for d, begin in enumerate(starts.tolist()):
        if known[d]:
            out[d] = [(start - begin, length, period) for start, length, period in copied(known[d], blocks[d], least)]
    return out


def kept(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each word of the contract's tenth of the documents is taken from; None for the others."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


RESULT = "runs array<struct<start:long,length:long,period:long>>, n_words long, collapsed_sha256 string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_WORDS, planted: bool = False, with_text: bool = False) -> DataFrame:
    """Per row the id, ``runs`` by start and period, ``n_words``, and the hash of the words that stay
    when runs are cut down to their first period; ``with_text`` adds them as ``collapsed``.

    ``planted`` first repeats words in a tenth of the documents as the query's contract says.
    """
    prepare(df.sparkSession)
    extra = ["collapsed"] * with_text

    def results(names: pa.Array, rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        found = list(_results(rows, planted, least))
        columns = [
            names,
            pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _, _ in found], _RUN),
            pa.array([n for _, n, _ in found], pa.int64()),
            pa.array([hashlib.sha256(text).hexdigest() for _, _, text in found], pa.string()),
        ]
        if with_text:
            columns.append(pa.array([text.decode() for _, _, text in found], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[id_column, "runs", "n_words", "collapsed_sha256", *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            rows, size, done = [], 0, 0
            for name, text in zip(names.to_pylist(), batch.column(1), strict=True):
                rows.append((name, (text.as_py() or b"").split()))
                size += len(rows[-1][1])
                if size >= WORDS_AT_ONCE:
                    yield results(names.slice(done, len(rows)), rows)
                    done, rows, size = done + len(rows), [], 0
            if rows:
                yield results(names.slice(done, len(rows)), rows)

    source = df.select(id_column, F.col(text_column).cast("binary").alias("__text"))
    schema = f"`{id_column}` {source.schema[0].dataType.simpleString()}, {RESULT}" + ", collapsed string" * with_text
    return source.mapInArrow(run, schema)


def _results(rows: list[tuple[int | None, list[bytes]]], planted: bool, least: int) -> Iterator[tuple[list[tuple[int, int, int]], int, bytes]]:
    """(runs, words, words that stay) of each (id, words)."""
    orders = [planted_order(name, len(words)) if planted else None for name, words in rows]
    hashes = [np.fromiter(map(hash, words), np.int64, len(words)) for _, words in rows]
    chosen = suspects([h if order is None else h[order] for h, order in zip(hashes, orders, strict=True)], least)
    numbers = _Numbers()
    arrays = [np.fromiter(map(numbers.__getitem__, rows[d][1]), np.int64, len(rows[d][1])) for d in chosen]
    found = dict(zip(chosen, find_runs([a if orders[d] is None else a[orders[d]] for d, a in zip(chosen, arrays, strict=True)], least), strict=True))
    for d, (_, words) in enumerate(rows):
        runs, n, order = found.get(d, []), len(words), orders[d]
        if runs or order is not None:
            taken = (np.arange(n) if order is None else order)[kept(n, runs)]
            words = [words[i] for i in taken.tolist()]
        yield runs, n, b" ".join(words)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``periodic_runs``."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("__best", best).select(
        id_column,
        F.size("runs").cast("long").alias("n_runs"),
        F.expr("-__best.start").alias("start"),
        F.col("__best.length").alias("length"),
        F.expr("-__best.period").alias("period"),
        F.expr("__best.length * 1000 div -__best.period").alias("exponent_milli"),
        F.expr(f"sha2({lines}, 256)").alias("runs_sha256"),
        "collapsed_sha256",
    )
