"""Operator 5: mixing sources to target weights by Pfair scheduling. DataFrame operations only.

Each source's rows, in the order of a hash of the id, are cut into blocks of ``block_units``
characters: a row's block is the running sum of the characters before it, divided by
``block_units``. Running sums are made of sums per source and range of hash values, prefix sums over
those few rows, and a window inside each range, so a large source is many windows. A text longer
than a block takes up the blocks that it covers. A source of weight w gives its block j the
release time floor(j / w) and the deadline ceil((j + 1) / w), in slots of one block. Earliest
deadline first, among released blocks, then fills every slot; at any time each source that still
has blocks is less than one block away from its weight.

Weights are taken as the exact fractions that they are, so windows are exact over any length. The
schedule is made on the driver from one row per source, one step per block, and joined to the rows
by source and block. A block is 200 thousand characters, and longer where there would be more than
200 thousand blocks and one for every source, so a schedule stays small at any size of the corpus. A source that has run
dry leaves its slots empty and the others go on in the same proportions.

Defined results: a null source counts as the empty one; a null text has no characters but still
takes its place; null ids are ordered by a hash of the text. A source of
weight zero is never dealt: its rows have null slots, and ``ordered`` leaves them out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a block, and the blocks at most, beyond which blocks are longer; the exponent that flattens the sources' shares into weights.
BLOCK_UNITS, MOST_BLOCKS = 200_000, 200_000
TEMPERATURE = 0.5
#: Kept for callers: weights are not rounded to a frame any more.
FRAME = 1000
#: Rows of the largest source in a window, on average; bits of the order inside a source.
WINDOW_ROWS = 10_000
_HASH_BITS = 62
_MADE = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_order")
_OWN = (*_MADE, "mix_source", "mix_range", "mix_units", "mix_before")


def quotas(weights: Mapping[str, float], frame: int = FRAME) -> dict[str, int]:
    """The weights as whole numbers in exactly their proportions, so ``frame`` (a length to round to) is of no effect."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights cannot be negative")
    whole = lcm(*(w.denominator for w in exact.values()))
    got = {s: int(w * whole) for s, w in exact.items()}
    common = gcd(*got.values()) or 1
    return {s: n // common for s, n in got.items()}


def window(block: int, quota: int, frame: int) -> tuple[int, int]:
    """Release time and deadline of a block, in slots."""
    return block * frame // quota, -(-(block + 1) * frame // quota)


def schedule(quota: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of each source's blocks, by earliest deadline among released blocks."""
    frame = sum(quota.values())
    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s] and quota[s]]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, block = heapq.heappop(waiting)
            heapq.heappush(ready, (window(block, quota[s], frame)[1], release, s, block))
        deadline, release, s, block = heapq.heappop(ready)
        yield s, block, slot, release, deadline
        if block + 1 < blocks[s]:
            heapq.heappush(waiting, (window(block + 1, quota[s], frame)[0], s, block + 1))
        slot += 1


def frame_slots(quota: Mapping[str, int]) -> dict[str, list[int]]:
    """The slot of each source's blocks within a frame of all quotas."""
    slots: dict[str, list[int]] = {s: [] for s in quota}
    for s, _, slot, _, _ in schedule(quota, quota):
        slots[s].append(slot)
    return slots


def _source(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _units(text_column: str) -> Column:
    return F.coalesce(F.length(text_column), F.lit(0)).cast("long")


def in_blocks(df: DataFrame, bits: int, id_column: str, source_column: str, text_column: str, block_units: int) -> DataFrame:
    """df with ``mix_source``, ``mix_order`` and ``mix_block``, by running sums in 2^bits ranges of a source's order."""
    by_id = F.xxhash64(F.col(id_column))
    hashed = F.when(F.col(id_column).isNull(), F.xxhash64(F.col(id_column), F.col(text_column))).otherwise(by_id)
    rows = df.withColumn("mix_source", _source(source_column)).withColumn("mix_order", F.shiftrightunsigned(hashed, 64 - _HASH_BITS))
    rows = rows.withColumn("mix_range", F.shiftright("mix_order", _HASH_BITS - bits)).withColumn("mix_units", _units(text_column))
    sums = rows.groupBy("mix_source", "mix_range").agg(F.sum("mix_units").alias("mix_before"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("mix_before", F.coalesce(F.sum("mix_before").over(earlier), F.lit(0)))
    inside = Window.partitionBy("mix_source", "mix_range").orderBy("mix_order", F.xxhash64(text_column)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["mix_source", "mix_range"])
    rows = rows.withColumn("mix_before", F.col("mix_before") + F.coalesce(F.sum("mix_units").over(inside), F.lit(0)))
    return rows.withColumn("mix_block", F.expr(f"mix_before div {block_units}L")).drop("mix_range", "mix_units", "mix_before")


def planned(spark: SparkSession, steps: Iterator[tuple[str, int, int, int, int]]) -> DataFrame:
    """The schedule as rows, one per block."""
    return spark.createDataFrame(list(steps), "mix_source string, mix_block long, mix_slot long, mix_release long, mix_deadline long")


def mix(
    df: DataFrame, weights: Mapping[str, float] | None = None, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
    block_units: int = BLOCK_UNITS, temperature: float = TEMPERATURE, frame: int = FRAME,
) -> DataFrame:
    """df with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_order`` (the order inside a block).

    ``weights`` by source; sources without one, and all if None, get their share of characters to
    the power ``temperature``.
    """
    spark, df = df.sparkSession, df.drop(*_OWN)
    sizes = df.groupBy(_source(source_column).alias("s")).agg(F.sum(_units(text_column)).alias("u"), F.count("*").alias("n")).collect()
    units = {row["s"]: row["u"] for row in sizes}
    total = sum(units.values()) or 1
    given = weights or {}
    wanted = {s: given[s] if s in given else (max(1, u) / total) ** temperature for s, u in units.items()}
    block_units = max(block_units, -(-total // MOST_BLOCKS))
    blocks = {s: u // block_units + 1 for s, u in units.items()}
    plans = planned(spark, schedule(quotas(wanted, frame), blocks) if units else iter(()))
    bits = (max((row["n"] for row in sizes), default=0) // WINDOW_ROWS).bit_length()
    rows = in_blocks(df, bits, id_column, source_column, text_column, block_units)
    rows = rows.join(plans, ["mix_source", "mix_block"], "left")
    return rows.select(*df.columns, *_MADE)


def ordered(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The dealt rows in mixed order: range-partitioned and sorted by slot, then by the order inside a block."""
    return mixed.filter("mix_slot is not null").repartitionByRange("mix_slot", "mix_order").sortWithinPartitions("mix_slot", "mix_order", id_column)


def digest(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``mix``."""
    return mixed.select(id_column, _source("source").alias("source"), _units("text").alias("units"), *_MADE)
