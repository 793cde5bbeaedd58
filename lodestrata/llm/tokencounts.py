"""Operator 9: token counts of documents in flat token files without an index.

A flat file is nothing but little-endian token ids, each document ended by a separator id. It is
read as blocks of a fixed number of ids that know their file and place but not the documents.
In every block one vectorised search finds the separators; what a block cannot know, the document
that began before it, is stitched by a prefix scan over the blocks of a file: how many documents
ended before the block and how many ids stand since the last separator. Both are window sums over
the blocks of a part of the file (``SCAN_BLOCKS`` blocks, half a gigabyte), and then over the parts, so
no window grows with the file by more than one small row a part.

Defined results: a null or empty text has no tokens and is its separator alone; ids behind a file's
last separator belong to no document and are not counted; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import tokens
from lodestrata.llm.common import prepare

#: The id that ends a document: the vocabulary's <|endoftext|>.
END_ID = 50256
BLOCK_TOKENS = 1 << 16
BLOCKS_OF_FILE = 256
SCAN_BLOCKS = 4096


def write_blocks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, blocks_of_file: int = BLOCKS_OF_FILE) -> DataFrame:
    """Tokenizes into flat files: rows (file, block, data) and, apart from them, rows (file, first, ids) that say whose documents a file holds.

    ``data`` is a block of 16-bit ids, cut without regard to documents.
    """
    prepare(df.sparkSession)
    path = path or tokens.default_path()
    kept = df.select(id_column, F.col(text_column).alias("__text"))
    id_type = kept.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.tokenizer(path, ordinary=True), np.array([end_id], "<u2")
        file, block, ordinal = TaskContext.get().partitionId() << 32, 0, 0
        rest = np.empty(0, "<u2")
        schema = None

        def row(data: bytes | None, ids: pa.Array, number: int) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary()), lists], names=["file", "block", "data", "ids"])

        for batch in batches:
            none = batch.column(0).slice(0, 0)
            schema = none
            parts = [rest]
            for ids in encoder.encode(batch.column(1).to_pylist()):
                if len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError("the vocabulary does not fit in 16 bits")
                parts += (ids.astype("<u2"), end)
            yield row(None, batch.column(0), ordinal)
            ordinal += batch.num_rows
            rest = np.concatenate(parts)
            whole = len(rest) // block_tokens
            for n in range(whole):
                yield row(rest[n * block_tokens : (n + 1) * block_tokens].tobytes(), none, block)
                block += 1
            rest = rest[whole * block_tokens :]
            if block >= blocks_of_file:
                if len(rest):
                    yield row(rest.tobytes(), none, block)
                file, block, ordinal, rest = file + 1, 0, 0, rest[:0]
        if len(rest) and schema is not None:
            yield row(rest.tobytes(), schema, block)

    return kept.mapInArrow(run, f"file long, block long, data binary, ids array<{id_type.simpleString()}>")


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, data) of flat files of any origin and size: Spark deals out byte ranges, and each is read by itself.

    The files have to be on a store that pyarrow opens (local or mounted paths, hdfs, s3, gs).
    """
    prepare(spark)
    step = block_tokens * width
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("file"), "length")  # reads no content
    last = F.ceil(F.col("length") / step).cast("long") - 1
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition("file", F.expr("block div 64")).sortWithinPartitions("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        name, stream = None, None
        for batch in batches:
            for file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if stream is not None:
                        stream.close()
                    files, place = FileSystem.from_uri(file if "://" in file else file.replace(":", "://", 1) if ":" in file else f"file://{file}")
                    name, stream = file, files.open_input_file(place)
                data = stream.read_at(step, block * step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])
        if stream is not None:
            stream.close()

    return ranges.mapInArrow(run, "file string, block long, data binary")


def count(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in (file, block, data); the separator is not counted."""
    prepare(blocks.sparkSession)
    kind = np.dtype(f"<u{width}")
    held = blocks.select("file", "block", "data")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, tails = [], []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data, kind)
                ends = np.flatnonzero(ids == end_id)
                lengths.append(np.diff(ends, prepend=-1) - 1)
                tails.append(len(ids) - (int(ends[-1]) + 1 if len(ends) else 0))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *lengths])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(tails, pa.int64())], names=["file", "block", "lengths", "tail"])

    rows = held.mapInArrow(scan, f"file {held.schema[0].dataType.simpleString()}, block long, lengths array<long>, tail long")
    rows = rows.withColumn("part", F.expr(f"block div {SCAN_BLOCKS}L")).withColumn("ended", F.size("lengths").cast("long"))

    def scanned(df: DataFrame, groups: tuple[str, ...], order: str, tail: str) -> DataFrame:
        """df with ``before`` (documents ended before a row), ``carry`` (ids since the last separator) and ``open`` (both with the row)."""
        own = Window.partitionBy(*groups).orderBy(order)
        upto, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("before", F.coalesce(F.sum("ended").over(ahead), F.lit(0))).withColumn("run", F.sum((F.col("ended") > 0).cast("int")).over(upto))
        df = df.withColumn("open", F.sum(tail).over(Window.partitionBy(*groups, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        return df.withColumn("carry", F.coalesce(F.lag("open").over(own), F.lit(0))).drop("run")

    rows = scanned(rows, ("file", "part"), "block", "tail")
    parts = rows.groupBy("file", "part").agg(F.sum("ended").alias("ended"), F.max_by("open", "block").alias("rest"))
    parts = scanned(parts, ("file",), "part", "rest").select("file", "part", F.col("before").alias("before_part"), F.col("carry").alias("carry_part"))
    rows = rows.join(parts, ["file", "part"])
    first = F.col("before_part") + F.col("before")
    carry = F.col("carry") + F.when(F.col("before") == 0, F.col("carry_part")).otherwise(0)
    out = rows.select("file", first.alias("first"), carry.alias("carry"), F.posexplode("lengths").alias("n", "length"))
    return out.select("file", (F.col("first") + F.col("n")).alias("ordinal"), (F.col("length") + F.when(F.col("n") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def named(counts: DataFrame, written: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts with the ids of the documents, from the rows that ``write_blocks`` keeps apart."""
    owners = written.filter("data is null").select("file", F.col("block").alias("first"), F.posexplode("ids").alias("n", id_column))
    owners = owners.select("file", (F.col("first") + F.col("n")).alias("ordinal"), id_column)
    return counts.join(owners, ["file", "ordinal"]).select(id_column, "n_tokens", "file", "ordinal")
