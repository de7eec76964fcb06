"""Packing: concatenate and cut.

Pass 1 tokenizes each document once, in the partition that reads it, and writes
a table: partition, tokens before the document inside the partition, and its
ids (uint32, little-endian; the closing id included).  Partition totals, one
number per partition, get a prefix sum; a document's global offset is its
partition's offset plus its own.  Pass 2 cuts the endless sequence at multiples
of the window: a document that crosses windows gets one boundary record for
each.  All sequences but the last are full.  Pass 2 is JVM-side; no shuffle
moves tokens while the input has at most ``BROADCAST_ROWS`` partitions, beyond
that one does.

The ids are those that the tokenizer's JSON file gives without adding special
tokens: one that stands in a text is its own id.  They are made with the rank file
of the same vocabulary by another encoder, several times faster, and tests hold
the two against each other.

Defined cases: null text is empty (the closing id alone); bytes that are no UTF-8
are read as U+FFFD; ids may be null or
repeat; an empty table gives an empty result; columns other than id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import tidy, utf8
from .storage import files, read, write_table
from .tokenizers import ByteBpe

WINDOW = 1024
BLOCK = 4096
#: Offsets (12 bytes each) are broadcast up to so many partitions; beyond, the join moves the tokens once.
BROADCAST_ROWS = 1_000_000


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """(id, part, before, n, ids): the written result of pass 1."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                ids = [np.append(bpe.array(t), np.array(end_id, "<u4")) for t in utf8(piece.column(1))]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["id", "part", "before", "n", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = narrow.coalesce(files(docs))  # before the run: a task's partition has one number and one count
    return write_table(narrow.mapInArrow(run, "id long, part int, before long, n long, ids binary"), "op2-tokens")


def prefix_sums(totals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(part, base): tokens before each partition.  Two levels, so that no task sees more than ``block`` rows."""
    totals = totals.withColumn("block", F.call_function("div", F.col("part"), F.lit(block)))
    inner = F.sum("total").over(Window.partitionBy("block").orderBy("part")) - F.col("total")
    blocks = totals.groupBy("block").agg(F.sum("total").alias("all"))
    outer = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("first"))
    return totals.withColumn("inner", inner).join(F.broadcast(outer), "block").select("part", (F.col("first") + F.col("inner")).alias("base"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces: id_col, start, length, ids (binary, uint32 little-endian), doc_tokens, sequence_id, offset."""
    tokens = tokenized(docs, id_col, text_col, path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = write_table(prefix_sums(totals), "op2-offsets")  # a row for each partition of the input
    if base.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    w = F.lit(window).cast("long")
    g = F.col("base") + F.col("before")
    first, last = F.call_function("div", g, w), F.call_function("div", g + F.col("n") - 1, w)
    placed = tokens.join(base, "part").select("id", "n", "ids", g.alias("g"), F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.col("sequence_id") * w - F.col("g"), F.lit(0).cast("long"))
    stop = F.least((F.col("sequence_id") + 1) * w - F.col("g"), F.col("n"))
    cut = placed.withColumns({"start": start, "length": stop - start})
    ids = F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return cut.select(F.col("id").alias(id_col), "start", "length", ids.alias("ids"), F.col("n").alias("doc_tokens"), "sequence_id", (F.col("g") + F.col("start") - F.col("sequence_id") * w).alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
