"""Sharding: a Feistel permutation of global row numbers.

``shard_rows`` numbers the rows 0..N-1, sends each number through a keyed
bijection of [0, N) and reads shard and slot off the result::

    position = permute(row_number)      shard = position % k      slot = position // k

so shard sizes differ by one at most, slots have no gaps, and ``locate`` tells
where any row number goes without touching the data.

Row numbers.  Equal rows are counted as one; rows are dealt to a fixed number of
buckets by a hash of all their columns, numbered inside a bucket in key order, and
a bucket's first number is the sum of the counts before it (``buckets`` integers,
a constant).  Neither rows that share a key nor equal rows meet in one task, there
is no global sort, and the numbers depend on the data only, not on files,
partitions or the cluster.

Permutation.  A Feistel network over Z_a x Z_b, a = ceil(sqrt N), b = ceil(N/a):
rounds add a keyed hash of one half to the other, modulo its radix.  Its domain
a*b exceeds N by fewer than a numbers; a row that lands among those walks on
along its cycle until it is below N.  A cycle meets each excess number once, so
the walk ends within a*b-N steps: the bound in the expression is exact.  All of
it is DataFrame functions.

Defined cases: nulls are hashed and ordered like a value (nulls first); rows
equal in all columns are interchangeable and get consecutive numbers; a column of
maps is refused; an empty
table gives an empty result; an input column named like an output column is
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import read, without, write_table

ROUNDS = 8
BUCKETS = 4096
CHUNK = 1 << 16
OUTPUTS = ("row_number", "position", "shard", "slot")


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _key(seed: int, r: int) -> int:
    return seed * 1_000_003 + r


def _round(half: Column, radix: int, key: int) -> Column:
    return F.pmod(F.xxhash64(half, F.lit(key).cast("long")), F.lit(radix).cast("long"))


def _split(x: Column, b: int) -> tuple[Column, Column]:
    radix = F.lit(b).cast("long")
    right = F.pmod(x, radix)
    return F.call_function("div", x, radix), right


def _permute_once(x: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    """One pass of the network as a single expression (used on the rare walking rows)."""
    left, right = _split(x, b)
    for r in range(rounds):
        if r % 2 == 0:
            left = F.pmod(left + _round(right, a, _key(seed, r)), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + _round(left, b, _key(seed, r)), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def permute(df: DataFrame, number: str, n: int, out: str, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Add ``out``: the image of column ``number`` (0..n-1) under the permutation of [0, n)."""
    a, b = radices(n)
    left, right = _split(F.col(number), b)
    df = df.withColumns({"__sh_l": left, "__sh_r": right})
    for r in range(rounds):  # one projection a round: each half is computed once
        if r % 2 == 0:
            df = df.withColumn("__sh_l", F.pmod(F.col("__sh_l") + _round(F.col("__sh_r"), a, _key(seed, r)), F.lit(a).cast("long")))
        else:
            df = df.withColumn("__sh_r", F.pmod(F.col("__sh_r") + _round(F.col("__sh_l"), b, _key(seed, r)), F.lit(b).cast("long")))
    limit = F.lit(n).cast("long")
    df = df.withColumn("__sh_p", F.col("__sh_l") * F.lit(b).cast("long") + F.col("__sh_r"))
    excess = a * b - n
    p = F.col("__sh_p")
    # the bound is no literal, else the optimizer would put all numbers up to it into the plan
    for steps in (s for s in (8, excess) if s > 0 and excess):
        p = F.when(p < limit, p).otherwise(
            F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(min(steps, excess)).cast("long"), -p)), p, lambda x, _: F.when(x < limit, x).otherwise(_permute_once(x, a, b, seed, rounds)))
        )
        if excess <= 8:
            break
    return df.withColumn(out, p).drop("__sh_l", "__sh_r", "__sh_p")


def global_row_numbers(df: DataFrame, keys: list[str], buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Add ``row_number`` (0..N-1), a function of the rows' values alone."""
    df = without(df, "row_number")
    cols = [F.col(f"`{c}`") for c in df.columns]
    if any(f.dataType.typeName() in ("map", "variant") for f in df.schema.fields):
        raise ValueError("columns of maps can't be compared; leave them out of the numbering")
    rows = df.groupBy(*cols).agg(F.count("*").alias("__sh_m"))  # equal rows are one row with a count
    rows = rows.withColumn("__sh_b", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
    counts = rows.groupBy("__sh_b").agg(F.sum("__sh_m").alias("__sh_n"))
    # at most ``buckets`` rows, whatever the input
    first = counts.select("__sh_b", (F.sum("__sh_n").over(Window.orderBy("__sh_b")) - F.col("__sh_n")).alias("__sh_first"))
    order = [F.col(f"`{k}`") for k in keys] + [F.xxhash64(*cols), *[F.col(f"`{c}`") for c in df.columns if c not in keys]]
    before = F.sum("__sh_m").over(Window.partitionBy("__sh_b").orderBy(*order)) - F.col("__sh_m")
    numbered = rows.withColumn("__sh_i", before).join(F.broadcast(first), "__sh_b").withColumn("__sh_i", F.col("__sh_i") + F.col("__sh_first"))
    # the copies of a row get the numbers from its own on, a chunk at a time, so that many tasks make those of a hot one
    size = F.lit(chunk).cast("long")
    chunks = numbered.withColumn("__sh_c", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__sh_m") - 1, size)))).hint("rebalance")
    inside = F.sequence(F.col("__sh_c") * size, F.least((F.col("__sh_c") + 1) * size, F.col("__sh_m")) - 1)
    return chunks.withColumn("__sh_k", F.explode(inside)).withColumn("row_number", F.col("__sh_i") + F.col("__sh_k")).drop("__sh_b", "__sh_i", "__sh_m", "__sh_first", "__sh_c", "__sh_k")


def shard_rows(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 7, buckets: int = BUCKETS, n: int | None = None) -> DataFrame:
    """``df`` with row_number, position, shard and slot.  ``n``: the number of rows, counted if absent."""
    df = without(df, *OUTPUTS)
    n = df.count() if n is None else n
    out = permute(global_row_numbers(df, keys, buckets), "row_number", n, "position", seed)
    k = F.lit(shards).cast("long")
    return out.withColumns({"shard": F.pmod(F.col("position"), k).cast("int"), "slot": F.call_function("div", F.col("position"), k)})


def locate(row_number: int, n: int, shards: int = 8, seed: int = 7, rounds: int = ROUNDS) -> tuple[int, int]:
    """Shard and slot of a row number, without the data."""
    import struct

    import xxhash

    def f(half: int, key: int, radix: int) -> int:
        h = 42
        for v in (half, key):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return (h - (1 << 64) if h >> 63 else h) % radix

    a, b = radices(n)
    x = row_number
    while True:
        left, right = divmod(x, b)
        for r in range(rounds):
            if r % 2 == 0:
                left = (left + f(right, _key(seed, r), a)) % a
            else:
                right = (right + f(left, _key(seed, r), b)) % b
        x = left * b + right
        if x < n:
            return x % shards, x // shards


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = write_table(rows, "op4-rows")  # narrow; the texts are read once
    return shard_rows(rows, ["doc_id", "text_crc32", "size"], 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
