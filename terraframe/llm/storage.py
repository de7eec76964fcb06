"""Shared scratch tables.

Lineage is cut by writing a table into the application's folder below
``spark.checkpoint.dir``; executors and driver both see it.  What a result reads stays
until ``terraframe.sources.scratch.clean_up``.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, new_path, shared_dir

#: Rows of an Arrow batch while a table is written or texts are summed up: whole texts make large rows.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCK = threading.Lock()
#: Of each session that writes just now: how many threads do, and its own setting.
_SMALL: dict[int, tuple[int, str]] = {}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches while any thread is inside; the last one out puts the session's own setting back.

    Every job that hands whole texts to Python and is run here, not by the caller, belongs inside: at the session's
    10,000 rows the JVM builds batches of tens of MB outside its heap, and keeps much of that.
    """
    key = id(spark._jsparkSession)
    with _LOCK:
        inside, own = _SMALL.get(key, (0, spark.conf.get(_BATCH)))
        _SMALL[key] = inside + 1, own
        if not 0 < int(own) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        with _LOCK:
            inside, own = _SMALL.pop(key)
            if inside > 1:
                _SMALL[key] = inside - 1, own
            else:
                spark.conf.set(_BATCH, own)


def write_table(df: DataFrame, name: str, scratch: list[DataFrame] | None = None, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    ``scratch``: a list that takes note of it, for :func:`drop_table`; ``parts``: so many files at most.
    """
    spark = df.sparkSession
    df = df.coalesce(parts) if parts else df
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    if scratch is not None:
        scratch.append(out)
    return out


#: Bytes, by the planner's estimate, that are worth a file of their own.
FILE_BYTES = 8 << 20


def files(rows: DataFrame) -> int:
    """A number of files that is enough for ``rows``: one for each core, more as their size grows.

    A bound for ``coalesce``; it looks at the plan alone, and where a size isn't known it bounds nothing.
    Many small files are dear in any store (where each starts a process to set its permissions, on executors too).
    """
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(min(-(-size // FILE_BYTES), 1 << 24), rows.sparkSession.sparkContext.defaultParallelism)


def splits(table: DataFrame) -> int:
    """In how many parts a written table is read, :func:`files` at most: a number of files, for tables made from it, that grows with the data."""
    return min(max(table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism), files(table))


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of :func:`write_table` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_table_path", None)
        if path:
            delete(df.sparkSession, path)


def join_split(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with an aggregate of one row a key, so that the rows of a hot key can be split.

    An aggregate is dealt by its keys, and a join on them would take that dealing
    as it is, which adaptive execution can't split.  One more key, a function of
    the others, makes both sides be dealt anew.
    """
    z = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in on]), F.lit(1 << 20))
    return rows.withColumn("__z", z).join(keys.withColumn("__z", z), [*on, "__z"], how).drop("__z")


#: Bits of :func:`marked`'s bitmap: 262,144 words, 4 MB as a broadcast table, whatever the data.
BITMAP = 1 << 24


def marked(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """``rows`` with __may: false only where the hash ``key`` (a long) is surely not among those of ``asked``.

    A bitmap of a constant size, broadcast, tells rows apart before anything is
    moved; where it is full it tells nothing, and what follows is right as well.
    """
    place = F.pmod(F.col(key), F.lit(BITMAP).cast("long"))
    word, bit = F.shiftright(place, 6), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")
    words = asked.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    return found.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__word", "__bits")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns an operator is about to add (names match in any case)."""
    low = {n.lower() for n in names}
    return df.select(*[c_ for c_ in (df[f"`{c}`"] for c in df.columns if c.lower() not in low)])


def without_rows(docs: DataFrame, out: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``docs`` less the rows whose id (null-safe) and hash of ``text`` are in ``out``, a table of these two."""
    i, h = out.columns
    hashed = docs.withColumn("__h", F.xxhash64(text.cast("string")))
    return hashed.join(out, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (F.col("__h") == F.col(h)), "left_anti").drop("__h")
