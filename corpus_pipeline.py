"""A corpus pipeline over ``documents``: from raw texts to packed token sequences.

Stages, in order; each works on all that the one before kept, is written as
Parquet and read again:

1. language ID: documents without an identified language go;
2. SimHash near-dedup: the document with the smallest id of each group stays;
   fingerprints of five-word shingles within 4 bits, or shingles of Jaccard
   similarity 0.8 or more;
3. suffix-array dedup: passages of 200 bytes or more that occur elsewhere are
   cut out of the texts (all rows stay, texts may become empty);
4. decontamination: documents that leak a benchmark item go;
5. packing: what is left becomes sequences of at most 1024 tokens.

Defined cases: nulls in any column are carried; a null text has no language and
goes in stage 1; a row is known by its id, compared null-safe, and its text, so
rows of no id or a repeated one share a fate only if their texts are equal, and
equal rows become one in stage 2 if they stand for their group; an empty table gives an empty result; other columns are carried up to stage 4.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm import decontam, language_id, packing, simhash, suffix_dedup
from terraframe.llm.storage import drop_table, files, read, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_few_files(stage: Stage) -> Stage:
    """The stage, reading and returning as many partitions as its documents' size asks for, however many they come in."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        most = files(docs)
        return stage(spark, docs.coalesce(most), sf_dir).coalesce(most)

    return run


@in_few_files
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.drop_unidentified(docs, declared=F.col("lang"), host=F.col("source"))


@in_few_files
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


@in_few_files
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_passages(docs)


@in_few_files
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


@in_few_files
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL form: the stages train models, build indexes and tokenize; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``: all stages applied."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = write_table(docs, f"pipeline-{i + 1}")
        drop_table(before)  # packing has written its tokens by now
    return docs
