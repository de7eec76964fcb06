import pytest
from pyspark.sql import functions as F

from terraframe.llm import components, storage
from terraframe.llm import storage as S


def test_tables_go_to_the_named_folder(spark):
    before = spark.conf.get(storage._BATCH)
    df = storage.write_table(spark.range(10), "t")
    assert df.count() == 10 and spark.conf.get(storage._BATCH) == before
    assert storage.shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    storage.drop_table(df)
    storage.drop_table(spark.range(1))


def test_columns_are_replaced_whatever_their_case(spark):
    df = spark.range(1).withColumns({"Shard": F.lit(1), "a.b": F.lit(2)})
    assert storage.without(df, "shard").columns == ["id", "a.b"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(2000, 2300)]
    edges = [*chain, *star, (7, 7), (5, 3), (3, 5), (5, 3), (None, 1), (2299, 42)]
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {**{i: 100 for i in range(100, 161)}, **{i: 42 for i in [42, 1000, *range(2000, 2300)]}, 3: 3, 5: 3}
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_split_and_bitmap(spark, monkeypatch):
    """The join is the plain one; both sides are dealt anew, so hot keys can be split; the bitmap never loses a row."""
    rows = spark.range(0, 3000).select((F.col("id") * F.col("id") % 97).alias("k"), "id")
    least = rows.groupBy("k").agg(F.min("id").alias("m"))
    a = S.join_split(rows, least, ["k"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, rows.join(least, "k").collect())) and a.columns == ["k", "id", "m"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.join_split(rows, least, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ENSURE_REQUIREMENTS") == 3
    hashed = rows.withColumn("h", F.xxhash64("id"))
    asked = hashed.filter("id % 50 = 7").select("h")
    for bits in (S.BITMAP, 128):
        monkeypatch.setattr(S, "BITMAP", bits)
        got = S.marked(hashed, "h", asked)
        may = {r.id for r in got.filter("__may").collect()}
        assert got.count() == 3000 and {i for i in range(3000) if i % 50 == 7} <= may and (bits == 128 or len(may) < 70)
    assert S.marked(hashed, "h", asked.limit(0)).filter("__may").count() == 0


def test_number_of_files_and_threads(spark):
    import threading

    t = S.write_table(spark.range(0, 100, 1, 9), "test-files", parts=2)
    assert t.rdd.getNumPartitions() <= 2 and S.splits(t) >= 1
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    threads = [threading.Thread(target=S.write_table, args=(spark.range(0, 1000, 1, 4), f"test-t{i}")) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == own


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master, applicationId = "yarn", "a"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.shared_dir(Session())


def test_invalid_utf8(spark):
    """Bytes that are no UTF-8 read as U+FFFD everywhere and never stop a job."""
    from terraframe.llm import decontam, html_extract, packing, quality_rules, simhash, suffix_dedup, token_counts

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF6220C3' as string)").alias("text"))
    assert packing.pack(docs).first().doc_tokens == len(token_counts.Counter().bpe.ids("a\ufffdb \ufffd")) + 1
    assert token_counts.build(docs).first().n_chars == 5
    assert simhash.near_duplicates(docs).count() == 1 and suffix_dedup.dedup(docs).first().n_bytes == 5
    assert quality_rules.statistics(docs).first().n_words == 2
    assert decontam.contaminated(docs, spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0
    assert html_extract.extract(docs.withColumnRenamed("text", "html")).count() == 1


def test_workers_give_back_what_a_function_has_left_free(tmp_path):
    import subprocess
    import sys

    script = """
import re, numpy as np, pyarrow as pa
from terraframe.llm.arrow import tidy

def held():
    return sum(int(x) for x in re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())) / 1024

pins = []

@tidy
def run(batches):
    many = [np.ones(12_000) for _ in range(2000)]  # 192 MB in pieces that malloc does not map on their own
    pins.append(many[-1])  # on top of all that is free afterwards
    for b in batches:
        yield b.slice(0, len(many))

batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
at = held()
assert [b.num_rows for b in run(iter([batch]))] == [2]
assert held() < at + 40, (at, held())
shut = run(iter([batch, batch]))
next(shut)
shut.close()  # ends early: given back too
assert held() < at + 40, (at, held())
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=S.__file__.split("/terraframe/")[0], timeout=120)
    assert done.returncode == 0, done.stderr
