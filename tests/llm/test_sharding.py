from collections import Counter

import pytest
from pyspark.sql import functions as F

from terraframe.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 64, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = [r.p for r in S.permute(spark.range(n), "id", n, "p").orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert [S.locate(i, n, 8) for i in range(min(n, 50))] == [(p % 8, p // 8) for p in got[:50]]
    assert n < 64 or got != list(range(n))


def test_shards(make):
    rows = [(i, "x" * (i % 50)) for i in range(203)] + [(None, None), (None, None), (5, "x" * 5)]
    df = make(rows, extra=["shard", "Slot"])
    out = S.shard_rows(df, ["doc_id", "text"], 8).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for k, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == k) == list(range(n))
    again = S.shard_rows(df.repartition(7), ["doc_id", "text"], 8).collect()
    key = lambda r: (r.doc_id or -1, r.text or "", r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert out[0].row_number is not None and S.locate(out[0].row_number, len(rows)) == (out[0].shard, out[0].slot)


def test_equal_rows_and_shared_keys_are_spread(make):
    """A third of the rows are equal, a third share their key: neither meets in one task of a window."""
    rows = [(7, "same")] * 300 + [(8, f"t{i}") for i in range(300)] + [(i, "x") for i in range(1000, 1300)]
    out = S.global_row_numbers(make(rows).select("doc_id", "text"), ["doc_id"], buckets=64, chunk=32)
    got = out.collect()
    assert sorted(r.row_number for r in got) == list(range(900))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and len(plan) < 20_000
    long = S.permute(out, "row_number", 10**12 - 7, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert len(long) < 60_000  # no literal of sqrt(N) numbers


def test_the_query(spark, make, tmp_path):
    import zlib

    rows = [(i, "é" * (i % 9)) for i in range(100)] + [(None, None), (3, None), (3, ""), (3, "")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op4_sharding(spark, str(tmp_path)).collect()
    data = [((i, (t or "").encode())) for i, t in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b), "rows", None) for i, b in data)
    for k in range(8):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own))) and len(own) in (len(rows) // 8, len(rows) // 8 + 1)


def test_empty_and_native(spark, make):
    assert S.shard_rows(make([]), ["doc_id"]).count() == 0
    df = S.shard_rows(make([(i, "a") for i in range(10)]).select("doc_id", F.octet_length("text").alias("size")), ["doc_id"], 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
