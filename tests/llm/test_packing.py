import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraframe.llm import packing as P


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_round_trip(make, words):
    rows = [(i, words(5 + 37 * i, i)) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "a"), (103, words(6000, 3)), (104, "x" * 20_000), (105, " " * 3000 + "y"), (106, "<|endoftext|> ünï 日本"), (107, "a<|endoftext|>b"), (108, words(1500, 4) + "<|endoftext|>"), (109, " <|endoftext|>" * 700 + "<|endoftext|>\n<|endoftext|"), (110, ("x" * 4 + " <|endoftext|>y ") * 2000), (7, rows[7][1]), (None, "no id")]
    pieces = P.pack(make(rows, extra=["n", "part", "ids", "start"])).collect()
    assert sum(p.length for p in pieces) == sum(len(ids_of(t)) for _, t in rows)
    seqs = {}
    for p in pieces:
        assert 0 < p.length <= 1024 and len(p.ids) == 4 * p.length and p.offset + p.length <= 1024
        seqs.setdefault(p.sequence_id, []).append(p)
    assert sorted(seqs) == list(range(len(seqs)))
    for k, ps in seqs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or k == len(seqs) - 1
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for i, ts in texts.items():
        ps = sorted(by_doc[i], key=lambda p: (p.sequence_id, p.offset))
        got = np.frombuffer(b"".join(bytes(p.ids) for p in ps), "<u4").tolist()
        assert got == ids_of(ts[0]) * len(ts)
        assert all(p.doc_tokens == len(ids_of(ts[0])) for p in ps)


def test_digest_and_prefix_sums(spark, make):
    rows = P.pack(make([(1, "abc")])).select(F.crc32("ids").alias("c"), "ids").collect()
    assert rows[0].c == zlib.crc32(np.array(ids_of("abc"), "<u4").tobytes())
    totals = spark.createDataFrame([(i, i * i + 1) for i in range(50)], "part int, total long")
    got = {r.part: r.base for r in P.prefix_sums(totals, block=7).collect()}
    assert got == {i: sum(j * j + 1 for j in range(i)) for i in range(50)}


def test_the_query(spark, make, words, tmp_path, monkeypatch):
    """Every id lies in exactly one piece: pieces of a document in order give its ids; with and without a broadcast."""
    rows = [(i, words(40 * i, i)) for i in range(40)] + [(99, None)]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    for most in (P.BROADCAST_ROWS, 0):
        monkeypatch.setattr(P, "BROADCAST_ROWS", most)
        got = P.op2_packing(spark, str(tmp_path)).collect()
        for i, t in rows:
            ids = ids_of(t)
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            at = 0
            for r in own:
                piece = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece))
                at += r.length
            assert at == len(ids)
        for k in {r.sequence_id for r in got}:
            own = sorted((r.offset, r.length) for r in got if r.sequence_id == k)
            assert [o for o, _ in own] == [sum(n for _, n in own[:j]) for j in range(len(own))]


def test_special_tokens_on_both_sides_of_a_chunk(monkeypatch):
    from terraframe.llm import tokenizers as T

    bpe = T.ByteBpe()
    text = "ab <|endoftext|> cd<|endoftext|>ef  <|endoftext|>\n" * 40
    for size in (1, 7, 20, 333):
        monkeypatch.setattr(T.chunks, "__defaults__", (size,))
        assert bpe.array(text).tolist() == ids_of(text)[:-1]


def test_empty(make):
    assert P.pack(make([])).count() == 0


def test_many_small_partitions_make_few_files(spark, make, words, tmp_path):
    rows = [(i, words(30 + i, i)) for i in range(60)]
    make(rows).repartition(60).write.parquet(str(tmp_path / "documents.parquet"))
    own = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        cores = spark.sparkContext.defaultParallelism
        assert docs.rdd.getNumPartitions() > 2 * cores
        tokens = P.tokenized(docs)
        assert len(tokens.inputFiles()) <= cores
        at = {}
        for r in sorted(tokens.collect(), key=lambda r: (r.part, r.before)):
            assert r.before == at.get(r.part, 0)
            at[r.part] = r.before + r.n
        pieces = P.pack(docs).collect()
    finally:
        for k in own:
            spark.conf.unset(k)
    assert sum(p.length for p in pieces) == sum(len(ids_of(t)) for _, t in rows)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by_doc[p.doc_id] = by_doc.get(p.doc_id, b"") + bytes(p.ids)
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in by_doc.items()} == {i: ids_of(t) for i, t in rows}
