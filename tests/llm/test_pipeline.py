import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    assert P.ORACLE_SQL is None


def test_run_against_a_plain_version(spark, make, words, tmp_path):
    from tests.llm.test_simhash import slow_components, slow_fingerprint
    from tests.llm.test_suffix_dedup import slow

    rows = [(i, words(50 + i, i)) for i in range(60)]
    shared = words(45, 999)
    rows += [(100 + i, words(40, 300 + i) + " " + shared + " " + words(30, 400 + i)) for i in range(4)]
    bench = [(1, words(30, 700)), (2, words(25, 701))]
    rows += [(200, words(40, 500) + " " + bench[0][1]), (201, rows[3][1]), (202, rows[5][1]), (203, None), (204, "12345 %%%"), (205, "")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in rows if t and i != 204]
    fps = [slow_fingerprint(t) for _, t in kept]
    comp = slow_components(fps)
    kept = [r for k, r in enumerate(kept) if comp[k] == k]
    cut = [(i, x[2].decode("utf-8", "ignore")) for (i, _), x in zip(kept, slow([t for _, t in kept], 200))]
    clean = dict((i, t) for i, t in cut if i != 200)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in clean.items()}
    have: dict = {}
    for p in sorted(got, key=lambda p: p.start):
        have.setdefault(p.doc_id, []).extend(int.from_bytes(p.ids[4 * k : 4 * k + 4], "little") for k in range(p.length))
    assert have == want
    assert sum(p.length for p in got) == sum(map(len, want.values()))


def test_every_stage_keeps_the_columns(spark, make, words, tmp_path):
    docs = make([(i, words(60, i)) for i in range(30)] + [(50, None), (None, words(70, 99))], extra=["kept", "fingerprint"])
    spark.createDataFrame([(1, words(20, 5000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 31, name
        docs = docs.filter(F.col("text").isNotNull())


def test_empty(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_or_of_a_repeated_one_have_their_own_fate(spark, make, words, tmp_path):
    leak = words(30, 800)
    rows = [(i, words(60, i)) for i in range(30)] + [(None, words(50, 900)), (None, words(20, 901) + " " + leak), (7, words(50, 902) + " " + leak), (None, "123 %%%"), (8, "456 !!!")]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(rows)
    texts = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    assert texts(P.drop_contaminated(spark, docs, str(tmp_path))) == set(rows) - {rows[31], rows[32]}
    assert texts(P.identify_language(spark, docs, str(tmp_path))) == set(rows[:33])


def test_many_small_partitions_make_few_files(spark, make, words, tmp_path, monkeypatch):
    leak, shared = words(30, 800), words(60, 801)
    rows = [(i, words(60, i)) for i in range(40)] + [(40, words(60, 3)), (41, words(50, 902) + " " + leak), (42, words(40, 903) + " " + shared), (43, shared + " " + words(40, 904))]
    make(rows).repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tables = []
    for module in (P.simhash, P.decontam):
        monkeypatch.setattr(module, "write_table", lambda df, name, *a, f=module.write_table, **b: tables.append((name, f(df, name, *a, **b))) or tables[-1][1])
    own = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(P.simhash, "drop_table", lambda *a: None)
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        most = spark.sparkContext.defaultParallelism
        assert docs.rdd.getNumPartitions() > 2 * most
        for i, want in ((1, set(range(44)) - {40}), (2, set(range(44))), (3, set(range(44)) - {41})):
            out = P.STAGES[i][1](spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{i}")
            found = spark.read.parquet(f"{tmp_path}/{i}")
            assert {r.doc_id for r in found.collect()} == want and found.count() == len(want)
            assert len(found.inputFiles()) <= most, P.STAGES[i][0]
        files = {name: len(t.inputFiles()) for name, t in tables}
        assert {"op1-sizes", "op8-leaks"} <= set(files) and max(files.values()) <= most, files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_whole_texts_come_to_python_in_small_batches(spark, make, words, tmp_path, monkeypatch):
    """Whatever is run inside a stage: at 10,000 rows a batch the JVM held tens of MB outside its heap for each task."""
    from terraframe.llm import storage

    monkeypatch.setattr(storage, "BATCH_ROWS", 100)
    (tmp_path / "seen").mkdir()
    folder = str(tmp_path / "seen")

    def noted(batches, rows=500):
        import uuid

        for b in batches:
            with open(f"{folder}/{b.num_rows}-{uuid.uuid4().hex}", "w"):
                yield b

    for module in (P.language_id, P.simhash, P.suffix_dedup, P.decontam):
        monkeypatch.setattr(module, "slices", noted)
    docs = make([(i, words(12, i)) for i in range(900)])
    spark.createDataFrame([(1, words(30, 9000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for _, stage in P.STAGES[:4]:
        stage(spark, docs, str(tmp_path))  # the jobs that the stage runs; its result is the caller's
        seen.append([int(x.name.split("-")[0]) for x in (tmp_path / "seen").iterdir()])
    assert all(len(a) < len(b) for a, b in zip([[], *seen], seen)) and sum(seen[-1]) > 4 * 900
    assert max(seen[-1]) <= 100
