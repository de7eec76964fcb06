import glob

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraframe.functions.coords import tag
from terraframe.sources import ipc as I
from terraframe.sources.tables import to_arrow
from terraframe.types import linestring_type, parse_field, point_type


def table(spark, n=300):
    df = spark.range(n).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 11 != 0, F.struct(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"))).alias("g"), F.lit("text").alias("t"))
    return df.select("id", "k", tag(F.col("g"), "g", point_type().with_crs("EPSG:1")), "t").repartition(4)


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip_by_record_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        I.write_ipc_files(table(spark), path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = glob.glob(f"{path}/*.arrow")
    assert len(files) == 4
    batches = sum(pa.ipc.open_file(f).num_record_batches for f in files)
    df = I.read_ipc_files(spark, path)
    assert I.record_batches(spark.createDataFrame([(f,) for f in files], "path string")).count() == batches >= 15
    assert df.rdd.getNumPartitions() == batches
    assert rows(df) == rows(table(spark)) and parse_field(df.schema["g"]).crs == "EPSG:1"


def test_columns_and_comparisons(spark, tmp_path):
    path = str(tmp_path / "t")
    I.write_ipc_files(table(spark), path)
    got = I.read_ipc_files(spark, path, columns=["g", "id"], where=[("k", "in", [1, 3]), ("id", "<", 100)])
    assert got.columns == ["g", "id"]
    assert rows(got) == rows(table(spark).filter("k in (1, 3) and id < 100").select("g", "id"))
    assert I.read_ipc_files(spark, path, columns=["t"], where=[("id", ">", 1000)]).count() == 0
    with pytest.raises(ValueError, match="no column u"):
        I.read_ipc_files(spark, path, columns=["u"])
    with pytest.raises(ValueError, match="unknown comparison"):
        I.read_ipc_files(spark, path, where=[("id", "~", 1)])
    with pytest.raises(ValueError, match="there are files"):
        I.write_ipc_files(table(spark), path)
    with pytest.raises(ValueError, match="no files like"):
        I.read_ipc_files(spark, path, pattern="*.feather")


def test_streams_and_files_of_other_writers(spark, tmp_path):
    lines = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.0)]), (2, None), (3, [])], "id long, v array<struct<x:double,y:double>>").select("id", tag(F.col("v"), "l", linestring_type()))
    t = to_arrow(lines)
    with pa.ipc.new_stream(str(tmp_path / "a.arrow"), t.schema) as w:
        w.write_table(t, max_chunksize=1)
    with pa.ipc.new_file(str(tmp_path / "b.arrow"), t.schema) as w:
        w.write_table(t, max_chunksize=2)
    got = I.read_ipc_files(spark, str(tmp_path), where=[("id", "!=", 2)])
    assert rows(got) == sorted(rows(lines.filter("id <> 2")) * 2)
    interleaved = pa.array([[1.0, 2.0], None, [3.0, 4.0]], pa.list_(pa.float64(), 2))
    field = pa.field("p", interleaved.type, metadata={"ARROW:extension:name": "any.point", "ARROW:extension:metadata": "{}"})
    odd = pa.table([interleaved, pa.array([1, 2, 3], pa.uint32()), pa.array(["a", "b", "a"]).dictionary_encode()], schema=pa.schema([field, pa.field("u", pa.uint32()), pa.field("d", pa.dictionary(pa.int32(), pa.string()))]))
    (tmp_path / "odd").mkdir()
    with pa.ipc.new_file(str(tmp_path / "odd" / "c.arrow"), odd.schema) as w:
        w.write_table(odd)
    df = I.read_ipc_files(spark, str(tmp_path / "odd"))
    assert [tuple(r) for r in df.orderBy("u").collect()] == [([1.0, 2.0], 1, "a"), (None, 2, "b"), ([3.0, 4.0], 3, "a")]
    assert parse_field(df.schema["p"]).coord_type == 2


def test_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    t = to_arrow(table(spark, 0))
    (tmp_path / "t").mkdir()
    with pa.ipc.new_file(f"{path}/e.arrow", t.schema):
        pass
    assert I.read_ipc_files(spark, path).collect() == []
