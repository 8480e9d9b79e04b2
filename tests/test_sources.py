"""Round trips and refusals of the readers."""

import gzip
import json
import struct

import pyarrow as pa
import pyarrow.feather
import pytest

from axonlake.sources import tables
from axonlake.sources.arrow_ipc import ArrowIpc


def test_arrow_ipc_by_batches(spark, tmp_path):
    spark.dataSource.register(ArrowIpc)
    t = pa.table({"id": pa.array([1, 2**53 + 1, None], pa.int64()), "s": pa.array(["a", None, "a"]).dictionary_encode(), "l": pa.array([[1.5], [], None], pa.list_(pa.float64())), "u": pa.array([2**64 - 1, 0, None], pa.uint64()), "flag": pa.array([True, False, None])})
    path = str(tmp_path / "x.feather")
    pyarrow.feather.write_feather(t, path, chunksize=1, compression="uncompressed")
    df = spark.read.format("arrow_ipc").option("columns", "id,s,l,u").load(path)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.select("id", "s", "l", "u").collect()), key=str) == sorted([(1, "a", [1.5], 2**64 - 1), (2**53 + 1, None, [], 0), (None, "a", None, None)], key=str)
    with pytest.raises(Exception, match="not read"):
        spark.read.format("arrow_ipc").load(path).collect()
    with pytest.raises(Exception, match="the limit"):
        spark.read.format("arrow_ipc").option("columns", "id").option("max_batch_bytes", "1").load(path).collect()


def test_csv_release(spark, tmp_path):
    text = {"connections": "﻿pre_root_id, post_root_id ,syn_count,neuropil\n1, 2 ,3,AL\n720575940600000001,2,,\n", "classification": "root_id,flow,super_class,class,sub_class,cell_type,side\n1,a,b,c,d,e,left\n", "neurons": "root_id,nt_type,nt_type_score\n1,gaba,0.5\n"}
    for k, v in text.items():
        with gzip.open(tmp_path / f"{k}.csv.gz", "wt") as f:
            f.write(v)
    tables.convert_release(spark, {k: str(tmp_path / f"{k}.csv.gz") for k in text}, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out/connections")).orderBy("pre_root_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 3, "AL"), (720575940600000001, 2, None, None)]
    assert spark.read.parquet(str(tmp_path / "out/classification")).first()["included"] == "released"
    with pytest.raises(ValueError, match="missing"):
        tables.csv_table(spark, str(tmp_path / "neurons.csv.gz"), {"nothing": "long"})
    (tmp_path / "twice.csv").write_text("a, a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="repeated"):
        tables.csv_table(spark, str(tmp_path / "twice.csv"), {"b": "long"})


def test_reports_are_never_cut(spark):
    assert tables.markdown(spark.sql("SELECT 1 AS a, NULL AS b"), 1) == "| a | b |\n| --- | --- |\n| 1 |  |\n"
    with pytest.raises(ValueError, match="at most 1 rows"):
        tables.markdown(spark.range(2), 1)


def test_mapping_refuses(spark):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    assert tables.FieldMapping({"id": "x", "side": "z"}, {"id": "bigint"}, frozenset({"side"})).apply(df).columns == ["id"]
    with pytest.raises(ValueError, match="no column"):
        tables.FieldMapping({"id": "z"}).apply(df)
    with pytest.raises(ValueError, match="not bigint"):
        tables.FieldMapping({"id": "y"}, {"id": "bigint"}).apply(df)


def test_strict_json():
    assert tables.strict_json('{"a": 1}', {"a"}) == {"a": 1}
    for bad in ('{"a": 1, "A": 2}', '{"b": 1}', '{"a": 1} x'):
        with pytest.raises(ValueError):
            tables.strict_json(bad, {"a"})
    assert tables.canonical_digest({"b": 1, "a": 2}) == tables.canonical_digest({"a": 2, "b": 1})


def test_records_and_corpus(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text('{"request_id": "1", "input_hash": "h"}\n\n{"request_id": "2", "input_hash": "k"}\n')
    assert tables.record_log(spark, str(log)).count() == 2
    with pytest.raises(Exception, match="held-out"):
        tables.record_log(spark, str(log), spark.createDataFrame([("k",)], "sha256 string")).collect()
    log.write_text('{"request_id": "1"\n')
    with pytest.raises(Exception, match="malformed"):
        tables.record_log(spark, str(log)).collect()
    doc = {"id": "a", "source": "s", "text": "t", "license": {"holder": "h", "terms": "t", "source": "s"}}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    assert tables.corpus(spark, str(tmp_path / "m.json")).first()["text"] == "t"
    (tmp_path / "m.json").write_text(json.dumps(doc) + "\n" + json.dumps(doc))
    with pytest.raises(Exception, match="repeated id"):
        tables.corpus(spark, str(tmp_path / "m.json")).collect()


def test_graph_store(spark, tmp_path):
    nodes, edges = spark.range(5), spark.createDataFrame([(0, 1, 3)], "source_index long, target_index long, weight long")
    tables.save_graph(nodes, edges, {"name": "x"}, str(tmp_path / "g"))
    a, b, report = tables.load_graph(spark, str(tmp_path / "g"))
    assert (a.count(), b.count(), report["name"]) == (5, 1, "x")
    with pytest.raises(Exception, match="already exists"):
        tables.save_graph(nodes, edges, {}, str(tmp_path / "g"))
    nodes.limit(2).write.mode("overwrite").parquet(str(tmp_path / "g/nodes"))
    with pytest.raises(ValueError, match="digests"):
        tables.load_graph(spark, str(tmp_path / "g"))


def test_audio_and_hierarchy(spark, tmp_path):
    data = struct.pack("<4h", 0, 16384, -32768, 100)
    (tmp_path / "x.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
    r = tables.audio(spark, str(tmp_path / "x.wav")).first()
    assert r["rate"] == 8000 and r["samples"][1:3] == [0.5, -1.0]
    tree = spark.createDataFrame([('{"name": "r", "children": [{"name": "a"}, {"name": "b", "children": [{"name": "c"}]}]}',)], "j string")
    assert [(r["level"], r["nodes"]) for r in tables.hierarchy(tree, "j").orderBy("level").collect()] == [(0, 1), (1, 2), (2, 1)]
