import pytest
import io
import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import activity


def test_folder_to_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("manifest.json", json.dumps({"pages": ["1.txt", "2.txt"]}))
        z.writestr("1.txt", "one\x00" + "x" * 1100)
        z.writestr("2.txt", "two")
    (tmp_path / "sub" / "a.pdf").write_bytes(b.getvalue() + b" " * 0)
    (tmp_path / "b.pdf").write_bytes(b"PK broken" + b"." * 2000)
    (tmp_path / "c.pdf").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"no")
    f = files.list_files(spark, str(tmp_path))
    names = files.list_names(spark, str(tmp_path))
    assert f.count() == 2 and names.count() == 3
    pages = files.extract_pages(f)
    got = {(r["path"].rsplit("/", 1)[1], r["page_number"]): r["text"] for r in pages.where("error is null").collect()}
    assert got["a.pdf", 1].startswith("onex") and got["a.pdf", 2] == "two"
    valid = {r["path"].rsplit("/", 1)[1]: (r["valid"], r["issue"]) for r in files.validity(names, pages).collect()}
    assert valid["c.pdf"] == (False, "empty file") and valid["b.pdf"][1].startswith("unreadable") and not valid["b.pdf"][0]
    assert len({r["hash"] for r in files.file_hashes(f).collect()}) == 2


def test_state_files(spark, tmp_path):
    assert files.read_chunks(spark, str(tmp_path / "none")).count() == 0
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "manifest.json").write_text(json.dumps({"a.pdf": {"hash": "1", "chunk_ids": ["x", "y"]}}))
    m = files.read_manifest(spark, str(tmp_path / "manifest.json")).first()
    assert (m["filename"], m["chunk_ids"]) == ("a.pdf", ["x", "y"])
    d = spark.createDataFrame([("c", "t")], "chunk_id string, text string").select("chunk_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in files.CHUNK.fields[2:]])
    files.write_chunks(d, str(tmp_path / "chunks"))
    assert files.read_chunks(spark, str(tmp_path / "chunks")).first()["text"] == "t"
    files.write_csv(spark.createDataFrame([("True", "007")], "in_registry string, n string"), str(tmp_path / "csv"))
    assert tuple(files.read_csv(spark, str(tmp_path / "csv")).first()) == ("True", "007")
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "csv")]) == str(tmp_path / "csv")


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime as T

    e = spark.createDataFrame([(i, T(2024, 1, 1, i % 5, i % 60), "a" if i % 3 else "b", float(i)) for i in range(200)], "event_id long, ts timestamp, event_type string, value double")
    e.repartition(4).write.parquet(str(tmp_path / "events"))
    got = activity.windowed_counts(spark, str(tmp_path / "events"), e.schema)
    want = e.groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_is_idempotent(spark):
    s = "chunk_id string, text string, n int"
    store = spark.createDataFrame([("a", "1", 0)], s)
    batch = spark.createDataFrame([("a", "2", 1), ("b", "x", 1), ("b", "y", 2)], s)
    once = activity.ingest_batch(store, batch, [F.col("n")])
    twice = activity.ingest_batch(once, batch, [F.col("n")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "2", 1), ("b", "y", 2)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.session import shared_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda k, d=None: folder if k == "spark.checkpoint.dir" else d, set=lambda k, v: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))

    assert shared_dir(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    assert shared_dir(session("local[8]"))
