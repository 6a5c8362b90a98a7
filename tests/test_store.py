"""Shared folders: what commits is there whole, what fails leaves nothing, pages stop where they should."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import documents, store


def everything(path):
    return [f for f in glob.glob(f"{path}/**", recursive=True, include_hidden=True) if f != f"{path}/"]


def test_rows_come_back_and_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, "a\nb", None), (2, None, [1]), (2, None, [1])], "k int, v string, l array<int>")
    assert store.read_lines(spark, path).collect() == []
    ids = store.insert_returning(rows, path, "k").collect()
    assert len({r.id for r in ids}) == 2 and sorted(r.k for r in ids) == [1, 2, 2]
    back = store.read_rows(spark, path, "k int, v string, l array<int>, id string")
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, [(1, "a\nb", None, ids[0].id), *[(2, None, [1], ids[1].id)] * 2]))
    before = sorted(everything(path))
    bad = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3999, F.raise_error("broken")).otherwise(F.col("id")).cast("string").alias("value"))
    with pytest.raises(Exception, match="broken"):
        store.append_lines(bad, path)
    with pytest.raises(Exception, match="without line breaks"):
        store.append_lines(spark.createDataFrame([("ok",), ("a\nb",)], "value string"), path)
    new = [f for f in everything(path) if f not in before]
    assert [f for f in new if f"/{store.STAGING}" not in f] == [] and back.count() == 3
    store.clear_staging(path, 0)
    assert glob.glob(f"{path}/{store.STAGING}/*") == [] and back.count() == 3
    store.append_lines(spark.range(10).select(F.col("id").cast("string")), path)
    assert store.read_lines(spark, path).count() == 13
    store.append_lines(spark.createDataFrame([("only",)], "value string"), path, overwrite=True)
    assert [r.value for r in store.read_lines(spark, path).collect()] == ["only"]
    store.append_lines(spark.createDataFrame([], "value string"), path)
    assert store.read_lines(spark, path).count() == 1


def test_log_lines(spark):
    rows = [("debug", "no"), ("info", "call 555-123-4567"), ("error", None), (None, "x"), ("other", "x")]
    df = spark.createDataFrame(rows, "level string, msg string").withColumn("at", F.timestamp_seconds(F.lit(1.5))).withColumn("context", F.struct(F.lit("a@b.org").alias("email"), F.lit("m a@b.org").alias("free")))
    got = [json.loads(r.value) for r in store.log_lines(df).collect()]
    context = {"email": "[redacted]", "free": "m [redacted:email]"}
    assert got == [
        {"level": "info", "at": "1970-01-01T00:00:01.500Z", "msg": "call [redacted:phone]", "context": context},
        {"level": "error", "at": "1970-01-01T00:00:01.500Z", "msg": None, "context": context},
    ]
    assert [json.loads(r.value)["level"] for r in store.log_lines(df, "error").collect()] == ["error"]


def test_objects(spark, tmp_path):
    path = f"file://{tmp_path}/objects"
    put = lambda rows: store.put_objects(spark.createDataFrame(rows, "key string, content binary"), path)
    put([("org/1/a.bin", b"\0x"), ("org/1/b/c.bin", b""), ("org/12/a.bin", b"y")])
    put([("org/12/a.bin", b"new")])
    found = {r.path.split("objects/")[1]: bytes(r.content) for r in documents.read_files(spark, path, "*.bin").collect()}
    assert found == {"org/1/a.bin": b"\0x", "org/12/a.bin": b"new"} and (tmp_path / "objects/org/1/b/c.bin").exists()  # Spark lists no empty files
    assert store.delete_prefix(path, "org/1") == 2 and store.delete_prefix(path, "org/1/") == 0
    assert documents.read_files(spark, path, "*.bin").count() == 1
    for key in ("../out", "a//b", "", None, f"{store.STAGING}/x"):
        with pytest.raises(Exception, match="no key or content"):
            put([("fine", b"1"), (key, b"2")])
    assert documents.read_files(spark, path).count() == 1


def test_pages_stop_at_a_gap_an_empty_and_a_short_page(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = spark.range(0, 1003, 1, 7).select(F.col("id").alias("n"), F.lit("é").alias("t"))
    store.land_pages(rows, path, "n", size=100)
    read = lambda **o: [(r.place, json.loads(r.row)["n"]) for r in store.read_pages(spark, path, 100, **o).orderBy("place").collect()]
    assert read() == [(i, i) for i in range(1003)]
    assert read(limit=250) == [(i, i) for i in range(250)] and read(limit=0) == []
    assert store.read_pages(spark, path, 100).select(F.spark_partition_id()).distinct().count() == 11
    put = lambda key, n: store.put_objects(spark.createDataFrame([(key, json.dumps([{"n": 0}] * n))], "key string, content string"), path)
    put("0000001100-100.json", 100)  # behind the short page
    put("0000005000-1.json", 1)  # behind a gap
    assert len(read()) == 1003
    assert store.read_pages(spark, str(tmp_path / "none")).collect() == []
    put2 = str(tmp_path / "empty")
    store.put_objects(spark.createDataFrame([("0000000000-0.json", "[]"), ("0000000200-1.json", '[{"n":1}]')], "key string, content string"), put2)
    assert store.read_pages(spark, put2).collect() == []


def test_sensitive_keys_of_any_map(spark):
    from docketry.operators.governance import redact_record

    df = spark.createDataFrame([({"ssn": 1, "k": 2}, {"Patient Name": ["x"], "k": ["a@b.org"]}, {"ssn": "1"})], "a map<string,int>, b map<string,array<string>>, c map<string,string>")
    assert tuple(redact_record(df).first()) == ({"ssn": None, "k": 2}, {"Patient Name": None, "k": ["[redacted:email]"]}, {"ssn": "[redacted]"})


def test_objects_are_planned_by_folders_and_read_whole(spark, tmp_path):
    root = str(tmp_path / "objects")
    assert store.read_objects(spark, root).count() == 0
    made = [(f"org/{i % 20}/case/{i}/{'a' if i % 2 else 'b'}.txt", f"content {i}") for i in range(200)] + [("top.txt", "é"), ("org/note.txt", ""), ("org/3/x.bin", "no")]
    store.put_objects(spark.createDataFrame(made, "key string, content string"), root)
    found = {r.key: (r.length, bytes(r.content).decode()) for r in store.read_objects(spark, root, "*.txt").collect()}
    assert found == {k: (len(c.encode()), c) for k, c in made if k.endswith(".txt")}
    planned = store.ObjectsReader(root, "*").partitions()
    assert sum(len(p.folders) for p in planned) == 20 and sum(len(p.files) for p in planned) == 2
