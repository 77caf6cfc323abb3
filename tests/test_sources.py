"""Files, the SQLite source and the paged change feed."""

import json
import sqlite3

from pyspark.sql import functions as F

from strandline.sources import files, sqlite
from strandline.streaming import changes


def test_sqlite_tables(spark, tmp_path):
    path = f"{tmp_path}/base.db"
    with sqlite3.connect(path) as base:
        base.execute('CREATE TABLE word (id INTEGER PRIMARY KEY, "text" TEXT, "score of" REAL, raw BLOB)')
        base.executemany("INSERT INTO word VALUES (?, ?, ?, ?)", [(i * 3, None if i % 7 == 0 else f"w{i}", i / 4, bytes([i % 256])) for i in range(1, 500)])
        base.execute("CREATE TABLE empty_one (a INTEGER)")
    df = sqlite.read_table(spark, path, "word", 5)
    assert df.dtypes == [("id", "bigint"), ("text", "string"), ("score of", "double"), ("raw", "binary")]
    got = sorted(df.collect())
    assert len(got) == 499 and got[6].text is None and got[0].text == "w1" and got[3]["score of"] == 1.0
    assert df.rdd.getNumPartitions() == 5 and df.where("id % 2 = 0").count() == 249
    assert sqlite.read_table(spark, path, "empty_one").count() == 0


def test_ground_truth_round_trip(spark, tmp_path):
    rows = [("a", 1, "1:1", "one two"), ("a", 0, "1:2", "three"), ("b", 0, "2:1", "four")]
    files.write_ground_truth(spark.createDataFrame(rows, "file string, line_no int, verse_key string, words string"), f"{tmp_path}/out")
    back = files.read_ground_truth(spark, f"{tmp_path}/out/*").select(F.regexp_extract("file", "file=([^/]+)", 1).alias("f"), "verse_key", "words").collect()
    assert sorted(map(tuple, back)) == [("a", "1:1", "one two"), ("a", "1:2", "three"), ("b", "2:1", "four")]


def test_manifest_and_jobs(spark, tmp_path):
    entries = [{"id": "20", "name": "A", "file": "a.json", "language": " "}, {"id": "x", "name": "B", "file": "b.json"}, {"id": "21", "name": "C", "file": "../c.json"}, {"id": "22", "name": "D", "file": "d.json", "language": "ur"}]
    (tmp_path / "manifest.json").write_text(json.dumps(entries))
    got = files.read_manifest(spark, f"{tmp_path}/manifest.json")
    assert sorted(map(tuple, got.collect())) == [("20", "A", "a.json", "English"), ("22", "D", "d.json", "ur")]
    assert files.read_manifest(spark, f"{tmp_path}/manifest.json", public=True).count() == 0
    for n, text in enumerate(['{"id": "j1", "createdAt": 5, "state": "done"}', "not json", '{"id": "j2", "createdAt": 9, "state": "queued"}', "{}"]):
        (tmp_path / f"jobs/{n}").mkdir(parents=True)
        (tmp_path / f"jobs/{n}/job.json").write_text(text)
    jobs = files.read_jobs(spark, f"{tmp_path}/jobs").orderBy(F.desc("created_at")).collect()
    assert [tuple(j) for j in jobs] == [("j2", 9, "queued"), ("j1", 5, "done")]
    assert files.read_optional_json(spark, f"{tmp_path}/none.json", "a int").count() == 0


def test_change_feed(spark):
    shape = "token string, next_token string, number long, snapshot boolean, entries array<struct<resource_id: string, type: string>>"
    pages = spark.createDataFrame([
        (None, "t1", 1, True, [("a", "CREATE"), ("b", "CREATE")]), ("t1", "t2", 2, False, [("a", "UPDATE")]), ("t2", "t3", 3, False, [("b", "DELETE"), ("c", "CREATE")]), ("t3", "t4", 4, False, []),
    ], shape)
    entries, token = changes.read_feed(pages, None)
    assert token == "t4" and [r.type for r in entries.orderBy("sequence").collect()] == ["CREATE", "CREATE", "UPDATE", "DELETE", "CREATE"]
    entries, token = changes.read_feed(pages, "t2")
    assert token == "t4" and [(r.resource_id, r.type) for r in entries.orderBy("sequence").collect()] == [("b", "DELETE"), ("c", "CREATE")]
    assert changes.read_feed(pages, "forgotten")[0].count() == 5
    entries, token = changes.read_feed(pages, "t4")
    assert entries.count() == 0 and token == "t4"
    assert {tuple(r) for r in changes.reduce_mutations(changes.read_feed(pages, None)[0]).select("resource_id", "type").collect()} == {("a", "UPDATE"), ("b", "DELETE"), ("c", "CREATE")}
