"""Folds, phrase location, text functions, files and streams against plain loops."""

import json
import os
import random

import pytest

from strandline.functions import text as text_functions
from strandline.operators import folds, location
from strandline.sources import files
from strandline.streaming import changes

DATA = "/root/testdata/sf0.001"


def test_rate_limiter(spark):
    rng = random.Random(1)
    rows = [(u, i, rng.randrange(10**6)) for i, u in enumerate(rng.choices([1, 2, 3], k=120))]
    got = {r.event_id: r.admitted for r in folds.rate_limited(spark.createDataFrame(rows, "user_id long, event_id long, t long"), 3, 100_000).collect()}
    for user in (1, 2, 3):
        kept = []
        for _, i, t in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            fine = sum(t - k < 100_000 for k in kept) < 3
            kept += [t] * fine
            assert got[i] == fine


def test_truncated_spans_do_not_overlap(spark):
    rng = random.Random(2)
    rows = [(1, s := rng.randrange(1000), s + rng.randrange(1, 90)) for _ in range(80)]
    out = sorted((r.start, r.end) for r in folds.truncated(spark.createDataFrame(rows, "user_id long, start long, end long"), 8).collect())
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:])) and all(e - s >= 8 for s, e in out)


def test_queue_has_room_and_caps(spark):
    rows = [(i, 10 * i, i % 2, 0) for i in range(12)]
    got = {r.event_id: r.verdict for r in folds.queue_replay(spark.createDataFrame(rows, "event_id long, t long, visitor long, queue long"), 3, 2, 1000).collect()}
    assert [got[i] for i in range(5)] == ["queued", "queued", "queued", "full", "full"]


def test_jump_alignment(spark):
    rows = [(1, "a b a b c".split(), "a b c".split()), (2, ["a"], ["a"]), (3, [], ["a", "b"]), (4, ["x"], [])]
    got = {r.key: r.cost for r in folds.jump_alignment(spark.createDataFrame(rows, "key long, heard array<string>, script array<string>"), 1).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: 1}


def test_location(spark):
    corpus = spark.createDataFrame([(1, "one two three four five six seven"), (2, "nothing here at all"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "three four five SIX"), (8, "unheard words only here"), (9, "")], "item_id long, text string")
    got = location.located(items, corpus, "item_id", "doc_id").collect()
    assert [(r["item"], r.doc, r.start, r.ratio) for r in got] == [(7, 1, 2, 1.0)]


def test_location_without_a_cap_misses_nothing(spark):
    """Many places share as many word triples as the best one; a cap drops it, the exact way finds it."""
    phrase = "a b c d e f g h"
    corpus = [(i, f"a b c d x{i} y{i} z{i} w{i}") for i in range(50)] + [(90, "a b c x e f x h")]
    docs, items = spark.createDataFrame(corpus, "doc_id long, text string"), spark.createDataFrame([(1, phrase)], "item_id long, text string")
    everything = {(r.doc, r.start) for r in location.candidate_votes(items, docs, "item_id", "doc_id", None).collect()}
    capped = {(r.doc, r.start) for r in location.candidate_votes(items, docs, "item_id", "doc_id", 40).collect()}
    assert len(capped) == 40 and capped < everything and (90, 0) in everything - capped
    assert location.located(items, docs, "item_id", "doc_id", 0.6, 40).count() == 0
    assert [(r.doc, r.ratio) for r in location.located(items, docs, "item_id", "doc_id", 0.6, None).collect()] == [(90, 0.75)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Café No. 1",), (None,), ("",)], "t string")
    got = df.select(text_functions.nfc("t").alias("a"), text_functions.hashtag("t").alias("b"), text_functions.digest36("t").alias("c")).collect()
    assert got[0].a == "Café No. 1" and got[0].b == "CafeNo1" and len(got[0].c) == 6 and got[1].a is None and got[2].b == ""


def test_files(spark, tmp_path):
    lines = ['{"surah": 2, "durationSec": 3.5, "aspectRatio": "9:16", "at": "2026-01-02T03:04:05Z"}', "", "{broken", '{"surah": "x", "durationSec": "y", "at": "2026-01-02T03:04:05Z"}', '{"surah": 1, "at": "never"}']
    (tmp_path / "counts.json").write_text("\n".join(lines))
    got = sorted(((r.surah, r.duration_sec) for r in files.read_counts(spark, str(tmp_path / "counts.json")).collect()), key=str)
    assert got == [(2, 3.5), (None, 0.0)]
    (tmp_path / "truth.txt").write_text("# clip: one\n# speaker: unknown\n1:1 a b\n\n1:2 c\n")
    assert [(r.line_no, r.verse_key, r.words) for r in files.read_ground_truth(spark, str(tmp_path / "truth.txt")).collect()] == [(2, "1:1", "a b"), (4, "1:2", "c")]
    assert [(r.fact, r.value) for r in files.read_facts(spark, str(tmp_path / "truth.txt")).collect()] == [("clip", "one")]
    path = str(tmp_path / "parts")
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    files.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_change_stream(spark, tmp_path):
    source, shape = tmp_path / "log", "sequence long, type string, resource_id string"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"sequence": s, "type": t, "resource_id": r}) for s, t, r in [(1, "CREATE", "x"), (3, "DELETE", "x"), (2, "CREATE", "y")]))
    for _ in range(2):
        changes.sync_changes(spark.readStream.schema(shape).json(str(source)), str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
        (source / "b.json").write_text(json.dumps({"sequence": 9, "type": "CREATE", "resource_id": "x"}))
    last = spark.read.parquet(str(tmp_path / "state/version=1"))
    assert sorted((r.resource_id, r.type) for r in last.collect()) == [("x", "CREATE"), ("y", "CREATE")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_streamed_peaks_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events*.parquet")
    query = changes.windowed_peaks(stream).writeStream.format("memory").queryName("peaks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("peaks").collect())) == sorted(map(tuple, changes.windowed_peaks(events).collect()))
