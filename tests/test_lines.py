"""Line operators on edges, repeats, ties and empty tables."""

import pytest

from pyspark.sql import functions as F

from strandline.operators import lines


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame([("k", i, s) for i, s in enumerate("NAABNBBAN")] + [("m", 0, "A")], "k string, i int, s string").repartition(3)


def test_paths(spark, path):
    assert rows(lines.path_spans(path, ["k"], ["i"], "s", "N")) == [("k", "A", 2, 4), ("k", "A", 8, 9), ("k", "B", 4, 5), ("k", "B", 6, 8), ("m", "A", 1, 2)]
    assert rows(lines.collapsed(path, ["k"], ["i"], "s", "N")) == [("k", 2, "A"), ("k", 4, "B"), ("k", 6, "B"), ("k", 8, "A"), ("m", 1, "A")]
    assert rows(lines.least_frames(path, ["k"], ["i"], "s")) == [("k", 11), ("m", 1)]
    assert lines.path_spans(path.limit(0), ["k"], ["i"], "s", "N").count() == 0


def test_neighbours(spark, path):
    near = lines.with_neighbour(path, ["k"], ["i"], ["s"], 2, "on_")
    assert {r.i: r.on_s for r in near.where("k = 'k'").collect()} == {i: ("NAABNBBAN" + "  ")[i + 2].strip() or None for i in range(9)}
    assert rows(lines.twins(path, ["k"], "i", ["s"], 2)) == [("k", 3, 5)]
    assert rows(lines.first_of(path, ["k"], -F.col("i"), ["i", "s"], F.col("s") != "N")) == [("k", 7, "A"), ("m", 0, "A")]
    turns = spark.createDataFrame([(1, 0, "u"), (1, 1, "a"), (1, 2, "u"), (2, 0, "a")], "c int, t int, role string")
    assert rows(lines.swapped_turns(turns, ["c"], "t", "role", "u")) == [(1, 0, "u", "a"), (1, 1, "a", "u"), (1, 2, "u", "u"), (2, 0, "a", "a")]
    gaps = spark.createDataFrame([(1, 1), (1, 2), (1, 5), (1, 5)], "k int, n int")
    assert rows(lines.seams(gaps, ["k"], ["n"], "n")) == [(1, 3, 5)]


def test_peaks_and_levels(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([1, -9, 3, 4, 5, -2, 7])] + [("a", -1, 100)], "k string, t long, v long")
    fine = lines.peaks(df, ["k"], "t", "v", 2)
    assert rows(fine) == [("a", -1, 100, 1), ("a", 0, 9, 2), ("a", 1, 4, 2), ("a", 2, 5, 2), ("a", 3, 7, 1)]
    assert rows(lines.wider_peaks(fine, ["k"], 2)) == [("a", -1, 100, 1), ("a", 0, 9, 4), ("a", 1, 7, 3)]
    assert rows(lines.hop_energy(df.where("t >= 0"), ["k"], ["t"], "v", 3)) == [("a", 0, 91), ("a", 1, 45)]
    cut = spark.createDataFrame([("a", 0, 5), ("a", 0, 1), ("a", 10, 0), ("b", 3, 2)], "k string, t long, cut long")
    assert rows(lines.cut_before(cut, ["k"], "t", "cut")) == [("a", 0, 1, 0), ("a", 0, 5, 0), ("a", 10, 0, 4), ("b", 3, 2, 3)]
    clamp = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 30)], "k string, n int, v int")
    assert [(r.start_v, r.end_v) for r in lines.forward_clamp(clamp, ["k"], ["n"], "v", 10).orderBy("n").collect()] == [(5, 5), (5, 15), (30, 40)]


def test_spans(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 5, 7), (3, 8, 20), (4, 5, 8)], "id int, s long, e long")
    assert rows(lines.split_at(df, "s", "e", 7).select("id", "part", "a", "b")) == [(1, 0, 0, 7), (1, 1, 7, 10), (2, 0, 5, 7), (3, 0, 8, 20), (4, 0, 5, 7), (4, 1, 7, 8)]
    assert rows(lines.retimed(df, "s", "e", 0, (1, 2), 3).select("id", "a", "b")) == [(1, 0, 5), (3, 4, 10)]


def test_values(spark):
    heads = spark.createDataFrame([("bytes=0-9", 5), ("bytes=3-", 5), ("bytes=7-8", 5), ("bytes=2-3", 5), ("items=1-2", 5), (None, 5)], "h string, n long")
    got = [tuple(r.r) for r in heads.select(lines.byte_range(F.col("h"), F.col("n")).alias("r")).collect()]
    assert got == [(True, 0, 4), (True, 3, 4), (False, 7, 4), (True, 2, 3), (None, None, None), (None, None, None)]
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "i int, n string")
    assert [r.unique for r in lines.numbered_name(names, "n", "i").orderBy("i").collect()] == ["a", "b", "a-2", "a-3"]
    one = spark.range(1).select(
        lines.suffixed(F.lit("x/y.mov"), "_s"), lines.suffixed(F.lit("x.y/z"), "_s"), lines.kind_of(F.lit("a.mp4"), {"video": ("mp4",)}, "page"), lines.kind_of(F.lit("mp4"), {"video": ("mp4",)}, "page"),
        lines.tenths_code(F.lit(6059)), lines.digits(F.lit("a10"), "abcdefghij"), lines.chunk_plan(F.lit(999), 1000), lines.chunk_plan(F.lit(2500), 1000),
    ).first()
    assert tuple(one) == ("x/y_s", "x.y/z_s", "video", "page", "10:05.9", "aba", (1, 0, 999), (2, 1000, 2500))


def test_stretches_are_dealt_into_all_partitions(spark):
    rows = spark.range(4000).selectExpr("id % 997 AS k", "id AS place", "CAST(id % 3 AS STRING) AS v")
    for found in (lines.equal_stretches(rows, ["k"], "place", "v"), lines.path_spans(rows, ["k"], ["place"], "v", "-")):
        # merged by their bytes these few rows would be one partition, and with them a task's memory grows
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
