"""Table operators on nulls, ties, repeated rows and empty tables."""

from pyspark.sql import functions as F

from strandline.operators import tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_updates(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([("x", 2), ("y", 3)], "v string, k int")
    assert rows(tables.upsert(held, new, ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(tables.upsert(held, new, ["k"], insert=False)) == [(1, "a"), (2, "x")]
    assert rows(tables.upsert(held, new.limit(0), ["k"])) == rows(held)
    assert rows(tables.without_keys(held, new, ["k"])) == [(1, "a")]
    assert rows(tables.restated(held, "v", {"a": "z", "q": "r"})) == [(1, "z"), (2, "b"), (2, "c")]
    assert rows(tables.overridden(held, ["k"], new, "v", F.lit("!"))) == [(1, "a"), (2, "!"), (2, "!")]


def test_lookups_and_bounds(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 7), (None, 9)], "k int, v int")
    assert rows(tables.looked_up(left, right, ["k"])) == [(1, 5), (1, 7)]
    assert rows(tables.looked_up(left, right, ["k"], {"v": 0})) == sorted([(1, 5), (1, 7), (2, 0), (None, 0)], key=repr)
    line = spark.createDataFrame([("a", n, f) for n, f in enumerate("nynynyn")] + [("b", 1, "n")], "k string, n int, f string")
    spans = tables.bounds(line, ["k"], "n", F.col("f") == "y")
    assert rows(spans) == [("a", 1, 5, 3)]
    assert [r.n for r in tables.covered(line, spans, ["k"], "n").where("covered").collect()] == [1, 2, 3, 4, 5]
    assert rows(tables.skipped_inside(line, ["k"], "n", F.col("f") == "y")) == [("a", 2, "n"), ("a", 4, "n")]
    points = spark.createDataFrame([("a", at) for at in (-7, 0, 5, 10, 11)], "k string, at long")
    held = spark.createDataFrame([("a", "s", 0, 10), ("a", "t", 10, 10), ("b", "u", 0, 99)], "k string, id string, start long, end long")
    assert sorted((r["at"], r.id) for r in tables.points_in_spans(points, held, ["k"], "at", 4).collect()) == [(0, "s"), (5, "s"), (10, "s"), (10, "t")]
    owners = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "x")], "o int, i string")
    assert rows(tables.missing_somewhere(owners, "o", "i")) == [("y", 2)]
    assert tables.missing_somewhere(owners.limit(0), "o", "i").count() == 0


def test_rankings_and_budgets(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 9), ("b", 4, 99)], "k string, n int, s int")
    assert [(r.k, r.n, r.place) for r in tables.ranked(df, ["k"], [F.desc("n")], 2).orderBy("k", "place").collect()] == [("a", 3, 1), ("a", 2, 2), ("b", 4, 1)]
    assert rows(tables.within_budget(df, ["k"], [F.asc("n")], "s", 8)) == [("a", 1, 5), ("a", 2, 3)]
    assert rows(tables.within_budget(df, ["k"], [F.asc("n")], "s", 8, True)) == [("a", 1, 5), ("a", 2, 3), ("b", 4, 99)]
    assert rows(tables.last_entries(df, "k", "n", ["s"])) == [("a", 9), ("b", 99)]
    assert rows(tables.next_around(df, ["k"], "n", 2, 7)) == [("a", 2), ("b", 4)]
    assert rows(tables.next_around(df, ["k"], "n", 5, 7)) == [("a", 1), ("b", 4)]


def test_verdicts(spark):
    df = spark.createDataFrame([(None, None, 1, 5), (1, 5, 1, 5), (2, 4, 1, 5), (0, 4, 1, 5)], "a int, b int, c int, d int")
    assert [r.v for r in df.select(tables.range_verdict(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v")).collect()] == ["none", "exact", "partial", "wrong"]
    parts = spark.createDataFrame([(None, 1), (1, None), (1, 2), (2, 1), (2, 2)], "a int, b int")
    assert [r.v for r in parts.select(tables.gap_verdict(F.col("a"), F.col("b")).alias("v")).collect()] == ["missing", "wrong", "merge", "split", "match"]
    half = spark.createDataFrame([(True,), (False,)], "hit boolean")
    assert half.agg(tables.share_agrees(F.col("hit"), (1, 2)).alias("v"), tables.share_agrees(F.col("hit"), (1, 2), True).alias("w")).first() == (True, False)
    synced = spark.createDataFrame([("a", 0), ("b", 9), ("c", None)], "k string, t long")
    assert rows(tables.stale(synced, ["k"], "t", spark.createDataFrame([(10,)], "now long"), 5)) == [("a", True), ("b", False), ("c", True)]
    lit = lambda *x: [F.lit(v) for v in x]
    view = spark.range(1).select(*tables.view_window(*lit(0, 10, 0, 10), 3, 1), *tables.view_window(*lit(4, 6, 0, 10), 3, 1), tables.edge_label(*lit("A", "A", 1, 3)), tables.edge_label(*lit("A", "B", 1, 3))).first()
    assert tuple(view) == (None, 10, 1, 9, "A 1-3", "A1 B3")
