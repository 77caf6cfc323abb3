"""Levels by rank and quiet spans against sums in whole numbers, and the query against its SQL."""

import duckdb
import pytest

from strandline.operators import runs
from strandline.plans import run_queries

#: Sizes at which 0.7 x size in doubles falls under the whole number that it is, and others.
SIZES = [1, 9, 10, 20, 89, 90, 91, 170, 340, 650, 1290]


@pytest.fixture(scope="module")
def levels(spark):
    return spark.createDataFrame([(k, (n * 7919) % k * 1000) for k in SIZES for n in range(k)], "k int, v long")


def test_rank_levels_take_shares_as_written(levels):
    got = {r.k: (r.a, r.b, r.c) for r in runs.rank_levels(levels, ["k"], "v", {"a": 0.7, "b": 0.05, "c": 0.29}).collect()}
    for k in SIZES:
        line = sorted((n * 7919) % k * 1000 for n in range(k))
        assert got[k] == (line[k * 7 // 10], line[k * 5 // 100], line[k * 29 // 100])


def test_quiet_spans_take_shares_as_written(spark):
    rows = [(k, n, n * 1000) for k in SIZES for n in range(k)]
    got = {r.k: (r.start, r.end) for r in runs.quiet_spans(spark.createDataFrame(rows, "k int, n int, v long"), ["k"], "n", "v", 0, 0, 1, 1).collect()}
    assert got == {k: (0, k * 7 // 10) for k in SIZES if k * 7 // 10 > k * 5 // 100}


def test_rank_levels_count_missing_levels_last(spark):
    rows = [(1, None), (1, 5), (1, 3), (1, None), (2, None), (2, None), (3, 7)]
    got = {r.k: (r.a, r.b) for r in runs.rank_levels(spark.createDataFrame(rows, "k int, v long"), ["k"], "v", {"a": 0.25, "b": 0.5}).collect()}
    assert got == {1: (5, None), 2: (None, None), 3: (7, 7)}


@pytest.mark.parametrize("ts, value", [("t", "x"), ("t", "CASE WHEN h % 11 = 0 THEN NULL ELSE x END"), ("CASE WHEN h % 13 = 0 THEN NULL ELSE t END", "x")], ids=["whole", "no value", "no time"])
def test_quiet_spans_equal_their_sql(spark, tmp_path, ts, value):
    """Users of sizes at which a level one rank too low moves a span."""
    duck = duckdb.connect()
    duck.execute("""CREATE TABLE rows AS SELECT i AS event_id, u AS user_id, (i * 2654435761 + u * 40503) % 4294967291 AS h, TIMESTAMP '2024-01-01' + to_seconds(i * 7919 % 2000003) AS t,
        (i * 2654435761 + u * 40503) % 4294967291 % 25000 / 100 AS x FROM (SELECT row_number() OVER (ORDER BY u, j) - 1 AS i, u FROM range(150) a(u), range(340) b(j) WHERE j < [90, 170, 180, 330, 340][u % 5 + 1])""")
    duck.execute(f"COPY (SELECT event_id, {ts} AS ts, user_id, 'view' AS event_type, CAST({value} AS DOUBLE) AS value FROM rows) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = duck.execute(f'SELECT user_id, start, "end" FROM ({run_queries.ORACLES["quiet_spans"]}) x').fetchall()
    got = [tuple(r) for r in run_queries.quiet_spans(spark, str(tmp_path)).select("user_id", "start", "end").collect()]
    assert want and sorted(got) == sorted(want)
