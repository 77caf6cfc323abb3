import random

from strandline.operators import intervals


def brute_merge(spans, gap):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_merge_and_complement(spark):
    random.seed(2)
    spans = [(a := random.randint(0, 300), a + random.randint(0, 12)) for _ in range(60)]
    df = spark.createDataFrame([(1, a, b) for a, b in spans], "k int, start long, end long")
    merged = sorted((r.start, r.end) for r in intervals.coalesce_spans(df, ["k"], 2).collect())
    assert merged == brute_merge(spans, 2)
    whole = brute_merge(spans, 0)
    assert sorted((r.start, r.end) for r in intervals.complement(df, ["k"]).collect()) == [(x[1], y[0]) for x, y in zip(whole, whole[1:])]


def test_overlap_join_is_open_and_counts_once(spark):
    random.seed(3)
    left = [(i, a := random.randint(0, 200), a + random.randint(1, 60)) for i in range(40)]
    right = [(i, a := random.randint(0, 200), a + random.randint(1, 60)) for i in range(40)] + [(99, left[0][2], left[0][2] + 5)]
    a = spark.createDataFrame([(1, *r) for r in left], "k int, i int, l_start long, l_end long")
    b = spark.createDataFrame([(1, *r) for r in right], "k int, j int, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["k"], 25).collect())
    assert got == sorted((i, j) for i, s, e in left for j, x, y in right if e > x and s < y)


def test_asof_takes_the_last_at_or_before(spark):
    a = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t long")
    b = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (1, 11, "z")], "k int, t long, v string")
    assert sorted((r.k, r.t, r.v) for r in intervals.asof_join(a, b, "k", "t", "v").collect()) == [(1, 5, "x"), (1, 10, "y"), (2, 1, None)]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, start long, end long")
    assert intervals.coalesce_spans(df, ["k"]).count() == 0
    assert intervals.complement(df, ["k"]).count() == 0
