"""Levels, placed spans, adopted words and sweeps against plain loops."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from strandline.operators import timing


def test_levels_equal_a_sort_of_each_frame(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.choice([None, -95.0, -90.0, *[rng.uniform(-80, 0)] * 4])) for k in range(3) for n in range(rng.randrange(0, 90))]
    df = spark.createDataFrame(rows, "k int, n long, level double").repartition(4)
    for reach, share in ((1, 0.5), (5, 0.7), (40, 0.03), (7, 1.0)):
        got = {(r.k, r.n): r.around for r in timing.levels_around(df, ["k"], "n", "level", reach, share).collect()}
        assert len(got) == len(rows)
        for k, n, _ in rows:
            near = sorted(v for j, m, v in rows if j == k and n - reach <= m < n + reach and v is not None and v > -90)
            assert got[k, n] == (near[min(int(len(near) * share), len(near) - 1)] if near else -90.0)


def test_placed_spans_equal_two_passes(spark):
    rng = random.Random(5)
    rows = []
    for k in range(8):
        at, unit = 0, 0
        for n in range(rng.randrange(1, 30)):
            unit += rng.random() < 0.5
            start = at + rng.randrange(-300, 300)
            at += 200
            rows.append([k, n, start, start + rng.randrange(0, 400), unit])
    spans = {(k, u): rng.choice([None, (lo := 200 * u + rng.randrange(-300, 300), lo + rng.randrange(50, 600))]) for k, u in {(r[0], r[4]) for r in rows}}
    table = [(*r, r[4] % 2 == 0, *(spans[r[0], r[4]] or (None, None))) for r in rows]
    got = {(r.k, r.n): (r.start, r.end) for r in timing.placed_spans(spark.createDataFrame(table, "k int, n int, start long, end long, unit int, opens boolean, low long, high long"), ["k"], 40).collect()}
    for k in range(8):
        mine = [list(r) for r in table if r[0] == k]
        for i, (_, n, start, end, unit, opens, low, high) in enumerate(mine):
            if low is not None:
                first, last = i == 0 or mine[i - 1][4] != unit, i == len(mine) - 1 or mine[i + 1][4] != unit
                mine[i][2] = low if first and opens else min(max(start, low), high)
                mine[i][3] = high if last else min(max(end, low), high)
        before = None
        for i, (_, n, start, end, *_) in enumerate(mine):
            start = start if before is None else max(start, before)
            following = mine[i + 1][2] if i + 1 < len(mine) else end
            before = start
            assert got[k, n] == (start, max(start + 40, min(end, max(following, start + 40))))


PHRASES = "k int, n int, verse string, first int, last int, words array<string>, said array<string>, between array<string>, between_verses array<string>, closes boolean, opens_word boolean"


def test_adopted_words(spark):
    """The neighbour that loses least takes the words; then stretches, closing words, verses and lengths decide."""
    a, b, c = ["a1", "a2", "a3"], ["b1", "b2", "b3"], ["x"]
    ratio = lambda said, words: SequenceMatcher(None, said, words).ratio()

    def pair(said_a, said_b, between=c, verse_b="v", closes=False, opens=None, verses=("v",)):
        return [("v", 0, 2, a, said_a, [], [], False, None), (verse_b, 3 + len(between), 5 + len(between), b, said_b, between, list(verses) * len(between), closes, opens)]

    cases = [
        pair(a + c, b), pair(a, c + b), pair(a, b), pair(a, c + b, closes=True), pair(a + c, b, opens=True), pair(a, c + b, opens=False), pair(a, c + b, verse_b="w"), pair(a, b, verses=("u",)),
        pair(a, b, between=["x"] * 5),
    ]
    rows = [(k, n, *r) for k, case in enumerate(cases) for n, r in enumerate(case)]
    got = [sorted((r.n, r.first, r.last, r.score) for r in timing.adopted_words(spark.createDataFrame(rows, PHRASES), ["k"]).where(F.col("k") == k).collect()) for k in range(len(cases))]
    back, on, none = [(0, 3), (4, 6)], [(0, 2), (3, 6)], [(0, 2), (4, 6)]
    assert [[x[1:3] for x in g] for g in got] == [back, on, back, back, on, back, back, none, [(0, 2), (8, 10)]]
    assert got[0][0][3] == 1.0 and got[2][0][3] == ratio(a, a + c) and got[4][1][3] == ratio(b, c + b)


def test_words_taken_count_on_the_other_side(spark):
    """The middle phrase is as long as allowed once it has taken the first words, so the last ones go on."""
    words = ["w"] * 20
    rows = [(0, 0, "v", 0, 0, ["a"], ["z"], [], [], False, None), (0, 1, "v", 3, 22, words, ["x", "y", *words], ["x", "y"], ["v", "v"], False, None), (0, 2, "v", 24, 24, ["b"], ["z"], ["q"], ["v"], False, None)]
    got = {r.n: (r.first, r.last) for r in timing.adopted_words(spark.createDataFrame(rows, PHRASES), ["k"]).collect()}
    assert got == {0: (0, 0), 1: (1, 22), 2: (23, 24)}


def test_sweep_reads_the_evidence_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, n, n % 7, rng.uniform(0, 3)) for k in range(4) for n in range(40)]
    spark.createDataFrame(rows, "k int, n int, w int, gap double").write.parquet(f"{tmp_path}/evidence")
    evidence = spark.read.parquet(f"{tmp_path}/evidence")

    def lines(k, bar):
        out, first = [], 0
        mine = [r for r in rows if r[0] == k]
        for n, r in enumerate(mine):
            if r[3] >= bar or n == len(mine) - 1:
                out.append((k, mine[first][2], r[2]))
                first = n + 1
        return out

    expected = [line for k in range(4) for line in lines(k, 2.0)]
    wanted = spark.createDataFrame(expected, "k int, first_w int, last_w int")
    grid = {f"bar {b}": {"bar": b} for b in (0.5, 1.0, 2.0, 9.0)}
    sweep = lambda g: timing.swept(evidence, wanted, ["k"], g, lambda v: F.col("gap") >= v["bar"])
    got = {r.setting: (r.hits, r.predicted) for r in sweep(grid).collect()}
    for name, values in grid.items():
        found = [line for k in range(4) for line in lines(k, values["bar"])]
        assert got[name] == (sum(min(found.count(x), expected.count(x)) for x in set(found)), len(found))
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    assert scans(sweep(grid)) == scans(sweep({f"{i}": {"bar": float(i)} for i in range(50)}))


def test_sweeps_do_not_multiply_the_evidence(spark):
    evidence = spark.range(600).selectExpr("id % 5 AS k", "id AS n", "IF(id % 11 = 3, NULL, id % 7) AS w", "IF(id % 13 = 0, NULL, id * 37 % 100) AS gap")
    wanted = evidence.where("n % 9 = 0").selectExpr("k", "w AS first_w", "(w + 2) % 7 AS last_w")
    grid = {f"s{i}": {"bar": float(i)} for i in range(0, 120, 10)}
    found = timing.swept(evidence, wanted, ["k"], grid, lambda v: F.col("gap") >= v["bar"])
    words, expected = {}, {}
    for r in evidence.orderBy("n").collect():
        words.setdefault(r.k, []).append((r.w, r.gap))
    for r in wanted.collect():
        expected.setdefault(r.k, []).append((r.first_w, r.last_w))
    got = {r.setting: (r.hits, r.predicted) for r in found.collect()}
    for setting, values in grid.items():
        hits = many = 0
        for k, line in words.items():
            lines, first = [], 0
            for i, (_, gap) in enumerate(line):
                if i == len(line) - 1 or (gap is not None and gap >= values["bar"]):
                    lines.append((line[first][0], line[i][0]))
                    first = i + 1
            many += len(lines)
            hits += sum(min(lines.count(x), expected[k].count(x)) for x in set(lines) if None not in x)
        assert got[setting] == (hits, many)
    assert timing.swept(evidence.limit(0), wanted, ["k"], grid, lambda v: F.col("gap") >= v["bar"]).count() == 0
    # one sort of the evidence, before it becomes rows of lines; no join with what was expected
    plan = found.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Sort [") == 1 and plan.index("Generate explode(array_distinct") < plan.index("Sort [")
