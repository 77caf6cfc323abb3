"""Caption breaks on stated cases, and the repair of lone words against a plain loop."""

import random

import pytest

from pyspark.sql import functions as F

from strandline.operators import captions

BARS = captions.Bars(
    shortest=0.15, marked=0.16, unmarked=0.32, borderline=0.20, hesitation=0.22, hesitation_factor=2.0, restart=0.30, inset=0.10, vowel_inset=0.30, joined=0.40, held_factor=1.5, reach=0.15, near=0.10
)
WORDS = "id int, n long, verse string, w long, start double, end double, mark boolean, hanging boolean, sustained boolean, drops boolean, again boolean"


def lines(spark, cases, pauses, phrase_ends=None, hush=None, bars=BARS):
    """cases: per id a list of (verse, w, start, end, flags); gives per id the captions as (verse, first, last)."""
    rows = [(i, n, v, w, a, b, *(f in flags for f in captions.FLAGS)) for i, case in enumerate(cases) for n, (v, w, a, b, *flags) in enumerate(case)]
    spans = lambda part: spark.createDataFrame([(i, *map(float, p)) for i, ps in enumerate(part) for p in ps], "id int, start double, end double")
    ends = None if phrase_ends is None else spark.createDataFrame([(i, w, float(at)) for i, es in enumerate(phrase_ends) for at, w in es], "id int, w long, at double")
    out = captions.captions(spark.createDataFrame(rows, WORDS).repartition(3), spans(pauses), ["id"], bars, 1, ends, None if hush is None else spans(hush)).orderBy("id", "caption").collect()
    return [[(r.verse, r.first_w, r.last_w) for r in out if r.id == i] for i in range(len(cases))], out


def test_lone_words_restarts_and_last_words(spark):
    lone = [("a", 8, 0.95, 1.04), ("a", 9, 1.35, 2.15), ("a", 10, 3.19, 4.15), ("a", 11, 4.31, 5.34), ("a", 12, 5.42, 6.06)]
    again = [("b", 3, 0.0, 0.8), ("b", 4, 0.9, 1.8, "mark"), ("b", 4, 2.6, 3.3, "mark"), ("b", 5, 4.0, 4.4), ("b", 6, 4.5, 5.0)]
    last = [("c", 13, 41.71, 42.27), ("c", 14, 42.51, 42.59), ("c", 15, 42.98, 44.98)]
    pauses = [[(2.5, 3.24), (3.58, 3.78), (3.9, 4.3), (5.54, 5.72)], [(1.9, 2.5), (3.4, 3.9)], [(43.06, 43.42)]]
    got, rows = lines(spark, [lone, again, last], pauses, bars=captions.SECONDS)
    assert got == [[("a", 8, 9), ("a", 10, 12)], [("b", 3, 4), ("b", 4, 4), ("b", 5, 6)], [("c", 13, 15)]]
    assert [r.restart for r in rows if r.id == 1] == [False, True, False]


def test_short_stops_need_the_phrase_end_and_the_gap(spark):
    words = [("d", 4, 3.83, 3.91), ("d", 5, 4.47, 5.18), ("d", 6, 5.26, 6.30), ("d", 7, 6.70, 7.82), ("d", 8, 7.89, 8.61)]
    close = [*words[:3], ("d", 7, 6.38, 7.82), words[4]]
    stop = [(6.48, 6.72)]
    got, _ = lines(spark, [words, words, words, close], [stop] * 4, [[], [(6.59, 6)], [(6.59, 7)], [(6.59, 6)]], bars=captions.SECONDS)
    whole = [("d", 4, 8)]
    assert got == [whole, [("d", 4, 6), ("d", 7, 8)], whole, whole]


def test_marks_hanging_words_and_held_sounds(spark):
    pair = lambda gap, *flags: [("e", 0, 0.0, 1.0), ("e", 1, 1.1, 2.0, *flags), ("e", 2, 2.0 + gap, 4.0), ("e", 3, 4.05, 5.0)]
    cases = [pair(0.3), pair(0.3, "mark"), pair(0.3, "mark", "sustained"), pair(0.6, "hanging"), pair(0.6), pair(0.38, "sustained"), pair(0.38), pair(0.3, "mark")]
    pauses = [[], [], [], [(2.0, 2.6)], [(2.0, 2.6)], [(2.0, 2.38)], [(2.0, 2.38)], []]
    hush = [[(0.0, 9.0)]] * 7 + [[(8.0, 9.0)]]
    got, rows = lines(spark, cases, pauses, hush=hush)
    whole, two = [("e", 0, 3)], [("e", 0, 1), ("e", 2, 3)]
    assert got == [whole, two, whole, whole, two, whole, two, whole]
    assert [(r.id, r.caption) for r in rows if r.to_check] == [(1, 0)]


def test_words_pushed_into_a_pause_before_a_restart(spark):
    words = [("f", 0, 24.0, 24.6), ("f", 1, 24.64, 25.20), ("f", 2, 25.3, 25.5), ("f", 0, 25.7, 26.2), ("f", 1, 26.3, 27.0)]
    got, _ = lines(spark, [words], [[(25.22, 25.6)]])
    assert got == [[("f", 0, 2), ("f", 0, 1)]]


def plain_taken_back(cuts):
    """cuts: (n, joins, quiet, gap) in order. Take back one cut at a time, starting over each time, as the rule is stated."""
    stops, taken = {n: (quiet, gap) for n, _, quiet, gap in cuts}, set()
    joins = {n: j for n, j, _, _ in cuts}
    while True:
        left = sorted(set(stops) - taken)
        lone = [(a, b) for a, b in zip(left, left[1:]) if b == a + 1 and joins[a] and joins[b]]
        if not lone:
            return taken
        a, b = lone[0]
        taken.add(a if stops[a] <= stops[b] else b)


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_back_equals_the_stated_rule(spark, seed):
    rng = random.Random(seed)
    rows, want = [], set()
    for key in range(40):
        mine, at = [], 0.0
        for n in range(30):
            gap = rng.choice([0.0, 0.5, 0.5, 1.0, 2.0])
            mine.append((key, n, rng.random() < 0.75, rng.random() < 0.85, gap, at, at + 10, at + 10 + gap))
            at += 10 + gap
        rows += mine
        want |= {(key, n) for n in plain_taken_back([(n, joins, gap, gap) for _, n, cut, joins, gap, *_ in mine if cut])}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, n long, cut boolean, joins boolean, gap double, start double, end double, next_start double")
    pauses = df.where("gap > 0").select("id", F.col("end").alias("start"), F.col("next_start").alias("end"))
    bars = captions.Bars(**(vars(BARS) | {"inset": 0.0}))
    for parts in (1, 5):
        got = {(r.id, r.n) for r in captions.taken_back(df.repartition(parts), pauses, ["id"], bars, 4).collect()}
        assert got == want
    assert len(want) > 100


def test_empty_tables(spark):
    got, rows = lines(spark, [[]], [[]], [[]])
    assert got == [[]] and rows == []
