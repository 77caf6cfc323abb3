"""The phrase search against all segmentations, on small cases and on stated ones."""

import random

import pytest

from strandline.operators import phrases

READINGS = "id int, i long, j long, first long, last long, score double"


def search(spark, cases, rules, parts=3):
    rows = [(k, i, j, a, b, s) for k, case in enumerate(cases) for i, j, a, b, s in case]
    out = phrases.assigned_phrases(spark.createDataFrame(rows, READINGS).repartition(parts), ["id"], rules).collect()
    return [sorted((r.i, r.j, r.first, r.last, r.score) for r in out if r.id == k) for k in range(len(cases))]


def explained(claimed):
    return sum(s * (b - a + 1) for *_, a, b, s in claimed)


def every_route(case, rules):
    """(explained, phrases used) of all routes, by plain recursion over spans; sets of words instead of bits."""
    ends = {(i, j) for i, j, *_ in case}
    last_boundary = max(j for _, j in ends)

    def walk(i, reached, said, total, used):
        if i == last_boundary:
            yield total, used
            return
        for a, j in sorted(ends):
            if a != i:
                continue
            options = [(f, e, s) for x, y, f, e, s in case if (x, y) == (i, j) and f is not None]
            fit = []
            for f, e, s in options:
                behind = [w for w in range(f, min(e, reached) + 1)]
                unsaid = sum(w not in said for w in behind)
                if s >= rules.least and (e > reached or s >= rules.again) and 2 * unsaid <= len(behind):
                    fit.append((f, e, s))
            for f, e, s in fit:
                yield from walk(j, e, said | set(range(f, e + 1)), total + s * (e - f + 1), used + 1)
            if not fit or any(f > reached + 1 for f, _, _ in fit):
                yield from walk(j, reached, said, total, used + 1)

    return walk(0, rules.heard_before - 1, set(range(rules.heard_before)), 0, 0)


def random_case(rng, size):
    case = []
    for i in range(size):
        case.append((i, i + 1, None, None, None))
        for _ in range(rng.randrange(3)):
            first = rng.randrange(14)
            case.append((i, i + 1, first, first + rng.randrange(4), rng.choice([0.25, 0.5, 0.75, 1.0])))
        if i + 1 < size and rng.random() < 0.4:
            first = rng.randrange(14)
            case.append((i, i + 2, first, first + rng.randrange(6), rng.choice([0.5, 1.0])))
    return case


@pytest.mark.parametrize("heard", [0, 3])
def test_search_equals_all_segmentations(spark, heard):
    """One best route for each place is enough unless what was said differs; so totals are bounded by all routes, and nearly always equal."""
    rules = phrases.Rules(beam=1000, heard_before=heard)
    rng = random.Random(heard)
    cases = [random_case(rng, rng.randrange(1, 6)) for _ in range(120)]
    got = search(spark, cases, rules)
    best = [max(every_route(case, rules)) for case in cases]
    totals = [explained(g) for g in got]
    assert all(t <= b[0] for t, b in zip(totals, best))
    assert sum(t == b[0] for t, b in zip(totals, best)) >= 118
    for claimed in got:
        assert all(x[1] <= y[0] for x, y in zip(claimed, claimed[1:]))


def test_a_jump_ahead_does_not_win_over_the_words_it_skips(spark):
    """A short reading far ahead, after which the skipped words are said: the jump is left unclaimed."""
    case = [(0, 1, 0, 1, 1.0), (1, 2, 29, 29, 0.97), (2, 3, 3, 15, 0.96), (3, 4, 16, 27, 0.9), (4, 5, 28, 30, 1.0)]
    merged = [*case, (1, 3, 2, 15, 0.95)]
    got = search(spark, [case, merged], phrases.Rules())
    assert [(a, b) for *_, a, b, _ in got[0]] == [(0, 1), (3, 15), (16, 27), (28, 30)]
    assert [(a, b) for *_, a, b, _ in got[1]] == [(0, 1), (2, 15), (16, 27), (28, 30)]


def test_claims_of_repeats():
    at = lambda said, reached: phrases.Route(0, 0, sum(1 << w for w in said), reached, phrases.Step(None, None))
    rules = phrases.Rules()
    assert not phrases.claims(at({0, 1, 29}, 29), 3, 15, 0.96, rules)
    assert phrases.claims(at(range(9), 8), 5, 12, 0.95, rules)
    assert phrases.claims(at({0, 1, 5, 6, 7}, 7), 2, 10, 0.90, rules)
    assert phrases.claims(at(range(9), 8), 6, 8, 1.0, rules) and not phrases.claims(at(range(9), 8), 6, 8, 0.7, rules)
    assert not phrases.claims(at(range(9), 8), 9, 9, 0.4, rules)


def test_long_recordings_are_given_out_as_they_settle():
    """What is given out early is what the whole history would give, and it comes before the end."""
    rng = random.Random(6)
    case = [(i, i + 1, max(0, i - rng.randrange(3)), i + rng.randrange(3), rng.choice([0.5, 0.75, 1.0])) for i in range(600)]
    case += [(i, i + 1, i + 1, i + 2, 0.5) for i in range(0, 600, 3)] + [(i, i + 2, i, i + 3, 0.75) for i in range(0, 598, 5)]
    rows = sorted((("k", *r) for r in case), key=lambda r: r[1:5])

    def fold(settle):
        step, end = phrases.search_fold(1, phrases.Rules(), settle)(rows[0])
        early = [out for row in rows for out in step(row)]
        return early, early + list(end())

    (early, eager), (nothing, lazy) = fold(5), fold(10**9)
    assert eager == lazy and len(early) > len(lazy) / 2 and not nothing


def test_no_rows(spark):
    assert search(spark, [[]], phrases.Rules()) == [[]]
    assert search(spark, [[(0, 1, None, None, None)]], phrases.Rules()) == [[]]
