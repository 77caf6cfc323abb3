"""Cleaning of published words against the rules told as a loop, and on stated cases."""

import random

import pytest

from strandline.operators import published


def told(words, size, restarts, near):
    """The rules in the order they are told, over a list of [word, start, end, heard]."""
    heard_back = None if restarts is None else lambda at: any(abs(at - r) <= near for r in restarts)
    listed = sorted(([w, a, b, h] for w, a, b, h in words if 1 <= w <= size and b > a), key=lambda x: (x[1], x[2], x[0]))
    ones, lasts = [i for i, x in enumerate(listed) if x[0] == 1], [i for i, x in enumerate(listed) if x[0] == size]
    begin = ones[0] if ones and (not lasts or ones[0] <= lasts[-1]) else 0
    listed = listed[begin : lasts[-1] + 1] if lasts and lasts[-1] >= begin else listed[begin:]
    merged = []
    for now in listed:
        if merged and merged[-1][0] == now[0]:
            last = merged[-1]
            if not last[3] and last[2] - last[1] < 50:
                merged[-1] = list(now)
                continue
            if not (now[3] or (heard_back and heard_back(now[1]))):
                last[2] = max(last[2], now[2])
                continue
        merged.append(list(now))
    while len(merged) > 1 and merged[0][0] != 1 and merged[1][0] <= merged[0][0]:
        merged[1][1] = merged[0][1]
        del merged[0]
    out, furthest, i = [], 0, 0
    while i < len(merged):
        if merged[i][0] > furthest:
            furthest = merged[i][0]
            out.append(merged[i])
            i += 1
            continue
        stretch = []
        while i < len(merged) and merged[i][0] <= furthest:
            stretch.append(merged[i])
            i += 1
        calm = []
        for run in split(stretch):
            if len(run) > 1 and (run[-1][1] - run[0][1]) / (len(run) - 1) < 100:
                target = calm[-1] if calm else out[-1]
                target[2] = max(target[2], run[-1][2])
            else:
                calm += run
        if not calm:
            continue
        named = sorted(x[0] for x in calm)
        fine = heard_back is None or heard_back(calm[0][1])
        if fine and all(len(r) > 1 for r in split(calm)):
            out += calm
        elif fine and len(named) > 1 and named == list(range(named[0], named[0] + len(named))) and named[-1] == furthest:
            out += [[w, *x[1:]] for w, x in zip(named, calm)]
        elif fine and (heard_back is not None or all(x[3] for x in calm)):
            out += calm
        else:
            out[-1][2] = max(out[-1][2], calm[-1][2])
    return [(n, w, a, b) for n, (w, a, b, _) in enumerate(out)]


def split(words):
    runs = []
    for x in words:
        if runs and runs[-1][-1][0] + 1 == x[0]:
            runs[-1].append(x)
        else:
            runs.append([x])
    return runs


def cleaned(spark, cases, sizes, restarts=None, near=300):
    words = spark.createDataFrame([(k, *w) for k, case in enumerate(cases) for w in case], "id int, word int, start long, end long, heard boolean").repartition(3)
    size = spark.createDataFrame(list(enumerate(sizes)), "id int, size int")
    heard = None if restarts is None else spark.createDataFrame([(k, at) for k, each in enumerate(restarts) for at in each], "id int, at long")
    rows = published.recited_words(words, size, ["id"], heard, near).collect()
    return [sorted((r.place, r.word, r.start, r.end) for r in rows if r.id == k) for k in range(len(cases))]


def case_of(indices, step=500, length=400):
    return [(w, i * step, i * step + length, False) for i, w in enumerate(indices)]


def test_stated_cases(spark):
    scrambled = [*range(1, 29), 26, 25, 24, 27, 28, 29, 30]
    out_of_order = [1, 2, 3, 4, 5, 3, 2, 4, 5, 6]
    cases = [case_of(scrambled), case_of(out_of_order), case_of([3, 2, 3, 4, 5]), case_of([4, 1, 2, 3, 4, 2]), case_of([1, 2, 3, 2, 3, 4]), case_of([1, 2, 3, 2, 4])]
    got = [[w for _, w, *_ in g] for g in cleaned(spark, cases, [30, 6, 5, 4, 4, 4])]
    assert got[0] == [*range(1, 29), 24, 25, 26, 27, 28, 29, 30]
    assert got[1] == [1, 2, 3, 4, 5, 2, 3, 4, 5, 6]
    assert got[2] == [2, 3, 4, 5] and got[3] == [1, 2, 3, 4] and got[4] == [1, 2, 3, 2, 3, 4] and got[5] == [1, 2, 3, 4]
    once = cleaned(spark, [case_of([1, 2, 3, 2, 4])], [4], [[1500]])[0]
    assert [w for _, w, *_ in once] == [1, 2, 3, 2, 4]
    silent = cleaned(spark, [case_of([1, 2, 3, 2, 3, 4])], [4], [[]])[0]
    assert [w for _, w, *_ in silent] == [1, 2, 3, 4] and silent[2][3] == 2400


@pytest.mark.parametrize("listened", [False, True])
def test_words_equal_the_rules_as_told(spark, listened):
    rng = random.Random(listened)
    cases, sizes, restarts = [], [], []
    for _ in range(150):
        size, at, now, words, heard = rng.randrange(1, 12), 0, rng.choice([1, 1, 1, 2, 3]), [], []
        for _ in range(rng.randrange(0, 22)):
            length = rng.choice([20, 60, 300, 400])
            words.append((now, at, at + length, rng.random() < 0.15))
            at += rng.choice([60, 90, 300, 500])
            if rng.random() < 0.3:
                now = max(1, now - rng.randrange(0, 4))
                if rng.random() < 0.6:
                    heard.append(at + rng.randrange(-200, 400))
            else:
                now += rng.choice([1, 1, 1, 2, 0])
        cases.append(words)
        sizes.append(size)
        restarts.append(heard)
    got = cleaned(spark, cases, sizes, restarts if listened else None)
    for g, words, size, heard in zip(got, cases, sizes, restarts):
        assert g == told(words, size, heard if listened else None, 300)
