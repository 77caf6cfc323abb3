"""Recited runs against a full table of costs and moves, and the choice of readings on stated cases."""

import random

import numpy as np

from strandline.operators import recited


def full_table(heard, script, starts, jump):
    """The whole table with where each cell came from; then the way back over it."""
    size = len(script) + 1
    row, moves = list(range(size)), []
    for symbol in heard:
        opened, source = list(row), list(range(size))
        for s in starts:
            best = min(range(s, size), key=lambda q: (row[q], q))
            if row[best] + jump < opened[s]:
                opened[s], source[s] = row[best] + jump, best
        new, how = [], []
        for c in range(size):
            options = [(opened[c] + 1, 1, c)]
            if c:
                options.append((opened[c - 1] + (script[c - 1] != symbol), 0, c - 1))
                options.append((new[c - 1] + 1, 2, c - 1))
            cost, kind, at = min(options, key=lambda o: (o[0], o[1]))
            new.append(cost)
            how.append((kind, at, source))
        row = new
        moves.append(how)
    cell, read, places = size - 1, [], []
    for i in range(len(heard) - 1, -1, -1):
        while moves[i][cell][0] == 2:
            cell -= 1
            read.append(cell)
        places.append(cell)
        kind, at, source = moves[i][cell]
        if kind == 0:
            read.append(at)
        cell = source[at]
    read += range(cell - 1, -1, -1)
    return read[::-1], places[::-1], row[-1]


def test_paths_equal_a_full_table():
    rng = random.Random(4)
    for _ in range(300):
        script = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        starts = sorted({0, *(rng.randrange(len(script)) for _ in range(4))})
        at, heard = 0, []
        while at < len(script) and len(heard) < 60:
            heard.append(script[at] if rng.random() < 0.85 else rng.randrange(4))
            at = rng.choice(starts) if rng.random() < 0.08 else at + rng.choice([1, 1, 1, 1, 2, 0])
        jump = rng.choice([1, 3])
        got = recited.Alignment(np.array(script), np.array(starts), jump).path(np.array(heard))
        assert (list(got[0]), list(got[1]), got[2]) == full_table(heard, script, starts, jump)


def test_runs(spark):
    words = [f"w{i}" for i in range(12)]
    units = [i // 3 for i in range(12)]
    rows = [
        (1, words, words, units), (2, words[:8] + words[3:], words, units), (3, words + words[6:], words, units), (4, [], words, units), (5, words, [], []), (6, None, words, units),
        (7, words[:5] + ["x"] + words[5:], words, units),
    ]
    got = recited.recited_runs(spark.createDataFrame(rows, "key int, heard array<string>, script array<string>, units array<int>")).collect()
    runs = lambda k: [(r.first, r.last) for r in sorted(got, key=lambda r: r.run) if r.key == k]
    assert runs(1) == [(0, 3)] and runs(2) == [(0, 2), (1, 3)] and runs(3) == [(0, 3), (2, 3)] and runs(7) == [(0, 3)]
    assert not runs(4) and not runs(5) and not runs(6)
    assert {r.key: r.cost for r in got} == {1: 0, 2: 3, 3: 3, 7: 1}
    placed = recited.heard_units(spark.createDataFrame(rows[:1], "key int, heard array<string>, script array<string>, units array<int>")).collect()
    assert [(r.t, r.unit) for r in sorted(placed, key=lambda r: r.t)] == list(enumerate(units))


def test_choice_of_readings(spark):
    """Verse 1 is said with two steps back, which only the other reading has; verse 2 with one, which is not enough."""
    said = {1: "abcabcabcdef", 2: "ghighijk"}
    held = {1: "abcdef", 2: "ghijk"}
    other = {1: "abcabcabcdef", 2: "ghighijk"}
    rows = lambda text: [(9, g, n, ord(c)) for n, (g, c) in enumerate((g, c) for g in (1, 2) for c in text[g])]
    frame = lambda text: spark.createDataFrame(rows(text), "id int, verse int, n long, w int")
    heard = frame(said).selectExpr("id", "verse", "n AS t", "char(w) AS letter")
    spelled = spark.createDataFrame([(ord(c), c) for c in "abcdefghijk"], "w int, letters string")
    gains = {r.verse: r.gain for r in recited.group_gains(heard, frame(held), frame(other), spelled, ["id"], "verse").collect()}
    assert gains == {1: 6}
    out = recited.chosen_reading(heard, frame(held), frame(other), spelled, ["id"], "verse").orderBy("place").collect()
    assert "".join(chr(r.w) for r in out) == "abcabcabcdefghijk" and [r.place for r in out] == list(range(17))
    assert [r.verse for r in out if r.chosen] == [1] * 12
    none = recited.chosen_reading(heard, frame(held), frame(other), spelled, ["id"], "verse", least_gain=7).collect()
    assert "".join(chr(r.w) for r in sorted(none, key=lambda r: r.place)) == "abcdefghijk"
