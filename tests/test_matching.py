"""Matching of phrases and the carried folds against plain loops."""

import random
from difflib import SequenceMatcher

from strandline.operators import folds, matching


def passages(rng, n):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(14)}" for _ in range(rng.randrange(0, 45))]
        keys = [f"1:{k // 9}" for k in range(len(words))]
        begin = rng.randrange(max(1, len(words)))
        heard = [w if rng.random() < 0.8 else "x" for w in words[begin : begin + rng.randrange(1, 12)]]
        rows.append((i, heard, words, keys, rng.randrange(max(1, len(words)))))
    return rows


def test_best_windows_equal_a_full_search(spark):
    rows = passages(random.Random(3), 60)
    odd = [(900, None, ["a"], ["1:1"], 0), (901, [], ["a"], ["1:1"], 0), (902, ["a"], [], [], 0), (903, ["a"], ["b"], ["1:1"], 0)]
    phrases = spark.createDataFrame([(i, i, h, c) for i, h, _, _, c in [*rows, *odd]], "id long, passage long, heard array<string>, cursor int")
    reference = spark.createDataFrame([(i, n, k, w) for i, _, ws, ks, _ in [*rows, *odd] for n, (w, k) in enumerate(zip(ws, ks))], "passage long, place int, key string, word string")
    got = {r.id: (r.start, r.stop, r.score) for r in matching.located_phrases(phrases, reference).collect()}
    want = {}
    for i, heard, words, keys, cursor in rows:
        best = None
        for a in range(len(words)):
            for b in range(a, min(len(words), a + matching.LONGEST)):
                if keys[b] != keys[a]:
                    break
                ratio = SequenceMatcher(None, heard, words[a : b + 1]).ratio()
                if not ratio:
                    continue
                score = ratio - 0.05 * min(abs(a - cursor), len(words)) / len(words)
                if best is None or score > best[2]:
                    best = (a, b, score)
        if best is not None and heard and best[2] >= 0:
            want[i] = best
    assert got == want and len(got) > 40
    near = {r.id: (r.start, r.score) for r in matching.located_phrases(phrases, reference, near=4, least=0.5).collect()}
    assert all(s == want[i][2] or abs(a - rows[i][4]) <= 4 for i, (a, s) in near.items()) and set(near) == {i for i, w in want.items() if w[2] >= 0.5}
    loose = matching.window_bounds(phrases, reference).collect()
    assert all(r.bound >= SequenceMatcher(None, rows[r.id][1], r.window).ratio() - r.far for r in loose if r.id < 900)


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_substring_match(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(4) for _ in range(rng.randrange(0, 6))], [rng.randrange(4) for _ in range(rng.randrange(0, 12))]) for i in range(60)]
    got = {r.id: r for r in matching.substring_match(spark.createDataFrame(rows, "id long, target array<int>, heard array<int>")).collect()}
    for i, target, heard in rows:
        best = min(edits(target, heard[a:b]) for a in range(len(heard) + 1) for b in range(a, len(heard) + 1))
        assert got[i].edits == best == edits(target, heard[got[i].start : got[i].stop])


def test_similarity(spark):
    rows = [(1, ["a", "b"], ["a", "b"]), (2, ["a", "b"], ["x", "a"]), (3, [], ["a"]), (4, ["a"], [])]
    got = {r.id: r.ratio for r in spark.createDataFrame(rows, "id long, a array<string>, b array<string>").select("id", matching.similarity("a", "b").alias("ratio")).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}


def test_folds_carry_state_over_batches(spark):
    """One key holds nearly all rows, and batches are far smaller than it."""
    rng = random.Random(5)
    rows = [(1 if i % 50 else 2, i, rng.randrange(10**6), rng.randrange(300)) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long, v long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        admitted = {r.event_id: r.admitted for r in folds.rate_limited(df, 3, 9000).collect()}
        again = sorted(tuple(r) for r in folds.read_again(df).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    spans = []
    for user in (1, 2):
        kept, top, open_ = [], None, None
        for _, i, t, v in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            fine = sum(t - k < 9000 for k in kept) < 3
            kept += [t] * fine
            assert admitted[i] == fine
            if top is not None and v <= top:
                open_ = (open_[0], t) if open_ else (t, t)
            else:
                if open_:
                    spans.append((user, open_[0], t))
                top, open_ = v, None
        if open_:
            spans.append((user, *open_))
    assert again == sorted(spans)
