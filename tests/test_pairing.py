"""Pairing and agreement against plain definitions."""

import itertools
import random

from pyspark.sql import functions as F

from strandline.operators import matching, pairing
from test_matching import edits


def test_paired_tokens(spark):
    rows = [(["ab", "c"], ["a", "b", "c"]), (["ab", "c"], ["a", "b"]), (["a"], ["a", "b"]), ([], []), (None, ["a"]), (["aa", "a"], ["a", "a", "a"]), (["ab", "cd"], ["abc", "d"]), (["a", ""], ["a"])]
    got = [r.p for r in spark.createDataFrame(rows, "w array<string>, t array<string>").coalesce(1).select(pairing.paired_tokens(F.col("w"), F.col("t")).alias("p")).collect()]
    assert got == [["a b", "c"], None, None, [], None, ["a a", "a"], None, None]


def test_chunk_sizes(spark):
    rng = random.Random(1)
    rows = [(i, ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 7))], ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 4))]) for i in range(60)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, w array<string>, c array<string>").select("i", pairing.chunk_sizes(F.col("w"), F.col("c")).alias("s")).collect()}

    def cost(words, chunks, sizes):
        at, total = 0, 0
        for size, chunk in zip(sizes, chunks, strict=True):
            total += edits("".join(words[at : at + size]), chunk)
            at += size
        return total

    for i, words, chunks in rows:
        ways = [s for s in itertools.product(range(1, 8), repeat=len(chunks)) if sum(s) == len(words)]
        assert (got[i] is None) == (not ways)
        assert not ways or cost(words, chunks, got[i]) == min(cost(words, chunks, s) for s in ways)


def test_seeded_order(spark):
    items = ["a", "b", "c", "d", "e"]
    got = [r.p for r in spark.createDataFrame([(items, s) for s in ("x", "y", "x", "")], "v array<string>, s string").coalesce(1).select(pairing.seeded_order(F.col("v"), F.col("s")).alias("p")).collect()]
    assert got[0] == got[2] and all(sorted(p) == items for p in got) and len({tuple(p) for p in got}) > 1
    state, pool = 0x811C9DC5, list(items)
    for i in range(4, 0, -1):
        state = (state * 1664525 + 1013904223) % 2**32
        pool[i], pool[state % (i + 1)] = pool[state % (i + 1)], pool[i]
    assert got[3] == pool


def test_unheard_words_and_agreement(spark):
    rows = [(1, ["alpha", "beta", "gamma"], ["alpha gamma", "alpha ga"]), (2, ["alpha", "beta"], ["zzz"]), (3, [], ["a"]), (4, ["one"], [])]
    got = sorted(tuple(r) for r in matching.unheard_words(spark.createDataFrame(rows, "id long, words array<string>, readings array<string>")).collect())
    assert got == [(1, 1)]
    said = spark.createDataFrame([(1, ["alpha"], ["al pha"]), (2, ["ab", "c"], [""])], "id long, words array<string>, readings array<string>")
    assert sorted((r.id, r.place, r.share) for r in matching.heard_shares(said).collect()) == [(1, 0, 1.0), (2, 0, 0.0), (2, 1, 0.0)]
    windows = [("k", ["abc", "de"], ["abc", "de"]), ("k", ["abc", "de"], ["abc", "xx"]), ("k", ["a"], ["b"]), ("m", ["a", "b"], ["a", "b"]), ("n", ["abc", "d"], [])]
    means = {r.k: r.agreement for r in matching.agreements(spark.createDataFrame(windows, "k string, decoded array<string>, placed array<string>"), "k").collect()}
    assert means == {"k": 0.75, "n": 0.0}


def test_ordered_windows(spark):
    rng = random.Random(3)
    rows = []
    for key in range(4):
        words = [rng.choice("abcd") for _ in range(40)]
        for nth in range(8):
            begin = rng.randrange(36)
            rows.append((key, nth, [w if rng.random() < 0.8 else "x" for w in words[begin : begin + rng.randrange(1, 5)]], words))
    rows.append((9, 0, [], ["a"]))
    got = {(r.key, r.nth): (r.start, r.stop) for r in matching.ordered_windows(spark.createDataFrame(rows, "key int, nth int, wanted array<string>, words array<string>").repartition(3)).collect()}
    for key in range(4):
        cursor = 0
        for _, nth, wanted, words in (r for r in rows if r[0] == key):
            ranked = [(sum(a == b for a, b in zip(wanted, words[s:])) / len(wanted), -abs(s - cursor), -s) for s in range(len(words) - len(wanted) + 1)]
            best = max(ranked)
            if best[0] >= 0.6:
                cursor = -best[2] + len(wanted)
                assert got.pop((key, nth)) == (-best[2], cursor - 1)
    assert not got
