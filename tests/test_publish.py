"""Titles, tags and descriptions against plain rules."""

import random

from strandline.functions import publish, text
from strandline.operators import pairing
from pyspark.sql import functions as F


def clip(t, most):
    return t if len(t) <= most else t[: max(0, most - 1)].rstrip() + "…"


def test_titles(spark):
    rng = random.Random(1)
    rows = [(i, "Subject " + "x" * rng.randrange(110), rng.choice(["", "a name", "y" * rng.randrange(1, 120)])) for i in range(120)]
    extras = ["#One", "#Second"]
    df = spark.createDataFrame(rows, "i int, s string, a string")
    got = {r.i: (r.t.title, r.t.truncated) for r in df.select("i", publish.fitted_title(F.col("s"), F.col("a"), F.array(*map(F.lit, extras))).alias("t")).collect()}
    for i, s, a in rows:
        named = s + (f" | {a}" if a else "")
        ways = [f"{named} #Shorts {' '.join(extras[:k])}".rstrip() for k in (2, 1, 0)] + [f"{s} #Shorts"]
        best = next((w for w in ways if len(w) <= 100), ways[-1])
        assert got[i] == (clip(best, 100), best != ways[0])
    assert {t for _, t in got.values()} == {True, False}


def test_tags_and_descriptions(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        tags = ["t" * rng.choice([0, 3, 9, 20]) for _ in range(rng.randrange(6))]
        blocks = [(f"k{rng.randrange(3)}", rng.choice(["", "some text", "z" * rng.randrange(60)])) for _ in range(rng.randrange(5))]
        rows.append((i, tags, blocks))
    df = spark.createDataFrame(rows, "i int, tags array<string>, blocks array<struct<key:string,text:string>>")
    got = {r.i: r for r in df.select("i", publish.kept_tags(F.col("tags"), 30).alias("t"), publish.description(F.lit("head"), F.col("blocks"), F.lit("tail"), 70).alias("d")).collect()}
    for i, tags, blocks in rows:
        kept, used, cut = [], 0, False
        for t in filter(None, tags):
            cost = len(t) + (2 if kept else 0)
            if used + cost > 30:
                cut = True
                continue
            kept.append(t)
            used += cost
        assert (got[i].t.tags, got[i].t.truncated) == (kept, cut)
        first = {}
        for k, t in blocks:
            first.setdefault(k, t)
        body = "\n\n".join(t for t in first.values() if t)
        long = len(body) > 70 - 8 - 4
        fitted = clip(body, 58) if long else body
        assert (got[i].d.description, got[i].d.truncated) == ("\n\n".join(filter(None, ["head", fitted, "tail"])), long)


def test_digests_equal_the_batch_function(spark):
    rows = [("",), ("a",), ("né \U0001f600 漢",), ("x" * 40,), *((f"seed {i}",) for i in range(200))]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(publish.fnv36(F.col("t"), pairing.FNV_START, pairing.FNV_PRIME).alias("a"), text.digest36("t").alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) == len(rows)
    refs = spark.createDataFrame([(1, 2, 2), (1, 2, 5)], "c int, a int, b int").select(publish.reference(F.col("c"), F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in refs] == ["1:2", "1:2-5"]
