"""Marks carried to captions against a plain loop, and without pairs of both."""

import random

from pyspark.sql import functions as F

from strandline.operators import sync

CAPTIONS, MARKS = "key int, nth long, `from` long, `to` long, start long, end long", "key int, id long, word long, middle long"
BIG = 2**60  # numbers that a double cannot hold


def test_carried_marks_equal_a_loop(spark):
    rng = random.Random(3)
    captions = []
    for _ in range(1500):
        word, start = rng.randrange(12), rng.randrange(90)
        captions.append((rng.choice([None, 0, 1, 2]), rng.choice([None, *[BIG + rng.randrange(4000)] * 9]), word, word + rng.randrange(-1, 4), start, rng.choice([start + rng.randrange(-3, 60), None])))
    captions += captions[:200]
    marks = [(rng.choice([None, 0, 1, 2, 3]), i % 500, rng.choice([None, *range(15)]), rng.choice([None, *range(-5, 150)])) for i in range(900)]
    got = {(r.key, r.id): r.nth for r in sync.carried_marks(spark.createDataFrame(captions, CAPTIONS).repartition(3), spark.createDataFrame(marks, MARKS).repartition(3), "key").collect()}
    expected = {}
    for key, mark, word, middle in marks:
        if None in (key, word, middle):
            continue
        for k, nth, low, high, start, end in captions:
            if k == key and end is not None and low <= word <= high and start <= middle < end:
                before = expected.get((key, mark))
                expected[key, mark] = nth if before is None else before if nth is None else min(before, nth)
    assert got == expected and any(v is None for v in got.values())


def test_carried_marks_make_no_pairs(spark):
    # 4000 captions and 4000 marks of one word: 16 million pairs
    captions = spark.range(4000).select(F.lit(1).alias("key"), F.col("id").alias("nth"), F.lit(5).cast("long").alias("from"), F.lit(5).cast("long").alias("to"), F.col("id").alias("start"), (F.col("id") + 100_000).alias("end"))
    marks = spark.range(4000).select(F.lit(1).alias("key"), "id", F.lit(5).cast("long").alias("word"), (F.col("id") + 50_000).alias("middle"))
    found = sync.carried_marks(captions, marks, "key")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = []

        def joined(plan):
            if "Join" in plan.nodeName():
                made.append(plan.metrics().apply("numOutputRows").value())
            for i in range(plan.children().size()):
                joined(plan.children().apply(i))

        frame = found.select("*")
        plan = frame._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        joined(plan)
        assert made and max(made) <= 4000
        assert {r.nth for r in found.collect()} == {0}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
