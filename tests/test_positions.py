import random

from strandline.operators import positions


def test_places_are_those_of_the_whole_order(spark):
    rng = random.Random(4)
    keys = [None if rng.random() < 0.1 else rng.randrange(200) for _ in range(500)] + [7] * 200
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(5)
    placed = positions.positions(df, ["k", "i"], 6)
    got = sorted((r.place, r.k, r.i) for r in placed.collect())
    order = sorted(((k, i) for i, k in enumerate(keys)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(n, k, i) for n, (k, i) in enumerate(order)]
    asked = spark.createDataFrame([(7,), (1000,)], "k int")
    assert {r.k: r.place for r in positions.position_of(asked, placed, ["k"]).collect()} == {7: max(n for n, k, _ in got if k == 7), 1000: None}
