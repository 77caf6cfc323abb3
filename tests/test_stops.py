"""Evidence of stops, moved starts and planned captions on stated cases."""

from pyspark.sql import functions as F

from strandline.operators import stops

KEYS = ["id"]


def frames(spark, heard, quiet, silences, cuts):
    return (
        spark.createDataFrame(cuts, "id int, verse string, word int, at long, licensed boolean, breathable boolean, held boolean"),
        spark.createDataFrame(heard, "id int, verse string, word int, start long, end long"),
        spark.createDataFrame(quiet, "id int, start long, end long"),
        spark.createDataFrame(silences, "id int, start long, end long"),
    )


def test_evidence_of_a_join(spark):
    heard = [(1, "a", 1, 0, 1000), (1, "a", 2, 1800, 2500), (1, "b", 2, 1100, 1700), (1, "a", 3, 2600, 3000), (1, "a", 3, 2610, 2640)]
    quiet, silences = [(1, 1000, 1800), (1, 2480, 2700)], [(1, 900, 1500), (1, 1550, 1900)]
    cuts = [(1, "a", 2, 1800, True, False, False), (1, "a", 3, 2600, False, True, False), (1, "a", 9, 9000, True, False, False)]
    got = {r.word: r for r in stops.join_evidence(*frames(spark, heard, quiet, silences, cuts), KEYS, 700).collect()}
    # verse b's word takes 600 of the quiet before word 2, but is no edge of the join
    assert (got[2].breath, got[2].word_gap, got[2].unsaid, got[2].quiet_inside) == (200, 800, 600, 800)
    assert (got[3].breath, got[3].word_gap, got[3].unsaid) == (100, 100, 0) and got[3].quiet_inside == 220
    assert (got[9].breath, got[9].word_gap, got[9].unsaid, got[9].quiet_inside) == (0, 0, 0, 0)


def test_decisions(spark):
    columns = "breath long, word_gap long, unsaid long, quiet_inside long, licensed boolean, breathable boolean, held boolean, measured boolean, listened boolean, sung boolean, stopped boolean"
    rows = [
        (300, 0, 0, 0, True, False, False, True, True, False, True), (299, 599, 399, 0, True, False, False, True, True, False, False), (0, 600, 0, 0, True, False, False, True, True, False, True),
        (0, 0, 400, 200, True, False, False, True, True, False, True), (0, 0, 400, 199, True, False, False, True, True, False, False), (0, 0, 400, 200, True, False, False, True, False, False, False),
        (0, 0, 0, 0, True, False, False, False, True, False, True), (300, 0, 0, 0, False, True, False, True, True, False, True), (0, 900, 900, 900, False, True, False, True, True, False, False),
        (599, 0, 0, 0, False, False, True, True, True, False, False), (600, 0, 0, 0, False, False, True, True, True, False, True), (900, 900, 900, 900, False, False, False, True, True, False, False),
        (900, 900, 2499, 900, True, False, False, True, True, True, False), (0, 0, 2500, 0, False, True, False, True, True, True, True), (300, 0, 0, 0, True, False, False, True, False, True, True),
    ]
    df = spark.createDataFrame(rows, columns)
    assert df.where(stops.stops_heard(df, F.col("measured"), F.col("listened"), F.col("sung")) != F.col("stopped")).count() == 0


def test_moved_starts(spark):
    listed = [(1, "plain", w, s, s + 90) for w, s in ((1, 0), (2, 100), (3, 200), (4, 300))]
    said = [(1, "plain", w, s, s + 80) for w, s in ((1, 100), (2, 700), (3, 750), (4, 1500))]
    listed += [(1, "again", 1, 0, 50), (1, "again", 1, 60, 90)]
    said += [(1, "again", 1, 900, 950), (1, "again", 1, 990, 999)]
    got = sorted(map(tuple, stops.moved_starts(spark.createDataFrame(listed, "id int, verse string, word int, start long, end long"), spark.createDataFrame(said, "id int, verse string, word int, start long, end long"), KEYS).collect()))
    assert got == [(1, "again", 1, 0, 50), (1, "again", 1, 60, 90), (1, "plain", 1, 0, 90), (1, "plain", 2, 700, 750), (1, "plain", 3, 750, 830), (1, "plain", 4, 1500, 1580)]


def test_planned_captions(spark):
    words = [(1, p, w, 100 * p, 100 * p + 80) for p, w in enumerate([1, 2, 3, 4, 3, 4, 5, 6])]
    verses = [(1, 7, -50, 900), (2, 3, 0, 10)]
    cuts = [(1, 5, 630), (1, 3, 180), (1, 2, 5000), (1, 9, 100)]
    recited = spark.createDataFrame(words, "id int, place int, word int, start long, end long")
    places = stops.cut_places(recited, spark.createDataFrame(cuts, "id int, word int, at long"), KEYS, 100, 200)
    assert sorted((r.place, r["at"]) for r in places.collect()) == [(2, 180), (6, 630)]
    out = stops.planned_captions(recited, spark.createDataFrame(verses, "id int, words int, from long, to long"), places, KEYS).orderBy("caption").collect()
    assert [(r.first_word, r.last_word, r.start, r.end, r.restart) for r in out] == [(1, 2, -50, 180, False), (3, 4, 180, 400, False), (3, 4, 400, 630, True), (5, 7, 630, 900, False)]
    assert stops.planned_captions(recited.limit(0), spark.createDataFrame(verses, "id int, words int, from long, to long"), places, KEYS).count() == 0
