"""Queries of stops and planned captions, on each user's events as words of verses of ten, read on and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import stops
from strandline.plans.reading_queries import heard
from strandline.plans.run_queries import USER

MINUTE, HOUR = 60_000, 3_600_000
RULES = stops.StopRules(breath=HOUR, word_gap=12 * HOUR, silence=2 * HOUR, quiet=90 * MINUTE, sung=8 * HOUR, edge=HOUR, drift=2 * HOUR, reach=45 * MINUTE)
VERSE = ["user_id", "verse"]


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heard(spark, sf_dir).where("w >= 0")
    return rows.select("user_id", F.floor(F.col("w") / 10).alias("verse"), (F.col("w") % 10 + 1).alias("word"), "start", "end", "n", "v")


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = _words(spark, sf_dir)
    v = F.col("v")
    cuts = words.where("v % 3 = 0").select("user_id", "verse", "word", (F.col("start") + (v % 5 - 2) * (30 * MINUTE)).alias("at"), (v % 2 == 0).alias("licensed"), (v % 4 == 1).alias("breathable"), (v % 4 == 3).alias("held"))
    quiet = words.where("v % 5 < 3").select("user_id", (F.col("end") - v % 3 * HOUR).alias("start"), (F.col("end") + v % 7 * HOUR).alias("end"))
    silences = words.where("v % 4 < 2").select("user_id", (F.col("end") - v % 2 * HOUR).alias("start"), (F.col("end") + v % 9 * HOUR).alias("end"))
    return cuts, stops.join_evidence(cuts, words, quiet, silences, USER, 12 * HOUR, RULES)


def join_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)[1].select("user_id", "verse", "word", "at", "breath", "word_gap", "unsaid", "quiet_inside")


def stop_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts the reader stopped at; users whose number 3 divides hold notes."""
    found = _evidence(spark, sf_dir)[1]
    stopped = stops.stops_heard(found, F.lit(True), F.lit(True), F.col("user_id") % 3 == 0, RULES)
    return found.where(stopped).select("user_id", "verse", "word", "at")


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch of forty events as one verse, its words as they were read."""
    rows = heard(spark, sf_dir).where("w >= 0")
    verse = F.floor(F.col("n") / 40)
    place = F.row_number().over(Window.partitionBy("user_id", verse).orderBy("n")) - 1
    return rows.select("user_id", verse.alias("verse"), place.alias("place"), (F.col("w") + 1).alias("word"), "start", "end", "v")


def planned_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _stretches(spark, sf_dir)
    verses = words.groupBy(*VERSE).agg(F.lit(40).alias("words"), (F.min("start") - HOUR).alias("from"), (F.max("end") - 2 * HOUR).alias("to"))
    cuts = words.where("v % 6 = 1").select(*VERSE, "word", (F.col("start") + (F.col("v") % 9 - 4) * HOUR).alias("at"))
    places = stops.cut_places(words, cuts, VERSE, 2 * HOUR, 4 * HOUR)
    return stops.planned_captions(words, verses, places, VERSE)


def moved_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses of five events each as listed, heard up to some hours later; every third first word keeps its start."""
    rows = heard(spark, sf_dir)
    listed = rows.select("user_id", F.floor(F.col("n") / 5).alias("verse"), (F.col("n") % 5 + 1).alias("word"), "start", "end", "v")
    said = listed.select(*VERSE, F.when(F.col("v") % 97 == 0, F.col("word") + 1).otherwise(F.col("word")).alias("word"), (F.col("start") + F.col("v") % 5 * HOUR).alias("start"), (F.col("end") + F.col("v") % 5 * HOUR).alias("end"))
    return stops.moved_starts(listed.drop("v"), said, USER, 2 * HOUR, F.col("verse") % 3 == 0)


QUERIES = {f.__name__: f for f in (join_evidence, stop_decisions, planned_captions, moved_starts)}

_H = """e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) - 1704067200000 AS a FROM events),
  h AS (SELECT *, a + coalesce(CAST(floor((lead(a) OVER (PARTITION BY user_id ORDER BY n) - a) * 6 / 10) AS BIGINT), 1000) AS b, (n - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) % 40 AS w FROM e)"""
_V = f"""{_H}, x AS (SELECT user_id, w // 10 AS verse, w % 10 + 1 AS word, a, b, v FROM h WHERE w >= 0),
  c AS (SELECT DISTINCT user_id, verse, word, a + (v % 5 - 2) * {30 * MINUTE} AS "at", v % 2 = 0 AS licensed, v % 4 = 1 AS breathable, v % 4 = 3 AS held FROM x WHERE v % 3 = 0),
  q AS (SELECT user_id, b - v % 3 * {HOUR} AS a, b + v % 7 * {HOUR} AS b FROM x WHERE v % 5 < 3), z AS (SELECT user_id, b - v % 2 * {HOUR} AS a, b + v % 9 * {HOUR} AS b FROM x WHERE v % 4 < 2),
  u AS (SELECT *, b - a - coalesce((SELECT sum(least(q.b, x.b) - greatest(q.a, x.a)) FROM x WHERE x.user_id = q.user_id AND x.b - x.a > 50 AND least(q.b, x.b) > greatest(q.a, x.a)), 0) AS left_over FROM q WHERE b > a),
  d AS (SELECT c.*, coalesce((SELECT max(left_over) FROM u WHERE u.user_id = c.user_id AND u.a - {HOUR} <= c."at" AND c."at" <= u.b + {HOUR}), 0) AS breath,
    (SELECT arg_max(x.b, (x.a, x.b)) FROM x WHERE x.user_id = c.user_id AND x.verse = c.verse AND x.word = c.word - 1 AND x.b - x.a > 50 AND x.b <= c."at" + {2 * HOUR}) AS bx,
    (SELECT min(x.a) FROM x WHERE x.user_id = c.user_id AND x.verse = c.verse AND x.word = c.word AND x.b - x.a > 50 AND x.a >= c."at" - {2 * HOUR}) AS ax FROM c),
  g AS (SELECT *, coalesce(ax - bx, 0) AS word_gap, coalesce(bx, "at" - {HOUR}) - {45 * MINUTE} AS f, coalesce(ax, "at" + {HOUR}) + {45 * MINUTE} AS t FROM d),
  k AS (SELECT g.*, coalesce((SELECT max(least(z.b, t) - greatest(z.a, f)) FROM z WHERE z.user_id = g.user_id AND least(z.b, t) > greatest(z.a, f)), 0) AS unsaid, coalesce((SELECT sum(least(q.b, t) - greatest(q.a, f)) FROM q WHERE q.user_id = g.user_id AND least(q.b, t) > greatest(q.a, f)), 0) AS inside FROM g)"""
ORACLES = {
    "join_evidence": f"""WITH {_V} SELECT user_id, verse, word, "at", CAST(breath AS BIGINT) AS breath, word_gap, unsaid, CAST(inside AS BIGINT) AS quiet_inside FROM k""",
    "stop_decisions": f"""WITH {_V} SELECT user_id, verse, word, "at" FROM k WHERE CASE WHEN user_id % 3 = 0 THEN (licensed OR breathable) AND unsaid >= {8 * HOUR} WHEN licensed THEN breath >= {HOUR} OR word_gap >= {12 * HOUR} OR (unsaid >= {2 * HOUR} AND inside >= {90 * MINUTE})
      WHEN breathable THEN breath >= {HOUR} ELSE held AND breath >= {2 * HOUR} END""",
    "planned_captions": f"""WITH {_H}, x AS (SELECT user_id, n // 40 AS verse, row_number() OVER (PARTITION BY user_id, n // 40 ORDER BY n) - 1 AS place, w + 1 AS word, a, b, v FROM h WHERE w >= 0),
      y AS (SELECT *, lag(word) OVER o AS was, lag(a) OVER o AS was_a FROM x WINDOW o AS (PARTITION BY user_id, verse ORDER BY place)), c AS (SELECT DISTINCT user_id, verse, word, a + (v % 9 - 4) * {HOUR} AS "at" FROM x WHERE v % 6 = 1),
      m AS (SELECT c.*, y.place, abs(y.a - c."at") AS away, y.was_a, count(*) OVER (PARTITION BY c.user_id, c.verse, c.word, c."at") AS many, row_number() OVER (PARTITION BY c.user_id, c.verse, c.word, c."at" ORDER BY abs(y.a - c."at"), y.place) AS k FROM c JOIN y USING (user_id, verse, word) WHERE y.was = y.word - 1),
      p AS (SELECT user_id, verse, place, max(CASE WHEN "at" > was_a THEN "at" END) AS "at" FROM m WHERE k = 1 AND away <= CASE WHEN many = 1 THEN {4 * HOUR} ELSE {2 * HOUR} END GROUP BY ALL),
      s AS (SELECT y.*, p."at", coalesce(word <= was, false) AS restart, was IS NULL OR word <= was OR p.place IS NOT NULL AS opens FROM y LEFT JOIN p USING (user_id, verse, place)),
      t AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id, verse ORDER BY place) - 1 AS caption, max(place) OVER (PARTITION BY user_id, verse) AS z, min(a) OVER (PARTITION BY user_id, verse) - {HOUR} AS vf, max(b) OVER (PARTITION BY user_id, verse) - {2 * HOUR} AS vt FROM s),
      f AS (SELECT *, row_number() OVER (PARTITION BY user_id, verse, caption ORDER BY place) AS j, max(place) OVER (PARTITION BY user_id, verse, caption) AS e FROM t),
      r AS (SELECT f.*, l.word AS lw, l.b AS lb, x.word AS nw, x.restart AS nr, coalesce(x."at", x.a) AS na, CASE WHEN caption = 0 THEN CASE WHEN f.vf < f.b THEN f.vf ELSE f.a END ELSE coalesce(f."at", f.a) END AS start FROM (SELECT * FROM f WHERE j = 1) f
        JOIN (SELECT user_id, verse, place, word, b FROM f) l ON l.user_id = f.user_id AND l.verse = f.verse AND l.place = f.e LEFT JOIN (SELECT user_id, verse, place, word, restart, "at", a FROM f) x ON x.user_id = f.user_id AND x.verse = f.verse AND x.place = f.e + 1)
      SELECT user_id, verse, CAST(caption AS BIGINT) AS caption, CASE WHEN caption = 0 THEN 1 ELSE word END AS first_word, CASE WHEN nw IS NULL THEN 40 WHEN nr THEN lw ELSE nw - 1 END AS last_word, start, CASE WHEN nw IS NOT NULL THEN na WHEN vt > start THEN vt ELSE lb END AS "end", restart FROM r""",
    "moved_starts": f"""WITH RECURSIVE {_H}, l AS (SELECT user_id, n // 5 AS verse, n % 5 + 1 AS word, a, b, v FROM h), s AS (SELECT user_id, verse, CASE WHEN v % 97 = 0 THEN word + 1 ELSE word END AS word, a + v % 5 * {HOUR} AS a, b + v % 5 * {HOUR} AS b FROM l),
      k AS (SELECT user_id, verse, list(word ORDER BY a, word) AS ws, list(a ORDER BY a, word) AS sa, list(b ORDER BY a, word) AS sb FROM s GROUP BY ALL), m AS (SELECT user_id, verse, list(a ORDER BY a, word) AS la, list(b ORDER BY a, word) AS lb, list(word ORDER BY a, word) AS lw FROM l GROUP BY ALL),
      j AS (SELECT m.*, sa, sb, lw = range(1, len(lw) + 1) AND ws = range(1, len(lw) + 1) AS ok, [CASE WHEN sa[i] - la[i] >= {2 * HOUR} AND NOT (verse % 3 = 0 AND i = 1) THEN sa[i] ELSE la[i] END FOR i IN range(1, len(la) + 1)] AS ma, [CASE WHEN sa[i] - la[i] >= {2 * HOUR} AND NOT (verse % 3 = 0 AND i = 1) THEN greatest(lb[i], sb[i]) ELSE lb[i] END FOR i IN range(1, len(la) + 1)] AS mb FROM m JOIN k USING (user_id, verse)),
      o AS (SELECT user_id, verse, ok, sa, sb, ma, mb, 1 AS i, ma[1] AS a, mb[1] AS b FROM j WHERE ok UNION ALL SELECT user_id, verse, ok, sa, sb, ma, mb, i + 1, CASE WHEN ma[i + 1] <= a THEN sa[i + 1] ELSE ma[i + 1] END, CASE WHEN ma[i + 1] <= a THEN greatest(mb[i + 1], sb[i + 1]) ELSE mb[i + 1] END FROM o WHERE i < len(ma))
      SELECT user_id, verse, i::BIGINT AS word, a AS start, least(b, coalesce(lead(a) OVER (PARTITION BY user_id, verse ORDER BY i), b)) AS "end" FROM o UNION ALL SELECT user_id, verse, word, a, b FROM l WHERE (user_id, verse) NOT IN (SELECT user_id, verse FROM j WHERE ok)""",
}
