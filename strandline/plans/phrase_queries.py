"""Queries of the phrase search, on each user's events as phrases with one, two or three readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import phrases
from strandline.plans.reading_queries import heard
from strandline.plans.run_queries import USER
from strandline.runtime import ship_package

RULES = phrases.Rules(beam=10, least=500, again=750)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, j, first, last, score): a reading near where a phrase belongs, one further on, and a merged one of some pairs."""
    n, v, place = F.col("n").cast("long"), F.col("v"), F.col("w") + 8
    near = F.struct(n.alias("i"), (n + 1).alias("j"), place.alias("first"), (place + v % 4).alias("last"), (v % 600 + 400).alias("score"))
    far = F.struct(n.alias("i"), (n + 1).alias("j"), (place + 6 + v % 7).alias("first"), (place + 7 + v % 9).alias("last"), (v * 7 % 1000).alias("score"))
    none = F.lit(None).cast("long")
    quiet = F.struct(n.alias("i"), (n + 1).alias("j"), none.alias("first"), none.alias("last"), none.alias("score"))
    merged = F.struct(n.alias("i"), (n + 2).alias("j"), place.alias("first"), (place + 4).alias("last"), (v % 300 + 700).alias("score"))
    rows = heard(spark, sf_dir).withColumn("more", F.lead("n").over(Window.partitionBy("user_id").orderBy("n")).isNotNull())
    each = F.array_compact(F.array(F.when(v % 10 != 0, near), F.when((v % 10 != 0) & (v % 9 >= v % 7), far), F.when(v % 10 == 0, quiet), F.when((v % 3 == 0) & F.col("more"), merged)))
    return rows.select("user_id", F.explode(each).alias("r")).select("user_id", "r.*")


def claimed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return phrases.assigned_phrases(readings(spark, sf_dir), USER, RULES)


def explained_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best route of each user explains, in thousandths of words, and the words that it says."""
    found = claimed_phrases(spark, sf_dir).groupBy("user_id")
    return found.agg(F.sum(F.col("score") * (F.col("last") - F.col("first") + 1)).alias("explained"), F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).alias("n_words"))


QUERIES = {f.__name__: f for f in (claimed_phrases, explained_words)}

ORACLES = {
    "explained_words": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, event_type FROM events),
      h AS (SELECT *, (n - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) % 40 + 8 AS w, max(n) OVER (PARTITION BY user_id) AS z FROM e),
      spans AS (SELECT user_id, n AS i, n + 1 AS j, z FROM h UNION ALL SELECT user_id, n, n + 2, z FROM h WHERE v % 3 = 0 AND n < z),
      reads AS (SELECT user_id, n AS i, n + 1 AS j, w AS a, w + v % 4 AS b, v % 600 + 400 AS s FROM h WHERE v % 10 <> 0 UNION ALL SELECT user_id, n, n + 1, w + 6 + v % 7, w + 7 + v % 9, v * 7 % 1000 FROM h WHERE v % 10 <> 0 AND v % 9 >= v % 7
        UNION ALL SELECT user_id, n, n + 2, w, w + 4, v % 300 + 700 FROM h WHERE v % 3 = 0 AND n < z),
      g AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS b, -1::BIGINT AS reached, 0::HUGEINT AS said, 0::BIGINT AS explained, 0::BIGINT AS used, max(n) AS z FROM h GROUP BY user_id UNION ALL
        SELECT user_id, i, b, reached, said, explained, used, z FROM (
          SELECT r.user_id, r.i + 1 AS i, r.b, r.reached, r.said, r.explained, r.used, r.z FROM g r WHERE r.b > r.i AND r.i <= r.z
          UNION ALL
          SELECT user_id, i + 1, j, CASE WHEN k.c IS NULL THEN reached ELSE k.c.b END, CASE WHEN k.c IS NULL THEN said ELSE said | (((1::HUGEINT << (k.c.b - k.c.a + 1)::INT) - 1) << k.c.a::INT) END, explained + CASE WHEN k.c IS NULL THEN 0 ELSE k.c.s * (k.c.b - k.c.a + 1) END, used + 1, z
          FROM (SELECT r.*, s.j, list_filter((SELECT list({'a': d.a, 'b': d.b, 's': d.s}) FROM reads d WHERE d.user_id = r.user_id AND d.i = r.i AND d.j = s.j), lambda c: c.s >= 500 AND (c.b > r.reached OR c.s >= 750)
              AND (c.a > r.reached OR 2 * (least(c.b, r.reached) - c.a + 1 - bit_count((r.said >> c.a::INT) & ((1::HUGEINT << greatest(least(c.b, r.reached) - c.a + 1, 0)::INT) - 1))) <= least(c.b, r.reached) - c.a + 1)) AS fit
            FROM (SELECT * FROM g WHERE b = i AND i <= z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY explained DESC, used DESC, said DESC, reached DESC) <= 10) r JOIN spans s ON s.user_id = r.user_id AND s.i = r.i) x,
            LATERAL (SELECT unnest(CASE WHEN coalesce(len(fit), 0) = 0 THEN [NULL] WHEN len(list_filter(fit, lambda c: c.a > reached + 1)) > 0 THEN list_append(fit, NULL) ELSE fit END) AS c) k) y
        QUALIFY row_number() OVER (PARTITION BY user_id, b, reached ORDER BY explained DESC, used DESC, said DESC) = 1)
      SELECT user_id, explained, bit_count(said)::INTEGER AS n_words FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY explained DESC, used DESC, said DESC, reached DESC) AS k FROM g WHERE i = z + 1 AND b = z + 1) WHERE k = 1 AND explained > 0""",
}
