"""Queries of recited runs, on benchmark items read with stretches said again, and on each user's events as two readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import recited
from strandline.plans.reading_queries import heard
from strandline.plans.run_queries import USER
from strandline.runtime import ship_package, table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's words as its script in units of three; heard with a stretch said twice and some words misheard."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    said = F.concat(F.slice("w", 1, 14), F.slice("w", 7, F.size("w")), F.slice("w", F.greatest(F.size("w") - 5, F.lit(1)), 6))
    misheard = F.transform(said, lambda w, i: F.when((i + F.col("key")) % 7 == 3, F.concat(w, F.lit("?"))).otherwise(w))
    return words.select("key", misheard.alias("heard"), F.col("w").alias("script"), F.transform("w", lambda _, i: F.floor(i / 3).cast("int")).alias("units"))


def recited_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return recited.recited_runs(_items(spark, sf_dir))


def heard_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many symbols were heard in each unit of each item."""
    ship_package(spark)
    return recited.heard_units(_items(spark, sf_dir)).groupBy("key", "unit").agg(F.count("*").alias("n"))


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What was heard, two readings of it and the letters of words: verses are stretches of twenty events."""
    rows = heard(spark, sf_dir).select("user_id", F.floor(F.col("n") / 20).alias("verse"), F.col("n").cast("long").alias("n"), (F.col("w") + 2).alias("w"), "v", "event_type")
    letter = lambda w: F.char(F.lit(97) + w % 26)
    said = rows.select("user_id", "verse", F.col("n").alias("t"), letter(F.when(F.col("v") % 8 == 0, F.col("w") + 5).otherwise(F.col("w"))).alias("letter"))
    held = rows.select("user_id", "verse", "n", F.when(F.col("event_type") == "error", F.col("w") + 2).otherwise(F.col("w")).alias("w"))
    other = rows.where("v % 50 <> 7").select("user_id", F.when(F.col("v") % 400 == 3, F.col("verse") + 1).otherwise(F.col("verse")).alias("verse"), "n", "w")
    spelled = spark.range(60).select(F.col("id").cast("int").alias("w"), letter(F.col("id")).alias("letters"))
    return said, held, other, spelled


def reading_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recited.group_gains(*_readings(spark, sf_dir), USER, "verse")


def chosen_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recited.chosen_reading(*_readings(spark, sf_dir), USER, "verse", least_gain=2)


QUERIES = {f.__name__: f for f in (recited_runs, heard_units, reading_gains, chosen_readings)}

_READ = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, event_type FROM events),
  h AS (SELECT user_id, n // 20 AS verse, n, v, event_type, (n - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) % 40 + 2 AS w FROM e),
  said AS (SELECT user_id, verse, string_agg(chr(97 + (CASE WHEN v % 8 = 0 THEN w + 5 ELSE w END % 26)::INT), '' ORDER BY n) AS said FROM h GROUP BY ALL),
  held AS (SELECT user_id, verse, n, CASE WHEN event_type = 'error' THEN w + 2 ELSE w END AS w FROM h), other AS (SELECT user_id, CASE WHEN v % 400 = 3 THEN verse + 1 ELSE verse END AS verse, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k, n, w FROM h WHERE v % 50 <> 7),
  a AS (SELECT user_id, verse, string_agg(chr(97 + (w % 26)::INT), '' ORDER BY n) AS x, list(w ORDER BY n) AS ws FROM held GROUP BY ALL HAVING max(n) - min(n) + 1 = count(*)),
  b AS (SELECT user_id, verse, string_agg(chr(97 + (w % 26)::INT), '' ORDER BY n) AS y, list(w ORDER BY n) AS wo, max(n) - min(n) + 1 = count(*) AS whole FROM other GROUP BY ALL),
  g AS (SELECT user_id, verse, levenshtein(said, x) - levenshtein(said, y) AS gain FROM said JOIN a USING (user_id, verse) JOIN b USING (user_id, verse) WHERE whole AND ws <> wo
    AND len(list_filter(range(2, len(wo) + 1), lambda i: wo[i] <= wo[i - 1])) >= greatest(2, 0.1 * len(list_distinct(wo))))"""
ORACLES = {
    "reading_gains": f"WITH {_READ} SELECT user_id, verse, CAST(gain AS INTEGER) AS gain FROM g",
    "chosen_readings": f"""WITH {_READ}, won AS (SELECT user_id, verse FROM g WHERE gain >= 2), s AS (SELECT user_id, verse, min(n) AS n FROM held SEMI JOIN won USING (user_id, verse) GROUP BY ALL),
      u AS (SELECT user_id, verse, w, n AS x, 0 AS y, false AS chosen FROM held ANTI JOIN won USING (user_id, verse) UNION ALL SELECT o.user_id, o.verse, o.w, s.n, o.n, true FROM other o JOIN s USING (user_id, verse))
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY x, y) - 1 AS place, verse, w, chosen FROM u""",
}
