"""Queries of levels, placed spans, adopted words, swept thresholds and cleaned words, on each user's events and on benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import published, timing
from strandline.plans.caption_queries import spoken
from strandline.plans.clip_queries import moments
from strandline.plans.reading_queries import heard
from strandline.plans.run_queries import USER
from strandline.runtime import ship_package, table

HOUR = 3_600_000
GRID = {f"{pause}h{gap}": {"pause": pause * HOUR, "gap": gap * HOUR} for pause in (1, 2, 4, 8) for gap in (2, 6, 18)}


def local_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that 70 % of the levels around each event lie below, of those that are no silence."""
    ship_package(spark)
    rows = moments(spark, sf_dir).select("user_id", F.col("n").cast("long").alias("n"), (F.col("v") / 100.0 - 95).alias("level"))
    return timing.levels_around(rows, USER, "n", "level", 12, 0.7)


def placed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = heard(spark, sf_dir).withColumn("unit", F.floor(F.col("n") / 4))
    unit = Window.partitionBy("user_id", "unit")
    low, high = F.min("start").over(unit) + F.min("v").over(unit) * 1000, F.max("end").over(unit) - F.max("v").over(unit) * 500
    heard_there = (F.min("v").over(unit) % 3 != 0) & (low < high)
    edged = words.withColumns({"low": F.when(heard_there, low), "high": F.when(heard_there, high), "opens": F.col("unit") % 2 == 0})
    return timing.placed_spans(edged.select("user_id", "n", "start", "end", "unit", "opens", "low", "high"), USER, HOUR).select("user_id", "n", "start", "end")


def adopted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of seven words of each benchmark item of which five were matched; two are left over between them."""
    ship_package(spark)
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 5) / 7), F.lit(0)).cast("int"))
    each = words.where(F.size("w") >= 5).select("key", "w", F.explode(starts).alias("n"))
    first = F.col("n") * 7
    own, between = F.slice("w", first + 1, 5), F.when(F.col("n") > 0, F.slice("w", F.greatest(first - 1, F.lit(1)), 2)).otherwise(F.array().cast("array<string>"))
    # some phrases were heard with the words before them, some with the words after
    said = F.when((F.col("n") + F.col("key")) % 3 == 0, F.concat(between, own)).when((F.col("n") + F.col("key")) % 3 == 1, F.slice("w", first + 1, 7)).otherwise(own)
    rows = each.select(
        "key", "n", F.floor(F.col("n") / 3).alias("verse"), first.alias("first"), (first + 4).alias("last"), own.alias("words"), said.alias("said"), between.alias("between"),
        F.transform(between, lambda _: F.floor((F.col("n") - F.col("key") % 2) / 3)).alias("between_verses"), F.coalesce(F.try_element_at(between, F.lit(-1)).endswith(","), F.lit(False)).alias("closes"),
        F.when(F.col("n") % 5 == 4, F.length(F.get(between, F.lit(0))) > 3).alias("opens_word"),
    )
    return timing.adopted_words(rows, ["key"]).select("key", "n", "first", "last", F.floor(F.col("score") * 10_000 + 0.5).cast("long").alias("score"))


def swept_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each of twelve settings of two bars finds, of those that end with a verse or a long pause."""
    order = Window.partitionBy("user_id").orderBy("n")
    words = spoken(spark, sf_dir).withColumns({"gap": F.lead("start").over(order) - F.col("end"), "turns": F.lead("verse").over(order) != F.col("verse")})
    true = F.coalesce(F.col("turns") | (F.col("gap") >= 9 * HOUR) | (F.col("mark") & (F.col("gap") >= 3 * HOUR)), F.lit(True))
    line = F.count_if(true).over(order) - true.cast("int")
    expected = words.withColumn("line", line).groupBy("user_id", "line").agg(F.min_by("w", "n").alias("first_w"), F.max_by("w", "n").alias("last_w"))
    ends = lambda bar: F.col("turns") | (F.col("gap") >= bar["gap"]) | (F.col("mark") & (F.col("gap") >= bar["pause"]))
    return timing.swept(words, expected, USER, GRID, ends)


def published_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as published times of verses of thirty, some listed twice, too short, or out of order."""
    rows = heard(spark, sf_dir).where("w >= 0")
    v, n = F.col("v"), F.col("n")
    begins = n * 400 + v % 350
    words = rows.select("user_id", F.floor(n / 30).alias("verse"), ((n - F.when(v % 9 == 0, 3).when(v % 13 == 0, 1).otherwise(0)) % 30 + 1).cast("int").alias("word"), begins.alias("start"), (begins + 15 + v % 700).alias("end"), (F.col("event_type") == "purchase").alias("heard"))
    restarts = rows.where("v % 9 = 0 AND v % 2 = 0").select("user_id", F.floor(n / 30).alias("verse"), (begins + 100).alias("at"))
    sizes = words.select("user_id", "verse").distinct().withColumn("size", F.lit(28))
    return published.recited_words(words, sizes, ["user_id", "verse"], restarts, 250)


QUERIES = {f.__name__: f for f in (local_levels, placed_spans, adopted_words, swept_bars, published_words)}

_E = """e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) - 1704067200000 AS a FROM events),
  f AS (SELECT *, a + coalesce(CAST(floor((lead(a) OVER (PARTITION BY user_id ORDER BY n) - a) * 6 / 10) AS BIGINT), 1000) AS b, (n - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) % 40 AS w FROM e)"""
_LINES = "SELECT {k}, line, arg_min(w, n) AS x, arg_max(w, n) AS y FROM (SELECT *, coalesce(sum(t::INT) OVER (PARTITION BY {k} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM ({rows})) GROUP BY ALL"
ORACLES = {
    "local_levels": f"""WITH {_E}, l AS (SELECT user_id, n, list_sort(list(v / 100.0 - 95) FILTER (v / 100.0 - 95 > -90) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)) AS s FROM e)
      SELECT user_id, n, coalesce(s[1 + least(CAST(floor(len(s) * 0.7) AS BIGINT), len(s) - 1)], -90.0) AS around FROM l""",
    "placed_spans": f"""WITH {_E}, u AS (SELECT *, n // 4 AS unit, min(a) OVER q + min(v) OVER q * 1000 AS lo, max(b) OVER q - max(v) OVER q * 500 AS hi, min(v) OVER q % 3 <> 0 AS ok, min(n) OVER q AS f, max(n) OVER q AS l FROM f WINDOW q AS (PARTITION BY user_id, n // 4)),
      p AS (SELECT user_id, n, CASE WHEN NOT (ok AND lo < hi) THEN a WHEN n = f AND unit % 2 = 0 THEN lo ELSE least(greatest(a, lo), hi) END AS a, CASE WHEN NOT (ok AND lo < hi) THEN b WHEN n = l THEN hi ELSE least(greatest(b, lo), hi) END AS b FROM u),
      o AS (SELECT user_id, n, max(a) OVER (PARTITION BY user_id ORDER BY n) AS s, b, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY n), b) AS nx FROM p)
      SELECT user_id, n, s AS start, greatest(s + {HOUR}, least(b, greatest(nx, s + {HOUR})))::DOUBLE AS "end" FROM o""",
    "swept_bars": f"""WITH {_E}, x AS (SELECT user_id, n, w, v % 3 = 0 AS mark, lead(a) OVER (PARTITION BY user_id ORDER BY n) - b AS gap, CAST(floor(w / 10) AS BIGINT) <> lead(CAST(floor(w / 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY n) AS turns FROM f),
      g AS (SELECT p.p || 'h' || q.q AS setting, p.p * {HOUR} AS pause, q.q * {HOUR} AS bar FROM (SELECT unnest([1, 2, 4, 8]) AS p) p, (SELECT unnest([2, 6, 18]) AS q) q),
      want AS ({_LINES.format(k="user_id", rows=f"SELECT *, coalesce(turns OR gap >= {9 * HOUR} OR (mark AND gap >= {3 * HOUR}), true) AS t FROM x")}), got AS ({_LINES.format(k="setting, user_id", rows="SELECT *, gap IS NULL OR turns OR gap >= bar OR (mark AND gap >= pause) AS t FROM x, g")}),
      a AS (SELECT user_id, x, y, count(*) AS m FROM want GROUP BY ALL), b AS (SELECT setting, user_id, x, y, count(*) AS m FROM got GROUP BY ALL)
      SELECT setting, CAST(sum(least(b.m, coalesce(a.m, 0))) AS BIGINT) AS hits, CAST(sum(b.m) AS BIGINT) AS predicted FROM b LEFT JOIN a USING (user_id, x, y) GROUP BY setting""",
}
