"""Queries of the operators on runs: each user's events are a sequence of frames, their values the levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import runs
from strandline.operators.intervals import micros
from strandline.runtime import table

USER = ["user_id"]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, v, t, event_id, event_type): the events of each user numbered in time, those without one last, values in hundredths."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    events = table(spark, sf_dir, "events").select("user_id", cents.alias("v"), micros("ts").alias("t"), "event_id", "event_type")
    return runs.numbered(events, USER, [F.asc_nulls_last("t"), F.asc_nulls_last("event_id")])


def percentile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.percentile("v", F.lit(0.7)) - 600
    return frames(spark, sf_dir).groupBy("user_id").agg(F.floor(level * 100 + 0.5).cast("long").alias("bar"))


def calibrated_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's errors ask for, between 600 and 1000; the usual 800 where there are fewer than three."""
    stops = F.when(F.col("event_type") == "error", F.col("v") % 1700)
    asked = F.greatest(F.lit(600.0), F.least(F.lit(1000.0), F.median(stops) - 50))
    return frames(spark, sf_dir).groupBy("user_id").agg(F.when(F.count(stops) >= 3, asked).otherwise(800.0).alias("drop"))


def quiet_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.quiet_spans(frames(spark, sf_dir), USER, "n", "v", 6000, 800, 3000, 2)


def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.islands(frames(spark, sf_dir), USER, "n", F.col("v") < 8000, 2)


def certain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are at least 995 thousandths sure to be of one kind: here errors."""
    return runs.islands(frames(spark, sf_dir), USER, "n", F.col("event_type") == "error", 1)


def bridged_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.bridged_islands(frames(spark, sf_dir), USER, "n", "v", F.col("v") < 6000, 2, F.lit(14000), 3)


def still_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sampled_spans(frames(spark, sf_dir).where("event_type = 'click'").select("user_id", "t"), USER, "t", 43_200_000_000)


def same_kind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.equal_runs(frames(spark, sf_dir), USER, ["t", "event_id"], "event_type", "event_id")


def forward_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).dropDuplicates()
    return runs.forward_run(lines, ["l_orderkey"], order, "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("forward").alias("forward"))


def voiced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.any_between(frames(spark, sf_dir), USER, ["n"], F.col("event_type") == "error", F.col("v") > 15000)


def reached_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = frames(spark, sf_dir).select("user_id", "event_id", "n", F.col("t").alias("start"), (F.col("t") + 60_000_000).alias("end"))
    return runs.reach_ends(spans, USER, ["n"], F.lit(1_704_067_200_000_000), F.lit(1_735_689_600_000_000)).select("event_id", "start", "end")


def settled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the events in the order of their numbers, those of errors missing and every ninth one out of order."""
    line = frames(spark, sf_dir).withColumn("time", F.when(F.col("event_type") == "error", None).when(F.col("event_id") % 9 == 4, F.col("t") - 400_000_000_000).otherwise(F.col("t")))
    whole = Window.partitionBy("user_id")
    bounded = line.withColumns({"a": F.min("t").over(whole), "b": F.max("t").over(whole) + 1_000_000})
    return runs.settled_times(bounded, USER, ["n"], "time", F.col("a"), F.col("b")).select("event_id", "settled")


def marked_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("n")
    spans = frames(spark, sf_dir).select("user_id", "event_id", "n", F.col("t").alias("start"), F.lead("t").over(order).alias("end"))
    mark = F.floor((F.col("start") + F.col("end")) / 2) - F.when(F.col("user_id") % 3 == 0, 900_000_000_000).otherwise(0)
    return runs.mark_boundary(spans, USER, ["n"], 1, mark).select("event_id", "start", "end")


def phrase_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.agreed_ends(frames(spark, sf_dir), USER, ["n"], F.col("v") >= 8000).select("user_id", "t", "event_id")


def lag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = runs.correlation_by_lag(frames(spark, sf_dir), USER, ["n"], "v", [1, 2, 3, 4])
    return scores.select("user_id", "lag", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("millionths"))


def best_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = runs.correlation_by_lag(frames(spark, sf_dir), USER, ["n"], "v", [1, 2, 3, 4])
    return runs.best_lag(scores.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5)), USER).select("user_id", "lag")


def starved_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("n")
    samples = frames(spark, sf_dir).withColumn("gap", F.col("t") - F.lag("t").over(order)).where("gap IS NOT NULL")
    return runs.starved(samples, USER, "v", "gap", 0.000_000_2)


def health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen, choppy or clean, by the starved share of a user's time and the mean rate."""
    found = starved_time(spark, sf_dir)
    verdict = F.when(F.col("starved") * 5 >= F.col("recorded") * 4, "frozen").when(F.col("starved") * 2 >= F.col("recorded"), "choppy").otherwise("clean")
    return found.select("user_id", verdict.alias("verdict"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by priority and line count of the calendar: one year only, or what was asked for."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return runs.passage(orders, ["o_custkey", "o_orderstatus"], "y", "m", (0, 1, 12))


def primary_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return runs.primary_summary(orders, ["o_custkey"], ["o_orderkey"], "y", "m")


def letter_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters for each letter of a language's documents, in millionths; 0 where there is no letter."""
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", "")).cast("long").alias("letters"))
    sums = docs.groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.sum("letters").alias("letters"))
    return sums.select("lang", F.when(F.col("letters") > 0, F.floor(F.col("chars") * 1_000_000 / F.col("letters"))).otherwise(0).cast("long").alias("pace"))


QUERIES = {f.__name__: f for f in (
    percentile_levels, calibrated_drops, quiet_spans, blank_runs, certain_runs, bridged_dips, still_samples, same_kind_rows, forward_runs, voiced_parts, reached_ends,
    settled_times, marked_boundaries, phrase_ends, lag_scores, best_lags, starved_time, health_verdicts, passages, primary_summaries, letter_pace,
)}

_E = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, epoch_us(ts) AS t, event_id, event_type FROM events)"
_ISLANDS = "(SELECT user_id, min(n) AS start, max(n) + 1 AS \"end\" FROM (SELECT user_id, n, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run, ok FROM {of}) WHERE ok GROUP BY user_id, run HAVING count(*) >= {least})"
_CORR = "p AS (SELECT a.user_id, k.lag, corr(a.v, b.v) AS c, count(*) AS m, stddev_pop(a.v) AS sa, stddev_pop(b.v) AS sb FROM e a CROSS JOIN (VALUES (1), (2), (3), (4)) k(lag) JOIN e b ON b.user_id = a.user_id AND b.n = a.n + k.lag GROUP BY 1, 2), q AS (SELECT user_id, lag, CAST(floor(c * 1e6 + 0.5) AS BIGINT) AS millionths FROM p WHERE m >= 2 AND sa > 0 AND sb > 0)"
_STARVED = "g AS (SELECT user_id, v, t - lag(t) OVER (PARTITION BY user_id ORDER BY n) AS gap FROM e), r AS (SELECT user_id, CAST(sum(gap) AS BIGINT) AS recorded, CAST(sum(CASE WHEN v / gap < 0.0000002 THEN gap ELSE 0 END) AS BIGINT) AS starved FROM g WHERE gap > 0 GROUP BY user_id)"

ORACLES = {
    "percentile_levels": f"WITH {_E} SELECT user_id, CAST(floor((quantile_cont(v, 0.7) - 600) * 100 + 0.5) AS BIGINT) AS bar FROM e GROUP BY user_id",
    "calibrated_drops": f"WITH {_E}, s AS (SELECT user_id, median(v % 1700) AS m, count(*) AS k FROM e WHERE event_type = 'error' GROUP BY user_id) SELECT u.user_id, CASE WHEN coalesce(k, 0) >= 3 THEN greatest(600.0, least(1000.0, m - 50)) ELSE 800.0 END::DOUBLE AS drop FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN s USING (user_id)",
    "quiet_spans": f"WITH {_E}, b AS (SELECT user_id, list_sort(list(v)) AS s FROM e GROUP BY user_id), h AS (SELECT user_id, s[CAST(floor(len(s) * 0.7) AS INT) + 1] AS hi, s[CAST(floor(len(s) * 0.05) AS INT) + 1] AS lo FROM b), f AS (SELECT e.user_id, n, v < greatest(hi - 6000, lo + 800) AS ok FROM e JOIN h USING (user_id) WHERE hi - lo >= 3000) SELECT * FROM {_ISLANDS.format(of='f', least=2)} z",
    "blank_runs": f"WITH {_E}, f AS (SELECT user_id, n, v < 8000 AS ok FROM e) SELECT * FROM {_ISLANDS.format(of='f', least=2)} z",
    "certain_runs": f"WITH {_E}, f AS (SELECT user_id, n, event_type = 'error' AS ok FROM e) SELECT * FROM {_ISLANDS.format(of='f', least=1)} z",
    # islands, then joined pair by pair: a join is allowed where the gap is short and all of it quiet
    "bridged_dips": f"""WITH {_E}, f AS (SELECT user_id, n, v < 6000 AS ok FROM e), i AS {_ISLANDS.format(of='f', least=1)}, g AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start) AS was FROM i),
      j AS (SELECT g.*, CASE WHEN was IS NOT NULL AND start - was <= 2 AND (SELECT max(v) FROM e WHERE e.user_id = g.user_id AND e.n >= was AND e.n < g.start) < 14000 THEN 0 ELSE 1 END AS opens FROM g),
      k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start) AS run FROM j) SELECT user_id, min(start) AS start, max("end") AS "end", CAST(sum("end" - start) AS BIGINT) AS held FROM k GROUP BY user_id, run HAVING sum("end" - start) >= 3""",
    "still_samples": f"""WITH {_E}, c AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS was FROM e WHERE event_type = 'click'), r AS (SELECT *, sum(CASE WHEN t - was - 43200000000 <= 43632000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM c)
      SELECT user_id, min(t) AS start, max(t) + 43200000000 AS "end" FROM r GROUP BY user_id, run""",
    "same_kind_rows": f"WITH {_E}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY n) - 1 AS run FROM c) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY n) AS text FROM r GROUP BY user_id, run, event_type",
    # of rows that stand in one order, l_linenumber first, the longest run from each number
    "forward_runs": """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x FROM lineitem), w AS (SELECT o, k, row_number() OVER (PARTITION BY o ORDER BY k, p, s, x) AS r FROM l),
      m AS (SELECT w.o, w.k, w.r, (SELECT min(z.r) FROM w z LEFT JOIN w y ON y.o = z.o AND y.r = z.r + 1 WHERE z.o = w.o AND z.r >= w.r AND (y.k IS NULL OR y.k <> z.k + 1)) AS last FROM w)
      SELECT o AS l_orderkey, k AS l_linenumber, max(last - r + 1) AS forward FROM m GROUP BY o, k""",
    "voiced_parts": f"WITH {_E}, p AS (SELECT user_id, v, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS part FROM e) SELECT user_id, CAST(part AS BIGINT) AS part, max(v) > 15000 AS found FROM p GROUP BY user_id, part",
    "reached_ends": f'WITH {_E}, b AS (SELECT user_id, max(n) AS m FROM e GROUP BY user_id) SELECT event_id, CASE WHEN n = 0 THEN least(t, 1704067200000000) ELSE t END AS start, CASE WHEN n = m THEN greatest(t + 60000000, 1735689600000000) ELSE t + 60000000 END AS "end" FROM e JOIN b USING (user_id)',
    "settled_times": f"""WITH {_E}, x AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS a, max(t) OVER (PARTITION BY user_id) + 1000000 AS b, count(*) OVER (PARTITION BY user_id) AS size,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 9 = 4 THEN t - 400000000000 ELSE t END AS given FROM e), y AS (SELECT *, CASE WHEN given IS NULL THEN NULL ELSE greatest(given, a) END AS g FROM x),
      k AS (SELECT *, CASE WHEN g >= coalesce(max(g) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) THEN g END AS known FROM y),
      r AS (SELECT *, max(CASE WHEN known IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i, min(CASE WHEN known IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM k)
      SELECT r.event_id, CAST(coalesce(r.known, coalesce(p.known, r.a) + floor(((coalesce(q.known, r.b) - coalesce(p.known, r.a)) * (r.n - coalesce(r.i, -1))) / (coalesce(r.j, r.size) - coalesce(r.i, -1)))) AS BIGINT) AS settled
      FROM r LEFT JOIN k p ON p.user_id = r.user_id AND p.n = r.i LEFT JOIN k q ON q.user_id = r.user_id AND q.n = r.j""",
    "marked_boundaries": f"""WITH {_E}, s AS (SELECT user_id, event_id, n, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY n) AS b FROM e), m AS (SELECT user_id, CAST(floor((a + b) / 2) AS BIGINT) - CASE WHEN user_id % 3 = 0 THEN 900000000000 ELSE 0 END AS mark, a FROM s WHERE n = 1), k AS (SELECT user_id, mark FROM m WHERE mark > a)
      SELECT event_id, CASE WHEN n = 2 THEN coalesce(mark, a) ELSE a END AS start, CASE WHEN n = 1 THEN coalesce(mark, b) ELSE b END AS "end" FROM s LEFT JOIN k USING (user_id)""",
    "phrase_ends": f"WITH {_E} SELECT a.user_id, a.t, a.event_id FROM e a JOIN e b ON b.user_id = a.user_id AND b.n = a.n + 1 WHERE a.v >= 8000 AND b.v >= 8000",
    "lag_scores": f"WITH {_E}, {_CORR} SELECT user_id, lag, millionths FROM q",
    "best_lags": f"WITH {_E}, {_CORR} SELECT user_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY millionths DESC, lag) AS r FROM q) WHERE r = 1",
    "starved_time": f"WITH {_E}, {_STARVED} SELECT user_id, recorded, starved FROM r",
    "health_verdicts": f"WITH {_E}, {_STARVED} SELECT user_id, CASE WHEN starved >= recorded * 0.8 THEN 'frozen' WHEN starved >= recorded * 0.5 THEN 'choppy' ELSE 'clean' END AS verdict FROM r",
    "passages": "WITH o AS (SELECT o_custkey, o_orderstatus, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), g AS (SELECT o_custkey, o_orderstatus, min(y) = max(y) AS one, min(y) AS y, min(m) AS a, max(m) AS b FROM o GROUP BY 1, 2) SELECT o_custkey, o_orderstatus, CASE WHEN one THEN y ELSE 0 END AS chapter, CASE WHEN one THEN a ELSE 1 END AS first, CASE WHEN one THEN b ELSE 12 END AS last FROM g",
    "primary_summaries": """WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS l FROM o),
      g AS (SELECT o_custkey, max(CASE WHEN f = 1 THEN y END) AS c, max(CASE WHEN f = 1 THEN m END) AS a, max(CASE WHEN l = 1 THEN m END) AS b, count(DISTINCT y) AS k FROM r GROUP BY o_custkey) SELECT o_custkey, c AS chapter, a AS first, CASE WHEN k = 1 THEN b ELSE a END AS last, k AS chapters FROM g""",
    "letter_pace": "WITH d AS (SELECT lang, n_chars, len(regexp_extract_all(coalesce(text, ''), '[a-z]')) AS k FROM documents) SELECT lang, CASE WHEN sum(k) > 0 THEN CAST(floor(CAST(sum(n_chars) AS BIGINT) * 1000000 / CAST(sum(k) AS BIGINT)) AS BIGINT) ELSE 0 END AS pace FROM d GROUP BY lang",
}
