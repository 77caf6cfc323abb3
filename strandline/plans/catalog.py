"""All queries of the library's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import edits, folds, intervals, library, location, lookups, positions, timelines
from strandline.plans import caption_queries, clip_queries, format_queries, line_queries, matching_queries, phrase_queries, publish_queries, reading_queries, recited_queries, record_queries, run_queries, script_queries, sequence_queries, stop_queries, table_queries, timing_queries
from strandline.plans.dialect import duck_sql, spark_query
from strandline.runtime import dealt, ship_package, table

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "session_gaps"
STATEMENTS = timelines.STATEMENTS | intervals.STATEMENTS | library.STATEMENTS | lookups.STATEMENTS | edits.STATEMENTS | scalars.STATEMENTS
DAY, QUARTER = 86_400_000_000, 21_600_000_000


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event up to the next one of its user."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", intervals.micros("ts").alias("t")).withColumn("nxt", F.lead("t").over(order))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).where("nxt > t").select("user_id", "event_id", F.col("t").alias("l_start"), F.col("nxt").alias("l_end"))
    quiet = _spans(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), (F.col("t") - QUARTER).alias("r_start"), (F.col("t") + QUARTER).alias("r_end"))
    return intervals.overlap_join(spans, quiet, ["user_id"], DAY).select("user_id", "event_id", "error_id")


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _spans(spark, sf_dir)
    purchases = events.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("purchase_id")).groupBy("user_id", "t").agg(F.max("purchase_id").alias("purchase_id"))
    return intervals.asof_join(events.where("event_type = 'click'").select("event_id", "user_id", "t"), purchases, "user_id", "t", "purchase_id").select("event_id", "purchase_id")


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("user_id", (F.col("t") - QUARTER).alias("start"), (F.col("t") + QUARTER).alias("end"))


def coalesced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce_spans(_around(spark, sf_dir), ["user_id"], 60_000_000)


def span_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.complement(_around(spark, sf_dir), ["user_id"])


def dashboard_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each UTC day, days without any included."""
    counted = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = counted.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counted, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted phrase index: 3-word phrases that stand in two documents or more, and in how many."""
    words = F.filter(F.split("text", "[^a-z]+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= 3)
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"), F.slice("w", 3, F.size("w")).alias("c"))
    phrases = F.transform(F.slice(zipped, 1, F.size("w") - 2), lambda g: F.concat_ws(" ", g["a"], g["b"], g["c"]))
    # a text's own repeats are added up inside its row: sorted, they are runs, and each run is one row
    runs = d.select("doc_id", F.sort_array(phrases).alias("s"))
    runs = runs.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))))
    own = F.transform("at", lambda i, k: F.struct(F.get("s", i).alias("phrase"), (F.coalesce(F.get("at", k + 1), F.size("s")) - i).cast("long").alias("own")))
    each = runs.select("doc_id", F.explode(own).alias("r")).select("doc_id", "r.phrase", "r.own")
    # dealt once by the phrase, which serves both counts: a document of several rows counts once
    met = dealt(each, ["phrase"]).groupBy("phrase", "doc_id").agg(F.sum("own").alias("own"))
    return met.groupBy("phrase").agg(F.count("doc_id").alias("n_docs"), F.sum("own").alias("n")).where("n_docs >= 2")


_WORD_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def corpus_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each word in the order of the whole corpus."""
    words = table(spark, sf_dir, "lineitem").select(*_WORD_ORDER)
    return positions.positions(words, _WORD_ORDER).select("l_orderkey", "l_linenumber", "place")


def position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus position of the first word of each order, by its key."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return positions.position_of(keys, corpus_positions(spark, sf_dir), ["l_orderkey", "l_linenumber"]).select("o_orderkey", "place")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", intervals.micros("ts").alias("t"), cents.alias("v"))


def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return folds.rate_limited(_values(spark, sf_dir))


def truncated_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return folds.truncated(_around(spark, sf_dir), 800_000)


def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = _values(spark, sf_dir).select("event_id", "t", F.col("user_id").alias("visitor"), (F.col("event_id") % 16).alias("queue"))
    return folds.queue_replay(rows)


def going_back_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return folds.going_back(_values(spark, sf_dir))


def read_again_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return folds.read_again(_values(spark, sf_dir))


def jump_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item read with its first words said twice, against the item."""
    ship_package(spark)
    words = F.split(F.coalesce("text", F.lit("")), " ")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.concat(F.slice(words, 1, 4), words).alias("heard"), words.alias("script"))
    return folds.jump_alignment(rows)


def phrase_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return location.located(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


#: Queries that SQL cannot express; the tests compare them with plain loops.
FOLDS: dict[str, Query] = {f.__name__: f for f in (rate_limiter, truncated_timeline, queue_replay, going_back_passes, jump_alignment, phrase_location)}

_SPANS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events), s AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM e)"
_MERGED = """a AS (SELECT user_id, t - 21600000000 AS a, t + 21600000000 AS b FROM e),
  m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS starts FROM a),
  r AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m),
  g AS (SELECT user_id, min(a) AS a, max(b) AS b FROM r GROUP BY user_id, run)"""
_PLACES = "p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST) - 1 AS place FROM lineitem)"

FRAMES: dict[str, tuple[Query, str]] = {
    "overlap_join": (overlap_join, f"WITH {_SPANS} SELECT l.user_id, l.event_id, r.event_id AS error_id FROM s l JOIN s r ON r.user_id = l.user_id AND r.event_type = 'error' AND l.nxt > l.t AND l.nxt > r.t - 21600000000 AND l.t < r.t + 21600000000"),
    "asof_join": (asof_join, f"WITH {_SPANS} SELECT l.event_id, (SELECT max_by(r.event_id, (r.t, r.event_id)) FROM e r WHERE r.user_id = l.user_id AND r.event_type = 'purchase' AND r.t <= l.t) AS purchase_id FROM e l WHERE l.event_type = 'click'"),
    "coalesced_spans": (coalesced_spans, f"WITH {_SPANS}, {_MERGED.format(gap=60_000_000)} SELECT user_id, a AS start, b AS \"end\" FROM g"),
    "span_complement": (span_complement, f"WITH {_SPANS}, {_MERGED.format(gap=0)}, c AS (SELECT user_id, b AS start, lead(a) OVER (PARTITION BY user_id ORDER BY a) AS \"end\" FROM g) SELECT * FROM c WHERE \"end\" IS NOT NULL"),
    "dashboard_days": (dashboard_days, "WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), r AS (SELECT unnest(generate_series((SELECT min(d) FROM c), (SELECT max(d) FROM c), INTERVAL 1 DAY)) AS d) SELECT strftime(r.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM r LEFT JOIN c ON c.d = CAST(r.d AS DATE)"),
    "read_again_spans": (read_again_spans, f"""WITH {_SPANS}, v AS (SELECT event_id, user_id, t, CAST(floor((SELECT value FROM events x WHERE x.event_id = e.event_id) * 100 + 0.5) AS BIGINT) AS v FROM e),
      a AS (SELECT *, coalesce(v <= max(v) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM v),
      g AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM a) SELECT user_id, min(t) AS start, coalesce(arg_max(nxt, (t, event_id)), max(t)) AS "end" FROM g WHERE again GROUP BY user_id, run"""),
    "corpus_positions": (corpus_positions, f"WITH {_PLACES} SELECT l_orderkey, l_linenumber, place FROM p"),
    "position_lookup": (position_lookup, f"WITH {_PLACES}, k AS (SELECT l_orderkey, max(place) AS place FROM p WHERE l_linenumber = 1 GROUP BY l_orderkey) SELECT o_orderkey, place FROM orders LEFT JOIN k ON l_orderkey = o_orderkey"),
    "repeated_phrases": (repeated_phrases, "WITH d AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents), p AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS phrase FROM d) SELECT phrase, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM p GROUP BY phrase HAVING count(DISTINCT doc_id) >= 2"),
}


#: Modules whose SQL is written apart from the operators they call.
MODULES = (script_queries, run_queries, clip_queries, record_queries, reading_queries, format_queries, matching_queries, caption_queries, phrase_queries, recited_queries, timing_queries, stop_queries, publish_queries)


def queries() -> dict[str, Query]:
    apart = {name: f for module in MODULES for name, f in module.QUERIES.items()}
    return apart | _plain() | sequence_queries.QUERIES | table_queries.QUERIES | line_queries.QUERIES


def _plain() -> dict[str, Query]:
    return {name: spark_query(text) for name, text in STATEMENTS.items()} | {name: f for name, (f, _) in FRAMES.items()} | FOLDS


def oracle_sql() -> dict[str, str]:
    apart = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
    return apart | {name: duck_sql(text) for name, text in STATEMENTS.items()} | {name: sql for name, (_, sql) in FRAMES.items()}
