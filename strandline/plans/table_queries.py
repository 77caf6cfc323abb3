"""Queries of the table operators. Their SQL is the statement of the same name, which Spark does not run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import tables
from strandline.operators.intervals import micros
from strandline.runtime import table

HOUR = 3_600_000_000
ORDER, USER, LINE = ["l_orderkey"], ["user_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("t"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("nxt", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).where("nxt IS NOT NULL")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return tables.upsert(held, held.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("U")), ["o_orderkey"])


def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return tables.without_keys(held, held.where("o_orderkey % 4 = 0"), ["o_orderkey"])


def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.restated(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"P": "O"})


def key_group_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.overridden(_orders(spark, sf_dir), ["o_custkey"], building, "o_orderstatus", F.lit("B")).select("o_orderkey", "o_orderstatus")


def keyed_inner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tables.looked_up(table(spark, sf_dir, "labels").select("doc_id", "quality"), texts, ["doc_id"])


def fill_empty_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = tables.looked_up(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], {"quality": -1})
    return met.select("doc_id", F.when((F.col("n_chars") == 0) | F.col("lang").isNull(), "unknown").otherwise(F.col("lang")).alias("lang"), "quality")


def bounds_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tables.bounds(_orders(spark, sf_dir).withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_totalprice")
    met = tables.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), spans.select("c_custkey", F.col("size").alias("n"), F.floor("low").cast("long").alias("lo")), ["c_custkey"], {"n": 0, "lo": 0})
    return met


def present_or_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned"))
    # an order without lines is one row of the join
    met = tables.looked_up(_orders(spark, sf_dir).select("o_orderkey"), lines, ["o_orderkey"], {"n": 1})
    return met.select("o_orderkey", "n", F.when(F.col("returned").isNull(), "never").otherwise("returned").alias("state"))


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    return tables.covered(rows, tables.bounds(rows, ORDER, "l_linenumber", F.col("l_returnflag") == "R"), ORDER, "l_linenumber").drop("l_returnflag")


def skipped_interior_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag")
    return tables.skipped_inside(rows, ORDER, "l_linenumber", F.col("l_returnflag") != "N").drop("l_returnflag")


def midpoint_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    middles = _spans(spark, sf_dir).select("user_id", "event_id", F.floor((F.col("t") + F.col("nxt")) / 2).alias("mid"))
    near = _events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), (F.col("t") - HOUR).alias("start"), (F.col("t") + HOUR).alias("end"))
    return tables.points_in_spans(middles, near, USER, "mid", 2 * HOUR).select("event_id", "span_id")


def missing_on_some_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing_somewhere(table(spark, sf_dir, "events"), "user_id", "event_type").withColumnRenamed("without", "users_without")


def recent_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    return tables.ranked(_orders(spark, sf_dir).orderBy(*order).limit(50), [], order).select("o_orderkey", F.col("place").cast("long").alias("place"))


def gallery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("c_acctbal") < 0, F.desc("c_acctbal"), F.asc("c_custkey")]
    return tables.ranked(table(spark, sf_dir, "customer"), ["c_nationkey"], order).select("c_custkey", F.col("place").cast("long").alias("place"))


def best_fit_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("s_acctbal") < 5000, F.abs(F.col("s_acctbal") - 5000), F.asc("s_suppkey")]
    return tables.ranked(table(spark, sf_dir, "supplier"), ["s_nationkey"], order, 4).select("s_nationkey", "s_suppkey", F.col("place").cast("long").alias("place"))


def longest_first_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ranked(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 8).select("source", "doc_id", "n_chars")


def recently_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("t").alias("t"))
    return tables.ranked(used, USER, [F.desc("t"), F.asc("event_type")], 3).select("user_id", "event_type", F.col("place").cast("long").alias("place"))


def lru_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.within_budget(_events(spark, sf_dir), USER, [F.desc("t"), F.desc("event_id")], "v", 50_000, True).select("user_id", "event_id")


def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.within_budget(table(spark, sf_dir, "documents"), ["source"], [F.asc("doc_id")], "n_chars", 20_000).select("source", "doc_id")


def removed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.without_keys(table(spark, sf_dir, "customer").select("c_custkey"), _orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def id_set_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).where("event_type IN ('signup', 'error')")
    return tables.last_entries(log, "user_id", "event_id", ["event_type"]).where("event_type = 'signup'").select("user_id")


def mutation_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = tables.last_entries(_events(spark, sf_dir), "user_id", "event_id", ["event_type"])
    return last.select("user_id", F.when(F.col("event_type") == "error", "deleted").otherwise("snapshot").alias("state"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tables.bounds(_orders(spark, sf_dir).withColumn("d", micros("o_orderdate")), ["o_custkey"], "d", F.col("o_orderstatus") != "P")
    return spans.select("o_custkey", F.col("high").alias("latest_t"), F.col("size").alias("segments"))


def next_flagged_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_around(_lines(spark, sf_dir).where("l_discount > 0.05"), ORDER, "l_linenumber", 3, 7)


def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = _spans(spark, sf_dir).withColumn("off", F.abs(F.col("nxt") - F.col("t") - 24 * HOUR))
    return tables.ranked(off, USER, [F.asc("off"), F.asc("event_id")], 1).where(F.col("off") <= 12 * HOUR).select("user_id", "event_id", "off")


def widened_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tables.bounds(_lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), micros("l_shipdate").alias("d")), ["o_orderkey"], "d")
    met = tables.looked_up(_orders(spark, sf_dir).select("o_orderkey", micros("o_orderdate").alias("d")), spans, ["o_orderkey"])
    slack = 720 * HOUR
    return met.select("o_orderkey", F.col("d").between(F.col("low") - slack, F.col("high") + slack).alias("agrees"), F.abs(F.col("high") - F.col("low")).alias("width"))


def share_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.col("nxt") - F.col("t") <= 6 * HOUR
    return _spans(spark, sf_dir).groupBy("user_id").agg(tables.share_agrees(near, (8, 10)).alias("agrees"))


def majority_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_orderkey").agg(tables.share_agrees(F.col("l_returnflag") == "N", (1, 2), True).alias("mostly"))


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return tables.stale(events, USER, "t", events.agg(F.max("t").alias("now")), 144 * HOUR)


def range_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    found = tables.bounds(lines, ORDER, "l_linenumber", F.col("l_quantity") > 10).drop("size")
    wanted = tables.bounds(lines, ORDER, "l_linenumber").select("l_orderkey", F.col("low").alias("a"), F.col("high").alias("b"))
    met = wanted.join(found, ORDER, "left")
    return met.select("l_orderkey", tables.range_verdict(F.col("low"), F.col("high"), F.col("a"), F.col("b")).alias("verdict"))


def gap_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda where, name: _lines(spark, sf_dir).where(where).groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias(name))
    met = count("l_quantity > 25", "found").join(count("l_extendedprice > 30000", "wanted"), "k", "full")
    return met.select("k", tables.gap_verdict(F.col("found"), F.col("wanted")).alias("verdict"))


def window_or_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("nxt", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    files = events.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("nxt").alias("hi"))
    opens, closes = tables.view_window(F.col("t"), F.col("nxt"), F.col("lo"), F.col("hi"), 5_000_000, 50_000)
    return tables.looked_up(events.where("nxt IS NOT NULL"), files, USER).select("event_id", opens.alias("view_from"), closes.alias("view_to"))


def edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct(*LINE)
    spans = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min_by("l_returnflag", at).alias("x"), F.max_by("l_returnflag", at).alias("y"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return spans.select("l_orderkey", tables.edge_label(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("label"))


QUERIES = {f.__name__: f for f in (
    upsert, delete_by_key, job_recovery, key_group_update, keyed_inner_lookup, fill_empty_only, bounds_or_zero, present_or_absent, coverage_matrix, skipped_interior_keys, midpoint_containment, missing_on_some_row,
    recent_top, gallery_order, best_fit_choice, longest_first_cap, recently_used, lru_by_size, prefix_budget, removed_keys, id_set_from_log, mutation_reduction, latest_snapshot, next_flagged_circular, nearest_candidate,
    widened_agreement, share_within_tolerance, majority_test, staleness, range_verdicts, gap_verdicts, window_or_whole, edge_labels,
)}
