"""The statements of before as calls of the sequence operators; their SQL stays and is now written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import runs, sequences
from strandline.plans.run_queries import frames
from strandline.runtime import table

USER, ORDER = ["user_id"], ["t", "event_id"]


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sessions of each user, from the gaps between their events."""
    rows = sequences.sessions(frames(spark, sf_dir), USER, ORDER, "t", 21_600_000_000)
    return rows.groupBy("user_id", "session").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_events"), F.sum("v").alias("value_cents"))


def adjacent_key_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.equal_value_runs(frames(spark, sf_dir), USER, ORDER, "event_type")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n"))


def decreasing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.rising_runs(frames(spark, sf_dir), USER, ORDER, "v")
    return rows.groupBy("user_id", "run").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))


def running_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.running_reach(frames(spark, sf_dir), USER, ORDER, "v").select("event_id", "reach", "is_repeat")


def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.repeats(frames(spark, sf_dir), ["user_id", "event_type"], ORDER).select("event_id", "is_repeat")


def monotone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.kept_rising(frames(spark, sf_dir), USER, ORDER, "v").select("event_id", "user_id", "v")


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.first_rows(frames(spark, sf_dir), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


def mode_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.commonest(frames(spark, sf_dir), USER, "event_type", "event_id").select("user_id", "event_type", "n")


def cumulative_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.laid_out(frames(spark, sf_dir), USER, ORDER, "v").select("event_id", "start_at", "end_at")


def remove_and_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.laid_out(frames(spark, sf_dir).where("event_type <> 'error'"), USER, ORDER, "v").select("event_id", "v", "start_at")


def duplicate_and_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.with_copies(frames(spark, sf_dir), F.col("event_type") == "purchase")
    return sequences.laid_out(rows, USER, [*ORDER, "copy"], "v").select("event_id", "copy", "start_at")


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("v"))
    return sequences.filled_forward(frames(spark, sf_dir), USER, ORDER, bought, "filled").select("event_id", "filled")


def gap_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.gaps_closed(frames(spark, sf_dir), USER, ORDER, "t", 2_000_000).select("event_id", F.col("t").alias("start_t"), "end_t")


def median_gap_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.lead("t").over(Window.partitionBy("user_id").orderBy(*ORDER)) - F.col("t")
    return sequences.lower_median(frames(spark, sf_dir).withColumn("gap", gap).where("gap IS NOT NULL"), USER, ["gap", "event_id"], "gap")


def lru_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fits_cache(frames(spark, sf_dir), USER, [F.desc("t"), F.desc("event_id")], "v", 50_000).select("user_id", "event_id")


def dead_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.long_runs(frames(spark, sf_dir), USER, ORDER, F.col("v") < 3000, 2).select("user_id", F.col("from").alias("from_t"), F.col("to").alias("to_t"), "n")


def voice_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = sequences.long_runs(frames(spark, sf_dir), USER, ORDER, F.col("v") >= 2000, 3)
    return loud.groupBy("user_id").agg(F.min("from").alias("first_t"), F.max("to").alias("last_t"))


def floor_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rank_levels(frames(spark, sf_dir), USER, "v", {"level_v": 0.7}).select("user_id", "level_v")


def _lines(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(where).select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"))


def multiset_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.multiset_hits(_lines(spark, sf_dir, "l_linestatus = 'F'"), _lines(spark, sf_dir, "l_quantity > 25"), ["k"], "f")


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.where("event_id % 2 = 0").select("user_id", "event_type").exceptAll(rows.where("event_id % 3 = 0").select("user_id", "event_type"))


def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return sequences.set_changes(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "k")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    fresh = rows.where("k % 3 <> 0").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))
    return sequences.snapshot_changes(rows.where("k % 5 <> 0"), fresh, "k", "s")


def dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), "l_linenumber")
    return sequences.clusters(rows, ["l_orderkey"], "q", "l_linenumber", 2).select("l_orderkey", "weight", "a", "b")


QUERIES = {f.__name__: f for f in (
    session_gaps, adjacent_key_runs, decreasing_runs, running_reach, seen_before, monotone_filter, first_per_key, mode_per_key, cumulative_layout, remove_and_shift, duplicate_and_shift, forward_fill,
    gap_closing, median_gap_lower, lru_by_size, dead_stretches, voice_extent, floor_rank_percentile, multiset_hits, multiset_difference, symmetric_difference, snapshot_diff, dominant_cluster,
)}
