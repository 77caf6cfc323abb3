"""Queries of the line operators. Their SQL is the statement of the same name, which Spark does not run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import lines, tables
from strandline.operators.intervals import micros
from strandline.plans.table_queries import HOUR, LINE, ORDER, USER, _events, _lines, _orders, _spans
from strandline.runtime import table

TIME = ["t", "event_id"]


def unsure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = lines.with_neighbour(_lines(spark, sf_dir), ORDER, LINE, ["l_quantity"], -1, "was_")
    return tables.bounds(met, ORDER, "l_linenumber", F.abs(F.col("l_quantity") - F.col("was_l_quantity")) > 30).select("l_orderkey", F.col("low").alias("first_unsure"))


def consecutive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = lines.with_neighbour(_lines(spark, sf_dir), ORDER, LINE, ["l_suppkey"], -1, "was_")
    return met.where("l_suppkey = was_l_suppkey + 1").select("l_orderkey", "l_linenumber")


def late_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = lines.with_neighbour(_events(spark, sf_dir), ["user_id", "event_type"], TIME, ["v"], -1, "was_")
    return met.where("v < was_v OR event_type = 'signup'").select("event_id", "t")


def transition_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = lines.with_neighbour(_events(spark, sf_dir), USER, TIME, ["t"], -1, "was_")
    return met.select("event_id", (F.col("was_t") - 350_000).alias("from_t"), (F.col("t") + 350_000).alias("to_t"))


def swap_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.swapped_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", "user")


def phrase_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.twins(_lines(spark, sf_dir), ORDER, "l_linenumber", ["l_returnflag", "l_linestatus"], 2)


def equal_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.equal_stretches(_lines(spark, sf_dir), ORDER, "l_linenumber", "l_returnflag")


def first_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    edited = tables.bounds(orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "P").select("o_custkey", F.col("low").alias("edited"))
    met = tables.bounds(orders, ["o_custkey"], "o_orderkey").join(edited, "o_custkey", "left")
    return met.select("o_custkey", F.coalesce("edited", "low").alias("chosen"))


def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_entries(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", ["n_name"])


def jobs_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.first_of(_orders(spark, sf_dir), ["o_custkey", "o_orderpriority"], F.col("o_orderkey"), ["o_orderkey"], F.col("o_orderstatus") != "F")


def group_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    latest = F.struct((-micros("o_orderdate")).alias("d"), F.col("o_orderkey"))
    first = lines.first_of(orders, ["o_custkey"], latest, ["o_orderkey", "o_orderstatus"])
    return first.join(tables.bounds(orders, ["o_custkey"], "o_orderkey").select("o_custkey", F.col("size").alias("n")), "o_custkey")


def bucketed_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.peaks(_events(spark, sf_dir), USER, "t", "v", 24 * HOUR).withColumnRenamed("bucket", "day")


def incremental_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.wider_peaks(lines.peaks(_events(spark, sf_dir), USER, "t", "v", 24 * HOUR), USER, 7).select("user_id", F.col("bucket").alias("week"), "peak")


def level_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.hop_energy(_events(spark, sf_dir), USER, TIME, "v", 4)


def clock_map_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = lines.with_neighbour(_events(spark, sf_dir), USER, TIME, ["t"], 1, "next_")
    cut = met.withColumn("cut", F.when((F.col("event_type") == "error") & F.col("next_t").isNotNull(), F.col("next_t") - F.col("t")).otherwise(0))
    return lines.cut_before(cut, USER, "t", "cut").select("event_id", F.col("mapped").alias("mapped_t"))


def order_preserving_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.forward_clamp(_events(spark, sf_dir), USER, TIME, "v", 500).select("event_id", "start_v", "end_v")


def feasibility_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.least_frames(_lines(spark, sf_dir), ORDER, LINE, "l_returnflag")


def path_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lines.path_spans(_lines(spark, sf_dir), ORDER, LINE, "l_returnflag", "N")
    return spans.select("l_orderkey", F.col("l_returnflag").alias("f"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


def collapsed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.collapsed(_lines(spark, sf_dir), ORDER, LINE, "l_returnflag", "N").select("l_orderkey", F.col("i").cast("long").alias("i"), F.col("l_returnflag").alias("f"))


def split_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_at(_spans(spark, sf_dir).where("nxt > t"), "t", "nxt", 1_705_000_000_000_000).select("event_id", "part", "a", "b")


def retimed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.retimed(_spans(spark, sf_dir), "t", "nxt", 1_704_067_200_000_000, (4, 5), 50_000).select("event_id", "a", "b")


def seam_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.seams(_lines(spark, sf_dir), ORDER, LINE, "l_linenumber")


def http_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("doc_id") % 3000
    header = F.concat(F.lit("bytes="), first.cast("string"), F.lit("-"), F.when(F.col("doc_id") % 2 == 0, (first + 99).cast("string")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", lines.byte_range(header, F.col("n_chars")).alias("r")).select("doc_id", "r.*")


def deduplicated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.numbered_name(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_partkey", F.col("unique").alias("name"))


def digit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", lines.digits(F.col("c_custkey").cast("string"), "٠١٢٣٤٥٦٧٨٩").alias("digits"))


def suffix_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", lines.suffixed(F.col("url"), "_9x16").alias("url"))


def media_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", lines.kind_of(F.col("url"), {"video": ("mp4", "webm"), "image": ("png", "jpg")}, "page").alias("kind"))


def timecode_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", lines.tenths_code(F.floor(F.col("o_totalprice") * 10 + 0.5)).alias("code"))


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lines.chunk_plan(F.col("n_chars"), 1000).alias("c")).select("doc_id", "c.*")


def share_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(tables.share_agrees(F.col("l_quantity") > 20, (6, 10)).alias("passes"))
    return tables.looked_up(_orders(spark, sf_dir).select("o_orderkey"), shares, ["o_orderkey"], {"passes": True})


def distinct_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bounds(_lines(spark, sf_dir), ["l_orderkey", "l_suppkey"], "l_linenumber", F.col("l_linenumber") <= 5).select("l_orderkey", "l_suppkey", F.col("low").alias("first_place"))


def batch_queue_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bounds(_orders(spark, sf_dir), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "O").select("o_custkey", F.col("low").alias("next_job"), F.col("size").alias("waiting"))


def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    groups = tables.looked_up(table(spark, sf_dir, "supplier"), nations, ["s_nationkey"]).groupBy("n_regionkey", "s_nationkey").agg(F.count("*").alias("n"))
    return lines.first_of(groups, ["n_regionkey"], F.struct(-F.col("n"), F.col("s_nationkey")), ["s_nationkey", "n"])


QUERIES = {f.__name__: f for f in (
    unsure_edges, consecutive_cuts, late_restarts, transition_windows, swap_neighbours, phrase_twins, equal_neighbours, first_override, last_row_wins, jobs_first_wins, group_representative, bucketed_peaks, incremental_peaks,
    level_energy, clock_map_cuts, order_preserving_clamp, feasibility_bound, path_spans, collapsed_path, split_at_time, retimed_spans, seam_gaps, http_ranges, deduplicated_names, digit_fold, suffix_insert, media_kind,
    timecode_format, chunk_plan, share_at_least, distinct_in_window, batch_queue_heads, largest_group,
)}
