"""Interval algebra: overlap and as-of joins, merging, complements, clipping and clock maps.

overlap_join deals both sides over fixed time cells, so a range join becomes an equi join that
Spark can shuffle and, where a cell is crowded, split. An interval stands in each cell it
touches and a pair counts in the first cell it shares. asof_join is one union and one window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.timelines import E, NEXT


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(column))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """Pairs with l_end > r_start and l_start < r_end (open ends); columns l_start, l_end, r_start, r_end."""
    a = left.withColumn("cell", F.explode(F.sequence(F.floor(F.col("l_start") / cell), F.floor(F.col("l_end") / cell))))
    b = right.withColumn("cell", F.explode(F.sequence(F.floor(F.col("r_start") / cell), F.floor(F.col("r_end") / cell))))
    both = a.join(b, [*keys, "cell"])
    first = F.greatest(F.floor(F.col("l_start") / cell), F.floor(F.col("r_start") / cell))
    return both.where((F.col("l_end") > F.col("r_start")) & (F.col("l_start") < F.col("r_end")) & (F.col("cell") == first)).drop("cell")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before its time, or null."""
    a = left.withColumns({"_side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, time, value).withColumn("_side", F.lit(0))
    order = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b, allowMissingColumns=True)
    found = joined.withColumn("_at", F.last(F.when(F.col("_side") == 0, F.struct(value)), ignorenulls=True).over(order))
    return found.where("_side = 1").withColumn(value, F.col(f"_at.{value}")).drop("_side", "_at")


def coalesce_spans(df: DataFrame, keys: Sequence[str], gap: int = 0) -> DataFrame:
    """Spans (start, end) of each key merged where they overlap or stand at most `gap` apart."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col("start") <= before + gap, 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def complement(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What lies between the merged spans of each key."""
    merged = coalesce_spans(df, keys)
    after = F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))
    return merged.select(*keys, F.col("end").alias("start"), after.alias("end")).where(F.col("end").isNotNull())


STATEMENTS = {
    "longest_overlap": f"""WITH {NEXT}, o AS (SELECT user_id, IDIV(t, 86400000000) AS day, t, nxt FROM s WHERE nxt > t)
      SELECT user_id, max(least(nxt, (day + 1) * 86400000000) - t) AS longest, CAST(sum(least(nxt, (day + 1) * 86400000000) - t) AS BIGINT) AS total FROM o GROUP BY user_id""",
    "window_intersection": f"""WITH {NEXT} SELECT event_id, greatest(t, 1704672000000000) AS start_t, least(nxt, 1705276800000000) AS end_t FROM s
      WHERE nxt > 1704672000000000 AND t < 1705276800000000 AND least(nxt, 1705276800000000) - greatest(t, 1704672000000000) >= 100000""",
    "trim_and_rebase": f"""WITH {NEXT} SELECT event_id, greatest(t, 1704672000000000) - 1704672000000000 AS start_t, least(nxt, 1705276800000000) - 1704672000000000 AS end_t FROM s WHERE nxt > 1704672000000000 AND t < 1705276800000000""",
    "clock_map_cuts": f"""WITH {NEXT}, c AS (SELECT event_id, user_id, t, CASE WHEN event_type = 'error' AND nxt IS NOT NULL THEN nxt - t ELSE 0 END AS cut FROM s)
      SELECT event_id, CAST(t - coalesce(sum(cut) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mapped_t FROM c""",
    "shift_spans": f"""WITH {NEXT} SELECT event_id, t + 1500000 AS start_t, nxt + 1500000 AS end_t FROM s WHERE nxt IS NOT NULL""",
    "affine_fit": f"""WITH {E}, b AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY user_id)
      SELECT e.event_id, CASE WHEN hi - lo <= 86400000000 THEN t - lo ELSE CAST(floor((t - lo) / 100) AS BIGINT) END AS fitted FROM e JOIN b ON b.user_id = e.user_id""",
    "point_in_interval": """WITH o AS (SELECT o_custkey, US(o_orderdate) AS d, o_orderkey FROM orders)
      SELECT o_custkey, max(o_orderkey) AS last_order, count(*) AS n FROM o WHERE d >= 820454400000000 AND d < 852076800000000 GROUP BY o_custkey""",
    "restart_overlap_share": """WITH i AS (SELECT l_orderkey, min(u) AS a, max(u) AS b FROM (SELECT l_orderkey, US(l_shipdate) AS u FROM lineitem) x GROUP BY l_orderkey),
      n AS (SELECT o_custkey, a, b, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS na FROM orders JOIN i ON l_orderkey = o_orderkey)
      SELECT o_custkey, count(CASE WHEN na < b THEN 1 END) AS overlapping, count(*) AS n FROM n GROUP BY o_custkey""",
}
