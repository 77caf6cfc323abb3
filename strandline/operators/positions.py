"""Positions over a whole table: range-partitioned row numbers plus the counts of the partitions before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import materialize

_PLACES = 33  # monotonically_increasing_id: the partition above, the row in it below
#: Rows of a table of counts that every executor may hold: some 30 MB.
BROADCAST_COUNTS = 200_000


def _numbered(df: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """df written in order, with `part` and `own`: its range partition and its number there."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("row_id", F.monotonically_increasing_id())
    split = numbered.select(*df.columns, F.shiftright("row_id", _PLACES).alias("part"), F.col("row_id").bitwiseAND(F.lit((1 << _PLACES) - 1)).alias("own"))
    return materialize(split, "positions")


def positions(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """df with `place`, the 0-based position of each row in the order of all rows, nulls first."""
    held = _numbered(df, order, parts)
    # one row for each partition, so the window over all of them is small
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return held.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("own") + F.col("offset")).alias("place"))


def group_positions(df: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """df with `place` (0-based, in the order of its group), `size` (rows of the group), `rank` and `groups`.

    `rank` is the position of the group's key among the `groups` distinct keys, nulls first. Rows are ordered by
    group first, so a group of any size spreads over partitions; what is counted has one row for each
    partition and group in it, and a count is joined to the rows of one partition at most.
    """
    held = _numbered(df, [group, *order], parts)
    counts = materialize(held.groupBy("part", group).agg(F.count("*").alias("n"), F.min("own").alias("first")), "position-counts")
    keys = positions(materialize(counts.groupBy(group).agg(F.sum("n").alias("size")), "position-groups"), [group]).withColumnRenamed(group, "key")
    ranks = materialize(keys.select("key", "size", F.col("place").alias("rank")), "position-ranks")
    groups = ranks.count()
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("in_part"), F.col(group).alias("of"), (before - F.col("first")).alias("offset"))
    known = materialize(offsets.join(ranks, F.col("of").eqNullSafe(F.col("key"))).drop("key"), "position-offsets")
    few = known.count() <= BROADCAST_COUNTS
    same = (held["part"] == known["in_part"]) & held[group].eqNullSafe(known["of"])
    placed = held.join(F.broadcast(known) if few else known, same)
    return placed.select(*(held[c] for c in df.columns), (held["own"] + known["offset"]).alias("place"), known["size"], known["rank"], F.lit(groups).cast("long").alias("groups"))


def position_of(keys: DataFrame, placed: DataFrame, on: list[str]) -> DataFrame:
    """keys with the position of each, null where it has none; of a repeated key the last one."""
    last = placed.groupBy(*on).agg(F.max("place").alias("place"))
    return keys.join(last, on, "left")
