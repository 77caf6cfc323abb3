"""Sequences of rows by key and order: sessions, runs, repeats, layouts, fills, caches; and sets of rows compared.

Each operator takes a frame and the names of its columns, and keeps to one shuffle by the keys.
`order` should be total, so that ties have one answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _line(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def _upto(line: WindowSpec) -> WindowSpec:
    return line.rowsBetween(Window.unboundedPreceding, 0)


def _before(line: WindowSpec) -> WindowSpec:
    return line.rowsBetween(Window.unboundedPreceding, -1)


def grouped_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], goes_on: Column, name: str) -> DataFrame:
    """Rows with the number of their run, from 1; a row opens a run unless the condition holds. The condition may
    use windows of `line(keys, order)`; null counts as false."""
    line = _line(keys, order)
    return df.withColumn("_opens", F.when(goes_on, 0).otherwise(1)).withColumn(name, F.sum("_opens").over(_upto(line))).drop("_opens")


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, gap: int, name: str = "session") -> DataFrame:
    """Rows with the number of their session: a longer gap than this to the row before opens a new one."""
    return grouped_runs(df, keys, order, F.col(time) - F.lag(time).over(_line(keys, order)) <= gap, name)


def equal_value_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    return grouped_runs(df, keys, order, F.col(value) == F.lag(value).over(_line(keys, order)), name)


def rising_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Runs in which the value rises from row to row."""
    return grouped_runs(df, keys, order, F.col(value) > F.lag(value).over(_line(keys, order)), name)


def running_reach(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Columns reach, the highest value before, and is_repeat, whether the row does not pass it."""
    return df.withColumn("reach", F.max(value).over(_before(_line(keys, order)))).withColumn("is_repeat", F.coalesce(F.col(value) <= F.col("reach"), F.lit(False)))


def kept_rising(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows at or above every value before."""
    top = F.max(value).over(_before(_line(keys, order)))
    return df.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(value) >= F.col("_top"))).drop("_top")


def repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "is_repeat") -> DataFrame:
    """Whether an earlier row has the same keys."""
    return df.withColumn(name, F.row_number().over(_line(keys, order)) > 1)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], count: int = 1) -> DataFrame:
    """The first rows of each key."""
    return df.withColumn("_r", F.row_number().over(_line(keys, order))).where(F.col("_r") <= count).drop("_r")


def commonest(df: DataFrame, keys: Sequence[str], value: str, seen: str) -> DataFrame:
    """(keys, value, n): the commonest value of each key, of equally common ones the one seen first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seen).alias("_seen"))
    return first_rows(counted, keys, [F.desc("n"), F.col("_seen")]).drop("_seen")


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """Columns start_at and end_at: the rows of a key one behind the other."""
    ends = F.sum(length).over(_upto(_line(keys, order)))
    return df.withColumn("end_at", ends).withColumn("start_at", F.col("end_at") - F.col(length))


def with_copies(df: DataFrame, chosen: Column, name: str = "copy") -> DataFrame:
    """All rows as copy 0, and the chosen ones again as copy 1."""
    return df.withColumn(name, F.explode(F.when(chosen, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def filled_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(_line(keys, order))))


def gaps_closed(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, short: int) -> DataFrame:
    """Column end_t: rows reach to the next one where it is near, else half way to it, the last one by `short`."""
    after = F.lead(start).over(_line(keys, order))
    end = F.when(after.isNull(), F.col(start) + short).when(after - F.col(start) < short, after).otherwise(F.floor((F.col(start) + after) / 2))
    return df.withColumn("end_t", end)


def lower_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The row in the middle of each key, of an even number the lower one."""
    whole = df.withColumns({"_r": F.row_number().over(_line(keys, order)), "_n": F.count("*").over(Window.partitionBy(*keys))})
    return whole.where(F.col("_r") == F.floor((F.col("_n") + 1) / 2)).select(*keys, name)


def fits_cache(df: DataFrame, keys: Sequence[str], newest: Sequence[Column], size: str, room: int) -> DataFrame:
    """The newest rows of each key that fit the room together; the newest one always stays."""
    line = Window.partitionBy(*keys).orderBy(*newest)
    held = df.withColumns({"_held": F.sum(size).over(_upto(line)), "_r": F.row_number().over(line)})
    return held.where((F.col("_held") <= room) | (F.col("_r") == 1)).drop("_held", "_r")


def long_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], holds: Column, least: int) -> DataFrame:
    """(keys, from, to, n) in terms of the first order column: stretches of neighbouring rows that meet the condition."""
    line = _line(keys, order)
    marked = df.withColumns({"_at": F.row_number().over(line), "_holds": holds})
    kept = marked.where("_holds").withColumn("_run", F.col("_at") - F.row_number().over(line))
    found = kept.groupBy(*keys, "_run").agg(F.min(order[0]).alias("from"), F.max(order[0]).alias("to"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("_run")


def multiset_hits(found: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, hits): how many rows both have in common, repeats counted."""
    a = found.groupBy(*keys, value).agg(F.count("*").alias("_a"))
    b = expected.groupBy(*keys, value).agg(F.count("*").alias("_b"))
    return a.join(b, [*keys, value]).groupBy(*keys).agg(F.sum(F.least("_a", "_b")).alias("hits"))


def set_changes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, only_second): keys of one side alone."""
    a, b = first.select(key).distinct().withColumn("_a", F.lit(True)), second.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full").where("_a IS NULL OR _b IS NULL").select(key, F.col("_a").isNull().alias("only_second"))


def snapshot_changes(held: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing in what is held, removed from what is fresh, or stale."""
    a, b = held.select(key, F.struct(value).alias("_a")), fresh.select(key, F.struct(value).alias("_b"))
    both = a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(key, F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "removed").otherwise("stale").alias("state"))


def clusters(df: DataFrame, keys: Sequence[str], value: str, tie: str, gap: int) -> DataFrame:
    """(keys, weight, a, b): of the values that lie within a gap of each other the heaviest cluster, the lower of two."""
    near = F.col(value) - F.lag(value).over(_line(keys, [value, tie])) <= gap
    counted = grouped_runs(df, keys, [value, tie], near, "_c").groupBy(*keys, "_c").agg(F.count("*").alias("weight"), F.min(value).alias("a"), F.max(value).alias("b"))
    return first_rows(counted, keys, [F.desc("weight"), F.col("_c")]).drop("_c")
