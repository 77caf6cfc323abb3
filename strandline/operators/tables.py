"""Lookups, updates, rankings, budgets and verdicts over tables of records, with keys and thresholds as parameters.

Counts and bounds are aggregated before they are joined, so a key that fills a table costs no more than its partial
sums; rankings that keep the first few of each key are limited before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# updates ----------------------------------------------------------------------------------


def upsert(held: DataFrame, changes: DataFrame, keys: Sequence[str], insert: bool = True) -> DataFrame:
    """held with the rows of `changes` in place of those of the same keys; new ones are added, if `insert`."""
    new = changes.select(*held.columns)
    kept = held.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new if insert else new.join(held.select(*keys).distinct(), list(keys), "left_semi"))


def without_keys(held: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """held without the rows whose keys `gone` names; a key it has not is no error."""
    return held.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*held.columns)


def restated(held: DataFrame, column: str, states: Mapping[str, str]) -> DataFrame:
    """held with states renamed, as after a restart: what was running waits again."""
    pairs = F.create_map(*(F.lit(x) for pair in states.items() for x in pair))
    return held.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def overridden(rows: DataFrame, keys: Sequence[str], group: DataFrame, column: str, value: Column) -> DataFrame:
    """rows with `column` set for all whose keys are in `group`."""
    marked = group.select(*keys).distinct().withColumn("_in", F.lit(True))
    met = rows.join(marked, list(keys), "left")
    return met.withColumn(column, F.when(F.col("_in"), value).otherwise(F.col(column))).drop("_in")


# lookups ----------------------------------------------------------------------------------


def looked_up(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """left with right's other columns; rows without a match have the defaults, or are missing where there are none."""
    if defaults is None:
        return left.join(right, list(keys))
    met = left.join(right, list(keys), "left")
    return met.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def bounds(rows: DataFrame, keys: Sequence[str], value: str, where: Column | None = None) -> DataFrame:
    """(keys, low, high, size) of a value over the rows that count."""
    fine = rows if where is None else rows.where(where)
    return fine.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("size"))


def covered(rows: DataFrame, spans: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """rows with `covered`: whether the value lies in the span (low, high) of its keys; without a span it does not."""
    met = rows.join(spans.select(*keys, "low", "high"), list(keys), "left")
    return met.withColumn("covered", F.coalesce(F.col(value).between(F.col("low"), F.col("high")), F.lit(False))).drop("low", "high")


def skipped_inside(rows: DataFrame, keys: Sequence[str], value: str, kept: Column) -> DataFrame:
    """Rows that are not kept although they lie strictly between the outermost kept ones of their keys."""
    met = rows.withColumn("_kept", kept).join(bounds(rows, keys, value, kept), list(keys))
    return met.where(~F.col("_kept") & (F.col(value) > F.col("low")) & (F.col(value) < F.col("high"))).select(*rows.columns)


def points_in_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, cell: int) -> DataFrame:
    """Pairs of points and the spans (start, end, both included) of their keys that hold them, dealt over cells of time."""
    a = points.withColumn("_cell", F.floor(F.col(at) / cell))
    b = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    return a.join(b, [*keys, "_cell"]).where(F.col(at).between(F.col("start"), F.col("end"))).drop("_cell")


def missing_somewhere(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """(item, without): how many owners lack each item, of those that some owner lacks. Counts alone: no pair is made."""
    have = rows.select(owner, item).distinct().groupBy(item).agg(F.count("*").alias("have"))
    owners = rows.select(owner).distinct().agg(F.count("*").alias("owners"))
    return have.join(F.broadcast(owners)).where("have < owners").select(item, (F.col("owners") - F.col("have")).alias("without"))


# rankings and budgets ---------------------------------------------------------------------


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int | None = None) -> DataFrame:
    """rows with `place` in the order of their keys, from 1; the first `most` only, if given."""
    window = Window.partitionBy(*keys).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(window))
    return placed if most is None else placed.where(F.col("place") <= most)


def within_budget(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, most: int, keeps_first: bool = False) -> DataFrame:
    """Rows of each key, in order, whose sizes so far stay within `most`; the first one in any case, if `keeps_first`."""
    window = Window.partitionBy(*keys).orderBy(*order)
    used = rows.withColumns({"_used": F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(window)})
    fits = F.col("_used") <= most
    return used.where(fits | (F.col("_nth") == 1) if keeps_first else fits).drop("_used", "_nth")


def last_entries(log: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns) of the last entry of each key, by partial sums."""
    last = F.max_by(F.struct(*columns), order)
    return log.groupBy(key).agg(last.alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in columns))


def next_around(rows: DataFrame, keys: Sequence[str], value: str, after: int, size: int) -> DataFrame:
    """(keys, value): of each key the first row on from `after`, around a circle of `size` places."""
    ahead = F.pmod(F.col(value) - after, F.lit(size))
    return rows.groupBy(*keys).agg(F.min(F.struct(ahead.alias("ahead"), F.col(value).alias(value))).alias("_n")).select(*keys, F.col(f"_n.{value}").alias(value))


# verdicts ---------------------------------------------------------------------------------


def share_agrees(hit: Column, share: tuple[int, int], strictly: bool = False) -> Column:
    """An aggregate: whether the rows that hit make up at least (or more than) the share, given as a fraction."""
    part, whole = share
    hits, all_ = F.count_if(hit) * whole, F.count("*") * part
    return hits > all_ if strictly else hits >= all_


def stale(rows: DataFrame, keys: Sequence[str], synced: str, now: DataFrame, age: int) -> DataFrame:
    """(keys, due): whether the last sync of each key is `age` old or older, or never was; now has one row, `now`."""
    last = rows.groupBy(*keys).agg(F.max(synced).alias("_synced"))
    return last.join(F.broadcast(now)).select(*keys, (F.col("_synced").isNull() | (F.col("now") - F.col("_synced") >= age)).alias("due"))


def range_verdict(low: Column, high: Column, wanted_low: Column, wanted_high: Column) -> Column:
    """exact, partial (inside), wrong, or none of a predicted range against the wanted one."""
    inside = (low >= wanted_low) & (high <= wanted_high)
    return F.when(low.isNull(), "none").when((low == wanted_low) & (high == wanted_high), "exact").when(inside, "partial").otherwise("wrong")


def gap_verdict(found: Column, wanted: Column) -> Column:
    """Of counts of parts: missing, wrong (nothing wanted), merge, split or match."""
    return F.when(found.isNull(), "missing").when(wanted.isNull(), "wrong").when(found < wanted, "merge").when(found > wanted, "split").otherwise("match")


def view_window(start: Column, end: Column, first: Column, last: Column, margin: int, whole: int) -> list[Column]:
    """[from, to]: a span widened by a margin inside its file; from is null where it is the whole file, but for `whole`."""
    all_of_it = (start - first <= whole) & (last - end <= whole)
    return [F.when(~all_of_it, F.greatest(start - margin, first)), F.least(end + margin, last)]


def edge_label(first: Column, last: Column, low: Column, high: Column) -> Column:
    """`A 1-3` where a span begins and ends alike, else `A1 B3`."""
    alike = F.concat(first, F.lit(" "), low.cast("string"), F.lit("-"), high.cast("string"))
    return F.when(first == last, alike).otherwise(F.concat(first, low.cast("string"), F.lit(" "), last, high.cast("string")))
