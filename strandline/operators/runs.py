"""Runs of neighbouring rows: islands, bridged islands, levels, and what follows from the row before or after.

Each operator takes a frame, the columns that tell sequences apart and the column that orders one
sequence. One shuffle by the keys serves all windows of an operator. A sequence that is null in
its order column sorts first, as Spark sorts.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _order(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "n") -> DataFrame:
    """The rows of each sequence numbered from 0."""
    return df.withColumn(name, F.row_number().over(_order(keys, order)) - 1)


def islands(df: DataFrame, keys: Sequence[str], at: str, holds: Column, least: int = 1) -> DataFrame:
    """(keys, start, end): stretches of consecutive numbers `at` on which the condition holds, at least so long; end exclusive."""
    kept = df.where(holds).withColumn("_run", F.col(at) - F.row_number().over(_order(keys, [at])))
    found = kept.groupBy(*keys, "_run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))
    return found.where(F.col("end") - F.col("start") >= least).drop("_run")


def bridged_islands(df: DataFrame, keys: Sequence[str], at: str, level: str, holds: Column, gap: int, quiet_below: Column, least: int) -> DataFrame:
    """Islands joined over gaps of at most `gap` rows whose level stays below `quiet_below`; kept where the
    rows of the islands themselves, without the gaps, number at least `least`."""
    order = _order(keys, [at])
    changed = (holds != F.lag(holds).over(order)).cast("int")
    pieces = df.withColumns({"_holds": holds, "_bar": quiet_below, "_piece": F.sum(F.coalesce(changed, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    pieces = pieces.groupBy(*keys, "_piece").agg(
        F.first("_holds").alias("_holds"), F.min(at).alias("start"), (F.max(at) + 1).alias("end"), F.max(level).alias("_top"), F.first("_bar").alias("_bar"), F.count("*").alias("_size")
    )
    line = _order(keys, ["_piece"])
    bridge = ~F.col("_holds") & (F.col("_size") <= gap) & (F.col("_top") < F.col("_bar")) & F.lag("_piece").over(line).isNotNull() & F.lead("_piece").over(line).isNotNull()
    parted = pieces.withColumn("_break", (~F.col("_holds") & ~bridge).cast("int"))
    parted = parted.withColumn("_island", F.sum("_break").over(line.rowsBetween(Window.unboundedPreceding, 0))).where("_holds")
    found = parted.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_size").alias("held"))
    return found.where(F.col("held") >= least).drop("_island")


def sampled_spans(df: DataFrame, keys: Sequence[str], time: str, step: int, slack: float = 1.01) -> DataFrame:
    """(keys, start, end): sample times joined where the next comes within the step after the last one's reach."""
    order = _order(keys, [time])
    before = F.lag(time).over(order)
    marked = df.withColumn("_new", F.when(F.col(time) - (before + step) <= F.lit(step * slack), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(time).alias("start"), (F.max(time) + step).alias("end")).drop("_run")


def rank_levels(df: DataFrame, keys: Sequence[str], level: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a level for each name): the level at the floor of share x count in rising order, counted from 0.

    A share counts as it is written: 0.7 of 90 rows are 63, not the 62.99 that the nearest double gives. Rows
    without a level count too and stand last.
    """
    ranked = df.select(*keys, level).withColumns({"_rank": F.row_number().over(_order(keys, [F.asc_nulls_last(level)])) - 1, "_size": F.count("*").over(Window.partitionBy(*keys))})
    picks = [F.max(F.when(F.col("_rank") == F.floor(F.col("_size") * F.lit(Decimal(str(share)))), F.col(level))).alias(name) for name, share in shares.items()]
    return ranked.groupBy(*keys).agg(*picks)


def quiet_spans(df: DataFrame, keys: Sequence[str], at: str, level: str, below: int, above: int, headroom: int, least: int) -> DataFrame:
    """Stretches under a threshold of their own sequence: `below` under its voice, or `above` over its floor,
    whichever is higher; none where voice and floor lie within the headroom."""
    bars = rank_levels(df, keys, level, {"_voice": 0.7, "_floor": 0.05}).where(F.col("_voice") - F.col("_floor") >= headroom)
    bars = bars.select(*keys, F.greatest(F.col("_voice") - below, F.col("_floor") + above).alias("_bar"))
    return islands(df.join(bars, list(keys)), keys, at, F.col(level) < F.col("_bar"), least)


def equal_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, piece: str, separator: str = " ") -> DataFrame:
    """(keys, run, value, text): neighbouring rows of one value, their pieces joined in order."""
    line = _order(keys, order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(line)) & F.lag(F.lit(1)).over(line).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(piece).cast("string").alias("_text"))))
    return runs.groupBy(*keys, "run", value).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), separator).alias("text"))


def forward_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], index: str) -> DataFrame:
    """How many rows from each row on count forward by one, the row itself included."""
    line = _order(keys, order)
    placed = df.withColumn("_at", F.row_number().over(line)).withColumn("_broken", F.when(F.lead(index).over(line) == F.col(index) + 1, None).otherwise(F.col("_at")))
    last = F.min("_broken").over(line.rowsBetween(0, Window.unboundedFollowing))
    return placed.withColumn("forward", last - F.col("_at") + 1).drop("_at", "_broken")


def any_between(df: DataFrame, keys: Sequence[str], order: Sequence[str], cut: Column, holds: Column) -> DataFrame:
    """(keys, part, found): whether a row between two cuts meets the condition; the row of a cut opens a part."""
    line = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"part": F.sum(cut.cast("int")).over(line), "_holds": holds}).groupBy(*keys, "part").agg(F.bool_or("_holds").alias("found"))


def reach_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: Column, last: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The first row of each sequence opens no later than `first`, the last one closes no earlier than `last`."""
    line = _order(keys, order)
    opens, closes = F.row_number().over(line) == 1, F.lead(F.lit(1)).over(line).isNull()
    return df.withColumns({start: F.when(opens, F.least(start, first)).otherwise(F.col(start)), end: F.when(closes, F.greatest(end, last)).otherwise(F.col(end))})


def settled_times(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, opens: Column, closes: Column) -> DataFrame:
    """Times in order and without gaps: one out of order is dropped, one that is missing stands evenly
    between its known neighbours, the bounds of the sequence standing in at both ends."""
    line = _order(keys, order)
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    inside = F.greatest(F.col(time), opens)
    in_order = df.withColumns({"_t": F.when(F.col(time).isNull(), None).otherwise(inside), "_at": F.row_number().over(line), "_opens": opens, "_closes": closes})
    known = in_order.withColumn("_t", F.when(F.col("_t") >= F.coalesce(F.max("_t").over(before), "_opens"), F.col("_t")))
    mark = F.when(F.col("_t").isNotNull(), F.struct("_at", "_t"))
    around = known.withColumns({"_left": F.last(mark, ignorenulls=True).over(before), "_right": F.first(mark, ignorenulls=True).over(after), "_size": F.count("*").over(Window.partitionBy(*keys))})
    a, i = F.coalesce("_left._t", "_opens"), F.coalesce("_left._at", F.lit(0))
    b, j = F.coalesce("_right._t", "_closes"), F.coalesce("_right._at", F.col("_size") + 1)
    placed = a + F.floor((b - a) * (F.col("_at") - i) / (j - i))
    return around.withColumn("settled", F.coalesce("_t", placed)).drop("_t", "_at", "_left", "_right", "_size", "_opens", "_closes")


def mark_boundary(df: DataFrame, keys: Sequence[str], order: Sequence[str], index: int, time: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The row numbered `index` ends at the time and the next one starts there; sequences where that would
    leave nothing of the row stay as they are."""
    line = _order(keys, order)
    here, after = F.row_number().over(line) == index + 1, F.row_number().over(line) == index + 2
    noted = df.withColumns({"_here": here, "_after": after}).withColumn("_mark", F.when(F.col("_here") & (time > F.col(start)), time))
    noted = noted.withColumn("_mark", F.max("_mark").over(Window.partitionBy(*keys)))
    return noted.withColumns({
        end: F.when(F.col("_here"), F.coalesce("_mark", end)).otherwise(F.col(end)), start: F.when(F.col("_after"), F.coalesce("_mark", start)).otherwise(F.col(start))
    }).drop("_here", "_after", "_mark")


def agreed_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], good: Column) -> DataFrame:
    """Rows that are good themselves and are followed by a good row."""
    line = _order(keys, order)
    return df.withColumn("_both", good & F.lead(good).over(line)).where("_both").drop("_both")


def correlation_by_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """(keys, lag, score): Pearson correlation of a sequence with itself so many rows later; no row where
    fewer than two pairs or no variance make it undefined."""
    line = _order(keys, order)
    pairs = df.withColumn("_later", F.array(*[F.struct(F.lit(lag).alias("lag"), F.lead(value, lag).over(line).alias("y")) for lag in lags]))
    each = pairs.select(*keys, F.col(value).cast("double").alias("x"), F.explode("_later").alias("p")).select(*keys, "x", "p.lag", F.col("p.y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    scored = each.groupBy(*keys, "lag").agg(F.count("*").alias("_n"), F.corr("x", "y").alias("score"), F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))
    return scored.where("_n >= 2 AND _a < _b AND _c < _d").drop("_n", "_a", "_b", "_c", "_d")


def best_lag(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The lag of the highest score of each key; of equal ones the smallest."""
    return scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("lag")).alias("_lag"))).alias("_best")).select(*keys, (-F.col("_best._lag")).alias("lag"), "_best.score")


def starved(df: DataFrame, keys: Sequence[str], amount: str, seconds: str, rate: float) -> DataFrame:
    """(keys, recorded, starved): time in all, and time of the samples whose amount for each second is under the rate."""
    kept = df.where(F.col(seconds) > 0)
    return kept.groupBy(*keys).agg(F.sum(seconds).alias("recorded"), F.sum(F.when(F.col(amount) / F.col(seconds) < rate, F.col(seconds)).otherwise(0)).alias("starved"))


def passage(df: DataFrame, keys: Sequence[str], chapter: str, verse: str, asked: tuple[int, int, int]) -> DataFrame:
    """(keys, chapter, first, last): lowest to highest verse where all rows are of one chapter, else what was asked for."""
    known = F.col(chapter).isNotNull() & F.col(verse).isNotNull()
    found = df.groupBy(*keys).agg(F.countDistinct(F.when(known, F.col(chapter))).alias("_n"), *[f(F.when(known, F.col(c))).alias(a) for f, c, a in ((F.min, chapter, "_c"), (F.min, verse, "_a"), (F.max, verse, "_b"))])
    return found.select(*keys, *[F.when(F.col("_n") == 1, F.col(c)).otherwise(F.lit(v)).alias(a) for c, v, a in zip(("_c", "_a", "_b"), asked, ("chapter", "first", "last"), strict=True)])


def primary_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], chapter: str, verse: str) -> DataFrame:
    """(keys, chapter, first, last, chapters): where a sequence begins and ends, in its own order; over several
    chapters it ends where it begins."""
    place = F.struct(*order)
    spot = F.struct(chapter, verse)
    found = df.where(F.col(chapter).isNotNull() & F.col(verse).isNotNull()).groupBy(*keys).agg(F.min_by(spot, place).alias("_a"), F.max_by(spot, place).alias("_b"), F.countDistinct(chapter).alias("chapters"))
    last = F.when(F.col("chapters") == 1, F.col(f"_b.{verse}")).otherwise(F.col(f"_a.{verse}"))
    return found.select(*keys, F.col(f"_a.{chapter}").alias("chapter"), F.col(f"_a.{verse}").alias("first"), last.alias("last"), "chapters")
