"""Captions out of timed words: where a line breaks, and which breaks are taken back.

Words are rows of a key (one recording) with n, their order from 0 without gaps; verse; w, their place in the script; start and
end; and flags: mark (a stop sign permits a stop here), hanging (a line cannot end here), sustained (a sound is
held into the next word), drops (its last vowel is dropped at a stop) and again (a verified repeat). Pauses are
spans (start, end) of a key. Evidence is gathered by joins and windows over the whole table; only the breaks that
stand at neighbouring words, whose fate depends on one another, are folded in order, island by island.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import overlap_join

FLAGS = ("mark", "hanging", "sustained", "drops", "again")


@dataclass(frozen=True)
class Bars:
    """How much time counts as evidence, in the unit of the words' times; `scale` stretches the bars of pauses."""

    shortest: float  # no shorter quiet is measured
    marked: float  # a pause at a mark
    unmarked: float  # a pause anywhere
    borderline: float  # a pause where a decoded phrase ended too
    hesitation: float  # the least gap that means a stop at a mark
    hesitation_factor: float  # and so many usual gaps of the recording
    restart: float  # between a word and its repeat
    inset: float  # how far a pause may end inside the word before it
    vowel_inset: float  # the same where a dropped vowel may lie over it
    joined: float  # the longest gap that a sound is held over
    held_factor: float  # how much more quiet a held sound asks for
    reach: float = 0.0  # how far a phrase end may fall outside a pause
    near: float = 0.0  # tolerance of edges of words and pauses
    scale: float = 1.0

    def of(self, bar: float) -> float:
        return max(self.shortest, bar * self.scale)


#: Fixed values of the usual bars, in seconds.
SECONDS = Bars(
    shortest=0.18, marked=0.18, unmarked=0.38, borderline=0.20, hesitation=0.36, hesitation_factor=2.25, restart=0.30, inset=0.10, vowel_inset=0.25, joined=0.7, held_factor=2.0, reach=0.15, near=0.10,
)


def _spans(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    return df.select(*keys, F.col(start).alias("r_start"), F.col(end).alias("r_end"))


def longest_touching(rows: DataFrame, pauses: DataFrame, keys: Sequence[str], low: Column, high: Column, cell: int) -> DataFrame:
    """(keys, n, quiet): the longest pause that overlaps the span from low to high of each row; rows without are missing."""
    asked = rows.select(*keys, "n", low.alias("l_start"), high.alias("l_end")).where("l_end > l_start")
    met = overlap_join(asked, _spans(pauses, keys), keys, cell)
    return met.groupBy(*keys, "n").agg(F.max(F.col("r_end") - F.col("r_start")).alias("quiet"))


def junctions(words: DataFrame, keys: Sequence[str], bars: Bars) -> DataFrame:
    """words with the next two words' fields, the gap, whether it `joins` the next one and the recording's `stop_gap`.

    The usual gap is the median of the smaller half of all gaps inside verses.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("verse", "w", "start", "end", "again")} | {"after_w": F.lead("w", 2).over(order)}
    met = words.withColumns(ahead)
    same = F.col("verse") == F.col("next_verse")
    met = met.withColumns({"gap": F.col("next_start") - F.col("end"), "joins": F.coalesce(same & (F.col("next_w") == F.col("w") + 1), F.lit(False))})
    inner = met.where(same).select(*keys, F.greatest("gap", F.lit(0)).alias("gap"))
    ranked = inner.withColumns({"nth": F.row_number().over(Window.partitionBy(*keys).orderBy("gap")), "many": F.count("*").over(Window.partitionBy(*keys))})
    half = F.greatest(F.floor(F.col("many") / 2), F.lit(1))
    middle = (F.col("nth") == F.floor((half + 1) / 2)) | (F.col("nth") == F.floor((half + 2) / 2))
    usual = ranked.where(middle).groupBy(*keys).agg(F.avg("gap").alias("usual"))
    stop = F.greatest(F.lit(bars.hesitation), F.lit(bars.hesitation_factor) * F.coalesce("usual", F.lit(0))) * bars.scale
    return met.join(usual, list(keys), "left").withColumn("stop_gap", stop).drop("usual")


def pause_breaks(met: DataFrame, pauses: DataFrame, keys: Sequence[str], bars: Bars, phrase_ends: DataFrame | None = None) -> DataFrame:
    """(keys, n): words that a pause long enough follows.

    A pause belongs to the last word begun by then. A next word that lies wholly inside the pause, right before a
    step back in the script, was said before it. Quiet that ends well inside the word, or that the next word has
    already run past, separates nothing.
    """
    long = pauses.where(F.col("end") - F.col("start") >= bars.of(bars.marked)).select(*keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    fields = ["n", "w", "start", "end", *FLAGS, "next_w", "next_start", "next_end", "after_w", "gap", "stop_gap"]
    order = Window.partitionBy(*keys).orderBy("at", "side", "n").rowsBetween(Window.unboundedPreceding, 0)
    sides = met.select(*keys, F.col("start").alias("at"), F.lit(0).alias("side"), "n", F.struct("n", "start").alias("word"), F.lit(None).cast("double").alias("p_end"))
    asks = long.select(*keys, F.col("p_start").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(sides.schema["word"].dataType).alias("word"), F.col("p_end").cast("double"))
    # words may overlap, so the last begun is the one of the largest n, not of the latest start
    begun = sides.unionByName(asks).withColumn("reached", F.max(F.when(F.col("side") == 0, F.col("word.n"))).over(order)).where("side = 1")
    asked = begun.where("reached IS NOT NULL").select(*keys, F.col("at").alias("p_start"), "p_end", F.col("reached").alias("n"))
    here = asked.join(met.select(*keys, *fields), [*keys, "n"])
    inside = (F.col("next_start") >= F.col("p_start") - bars.near / 2) & (F.col("next_end") <= F.col("p_end") + bars.near / 2)
    pushed = F.coalesce((F.col("after_w") <= F.col("next_w")) & inside, F.lit(False))
    moved = here.select(*keys, "p_start", "p_end", (F.col("n") + pushed.cast("int")).alias("n")).join(met.select(*keys, *fields), [*keys, "n"]).where("next_start IS NOT NULL")
    inset = F.when(F.col("mark") & F.col("drops"), bars.vowel_inset).otherwise(bars.inset)
    parts = (F.col("next_start") >= F.col("p_start") - bars.near) | (F.col("p_end") <= F.col("end") + bars.near)
    fits = moved.where((F.col("p_end") >= F.col("end") - inset) & parts & (F.col("mark") | ~F.col("hanging")))
    if phrase_ends is None:
        judged = fits.withColumn("ended", F.lit(False))
    else:
        ends = phrase_ends.select(*keys, "w", "at").withColumnsRenamed({k: f"of_{k}" for k in keys}).withColumnRenamed("w", "of_w")
        same = [F.col(k) == F.col(f"of_{k}") for k in keys]
        near = F.col("at").between(F.col("p_start") - bars.reach, F.col("p_end") + bars.reach)
        agreed = fits.join(ends, [*same, F.col("w") == F.col("of_w"), near], "left_semi").select(*keys, "n", "p_start", "p_end", F.lit(True).alias("ended")).distinct()
        judged = fits.join(agreed, [*keys, "n", "p_start", "p_end"], "left").withColumn("ended", F.coalesce("ended", F.lit(False)))
    bar = F.when(F.col("mark"), bars.of(bars.marked)).when(F.col("ended") & (F.col("gap") >= F.col("stop_gap")), bars.of(bars.borderline)).otherwise(bars.of(bars.unmarked))
    bar = bar * F.when(F.col("sustained") & ~F.col("mark") & (F.col("gap") <= bars.joined), bars.held_factor).otherwise(1.0)
    return judged.where(F.col("p_end") - F.col("p_start") >= bar).select(*keys, "n").distinct()


def breaks(words: DataFrame, pauses: DataFrame, keys: Sequence[str], bars: Bars, cell: int, phrase_ends: DataFrame | None = None, hush: DataFrame | None = None) -> DataFrame:
    """words' junctions with `cut` (a line ends here) and `on_mark` (only the mark and the gap say so).

    A line ends with its verse and with the recording; before a step back that is verified, or that the reciter
    stopped for; at a mark with a gap that is no held sound (with `hush`, one that touches such quiet); and at a
    pause by pause_breaks.
    """
    met = junctions(words, keys, bars)
    back = (F.col("verse") == F.col("next_verse")) & (F.col("next_w") <= F.col("w"))
    stopped = longest_touching(met.where(back), pauses, keys, F.col("start"), F.col("next_end"), cell).where(F.col("quiet") >= bars.restart).select(*keys, "n", F.lit(True).alias("stopped"))
    quiet = pause_breaks(met, pauses, keys, bars, phrase_ends).withColumn("paused", F.lit(True))
    met = met.join(stopped, [*keys, "n"], "left").join(quiet, [*keys, "n"], "left")
    unheld = F.lit(True)
    if hush is not None:
        left = longest_touching(met.where("gap > 0"), hush, keys, F.col("end"), F.col("next_start"), cell).select(*keys, "n", F.lit(True).alias("left_off"))
        met = met.join(left, [*keys, "n"], "left")
        unheld = F.coalesce("left_off", F.lit(False))
    restart = back & (F.col("again") | F.col("next_again") | (F.col("gap") >= bars.restart) | F.coalesce("stopped", F.lit(False)))
    sure = F.col("next_start").isNull() | (F.col("verse") != F.col("next_verse")) | restart | F.coalesce("paused", F.lit(False))
    marked = (F.col("verse") == F.col("next_verse")) & F.col("mark") & ~F.col("sustained") & unheld & (F.col("gap") >= F.col("stop_gap"))
    sure, marked = F.coalesce(sure, F.lit(False)), F.coalesce(marked, F.lit(False))
    return met.withColumns({"cut": sure | marked, "on_mark": marked & ~sure}).drop("stopped", "paused", "left_off")


def taken_back(cut: DataFrame, pauses: DataFrame, keys: Sequence[str], bars: Bars, cell: int) -> DataFrame:
    """(keys, n): cuts to take back so that no word stands alone inside its verse.

    A word between two cuts that reads on at both sides goes with the side of the weaker stop: less quiet around the
    join, then the smaller gap, then the earlier one. Taking one back may settle the next word's case, so cuts at
    neighbouring words form an island, and an island is folded from its start until nothing is left to do. Cuts of
    different islands never touch the same word: the result does not depend on the order of islands or rows.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    cuts = cut.where("cut").select(*keys, "n", "joins", "gap", "end", "next_start")
    chained = F.coalesce((F.lag("n").over(order) == F.col("n") - 1) & F.lag("joins").over(order) & F.col("joins"), F.lit(False))
    islands = cuts.withColumn("chained", chained).withColumn("island", F.count_if(~F.col("chained")).over(order))
    several = islands.withColumn("size", F.count("*").over(Window.partitionBy(*keys, "island"))).where("size > 1")
    quiet = longest_touching(several, pauses, keys, F.col("end") - bars.inset, F.col("next_start") + bars.inset, cell)
    strength = several.join(quiet, [*keys, "n"], "left").select(*keys, "island", F.struct("n", F.coalesce(F.col("quiet").cast("double"), F.lit(0.0)).alias("quiet"), F.col("gap").cast("double").alias("gap")).alias("stop"))
    grouped = strength.groupBy(*keys, "island").agg(F.array_sort(F.collect_list("stop")).alias("stops"))

    def step(done: Column, stop: Column) -> Column:
        last = done["last"]
        earlier = (last["quiet"] < stop["quiet"]) | ((last["quiet"] == stop["quiet"]) & (last["gap"] <= stop["gap"]))
        taken = F.when(earlier, last["n"]).otherwise(stop["n"])
        alone = last["n"] == stop["n"] - 1
        return F.struct(F.when(alone, F.concat(done["taken"], F.array(taken))).otherwise(done["taken"]).alias("taken"), F.when(alone & ~earlier, last).otherwise(stop).alias("last"))

    none = F.array().cast(f"array<{cut.schema['n'].dataType.simpleString()}>")
    folded = F.aggregate(F.slice("stops", 2, F.size("stops")), F.struct(none.alias("taken"), F.element_at("stops", 1).alias("last")), step)
    return grouped.select(*keys, F.explode(folded["taken"]).alias("n"))


def captions(words: DataFrame, pauses: DataFrame, keys: Sequence[str], bars: Bars, cell: int, phrase_ends: DataFrame | None = None, hush: DataFrame | None = None) -> DataFrame:
    """One row for each caption: keys, caption (from 0), verse, first_w, last_w, start, end, restart, to_check.

    `restart` captions begin at or before the word where the one before ended; `to_check` ones end on a mark alone. `cell`
    is the length of the time cells that joins deal by, best near the usual length of a pause.
    """
    cut = breaks(words, pauses, keys, bars, cell, phrase_ends, hush)
    back = taken_back(cut, pauses, keys, bars, cell).withColumn("back", F.lit(True))
    order = Window.partitionBy(*keys).orderBy("n")
    kept = cut.join(back, [*keys, "n"], "left").withColumn("ends", F.col("cut") & F.col("back").isNull())
    numbered = kept.withColumn("caption", F.coalesce(F.count_if("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = numbered.groupBy(*keys, "caption").agg(
        F.min_by("verse", "n").alias("verse"), F.min_by("w", "n").alias("first_w"), F.max_by("w", "n").alias("last_w"), F.min_by("start", "n").alias("start"), F.max_by("end", "n").alias("end"),
        F.max_by("on_mark", "n").alias("to_check"),
    )
    before = F.lag("last_w").over(Window.partitionBy(*keys).orderBy("caption"))
    return out.withColumn("restart", F.coalesce(F.col("first_w") <= before, F.lit(False)))
