"""What a reading shows: stops, breaths, rushed words, dips, windows to place next, words heard in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.runs import bridged_islands, islands


def uncut_stops(heard: DataFrame, keys: Sequence[str], order: Sequence[str], index: str, licensed: DataFrame, cut: DataFrame) -> DataFrame:
    """Words that follow in the text right after a word that allows a stop, where no cut is yet.

    `licensed` has keys and the index of words that allow a stop, `cut` those before which a cut is.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    onward = heard.where(F.col(index).isNotNull()).withColumn("_before", F.lag(index).over(line)).where(F.col("_before") == F.col(index) - 1)
    allowed = licensed.select(*keys, (F.col(index) + 1).alias(index)).distinct()
    return onward.join(allowed, [*keys, index], "left_semi").join(cut.select(*keys, index).distinct(), [*keys, index], "left_anti").drop("_before")


def long_breaths(heard: DataFrame, keys: Sequence[str], order: Sequence[str], index: str, quiet: DataFrame, gap: int, least: int, cell: int) -> DataFrame:
    """(keys, index, from, to): gaps of at least `gap` between words that follow on each other, each heard once,
    with one stretch of quiet of at least `least` inside."""
    line = Window.partitionBy(*keys).orderBy(*order)
    times = F.count("*").over(Window.partitionBy(*keys, index))
    rows = heard.withColumns({"_n": times}).withColumns({"_before": F.lag(index).over(line), "_m": F.lag("_n").over(line), "from": F.lag("end").over(line), "to": F.col("start")})
    found = rows.where((F.col("_before") == F.col(index) - 1) & (F.col("_n") == 1) & (F.col("_m") == 1) & (F.col("to") - F.col("from") >= gap)).select(*keys, index, "from", "to")
    wide = found.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor(F.col("to") / cell))))
    dealt = quiet.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_b") / cell))))
    inside = F.least("_b", "to") - F.greatest("_a", "from")
    return wide.join(dealt, [*keys, "_cell"]).where(inside >= least).select(*keys, index, "from", "to").distinct()


def without_rushed_runs(words: DataFrame, keys: Sequence[str], order: str, index: str, gap: int) -> DataFrame:
    """Words without the runs that count on by one and start less than `gap` apart on average; their time goes to
    the word kept before them."""
    line = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(index) == F.lag(index).over(line) + 1, 0).otherwise(1)
    runs = words.withColumn("_new", new).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_run")
    size = F.count("*").over(whole)
    rushed = runs.withColumn("_rushed", (size >= 2) & (F.max("start").over(whole) - F.min("start").over(whole) < gap * (size - 1)))
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    owned = rushed.withColumn("_owner", F.last(F.when(~F.col("_rushed"), F.col(order)), ignorenulls=True).over(upto))
    reach = owned.withColumn("end", F.when(F.col("_owner").isNotNull(), F.max("end").over(Window.partitionBy(*keys, "_owner"))).otherwise(F.col("end")))
    return reach.where(~F.col("_rushed")).drop("_new", "_run", "_rushed", "_owner")


def boundary_level(levels: DataFrame, keys: Sequence[str], at: str, level: str, shares: Sequence[float], gap: int, speaking: Column, least: int, rows_for_each: int) -> DataFrame:
    """(keys, share, dips): the first share whose percentile gives dips no sparser than one in so many rows;
    where none does, the one with the most, the lowest of equal ones.

    All shares are tried side by side: each row stands once for each, so the plan does not grow with them.
    """
    lines = levels.groupBy(*keys).agg(F.percentile(level, F.array(*map(F.lit, shares))).alias("_lines"), F.count("*").alias("_size"))
    tried = lines.select(*keys, "_size", F.posexplode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("_lines").alias("line"))).alias("_nth", "_p")).select(*keys, "_size", F.col("_p.share").alias("share"), F.col("_p.line").alias("_line"))
    each = levels.join(tried, list(keys))
    dips = bridged_islands(each, [*keys, "share"], at, level, F.col(level) < F.col("_line"), gap, speaking, least).groupBy(*keys, "share").agg(F.count("*").alias("dips"))
    counted = tried.join(dips, [*keys, "share"], "left").withColumn("dips", F.coalesce("dips", F.lit(0)))
    enough = F.when(F.col("dips") * rows_for_each >= F.col("_size"), F.struct("share", "dips"))
    best = counted.groupBy(*keys).agg(F.min(enough).alias("_enough"), F.max(F.struct("dips", (-F.col("share")).alias("_s"))).alias("_most"))
    return best.select(*keys, F.coalesce(F.col("_enough.share"), -F.col("_most._s")).alias("share"), F.coalesce("_enough.dips", "_most.dips").alias("dips"))


def nearest_quietest(levels: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, level: str, back: int, on: int, near: int) -> DataFrame:
    """Targets (keys, id, target) with the frame to cut at: of the frames from `back` before to `on` after that are
    nearly as quiet as the quietest of them, the one nearest to the target, the earlier of two."""
    wide = targets.withColumn(at, F.explode(F.sequence(F.greatest(F.lit(0), F.col("target") - back), F.col("target") + on)))
    seen = wide.join(levels.select(*keys, at, level), [*keys, at])
    quiet = seen.withColumn("_least", F.min(level).over(Window.partitionBy(*keys, "id"))).where(F.col(level) <= F.col("_least") + near)
    return quiet.groupBy(*keys, "id").agg(F.min(F.struct(F.abs(F.col(at) - F.col("target")).alias("_d"), F.col(at).alias("cut"))).alias("_b")).select(*keys, "id", "_b.cut")


def lulls(levels: DataFrame, picks: DataFrame, keys: Sequence[str], at: str, level: str) -> DataFrame:
    """Picks (keys, id, pick, bar) with the stretch around them that stays at or below the bar."""
    each = levels.join(picks.select(*keys, "id", "pick", "bar"), list(keys))
    found = islands(each, [*keys, "id", "pick"], at, F.col(level) <= F.col("bar"))
    return found.where((F.col("start") <= F.col("pick")) & (F.col("pick") < F.col("end"))).select(*keys, "id", "start", "end")


def next_windows(verses: DataFrame, keys: Sequence[str], order: str, guess: str, window: int, ahead: int) -> DataFrame:
    """(keys, keep, last): how many verses are placed next, and how far is read ahead: verses until their guessed
    lengths fill the window, then until further ones fill the look-ahead."""
    line = Window.partitionBy(*keys).orderBy(order)
    sums = verses.withColumns({"_sum": F.sum(guess).over(line.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(line) - 1, "_count": F.count("*").over(Window.partitionBy(*keys))})
    kept = sums.groupBy(*keys).agg(F.min(F.when(F.col("_sum") >= window, F.struct("_nth", "_sum"))).alias("_full"), F.max(F.struct("_nth", "_sum")).alias("_all"))
    kept = kept.select(*keys, F.coalesce("_full._nth", "_all._nth").alias("keep"), F.coalesce("_full._sum", "_all._sum").alias("_kept"))
    reached = sums.join(kept, list(keys)).groupBy(*keys, "keep").agg(F.min(F.when((F.col("_nth") > F.col("keep")) & (F.col("_sum") - F.col("_kept") >= ahead), F.col("_nth"))).alias("_last"), F.max("_nth").alias("_end"))
    return reached.select(*keys, "keep", F.coalesce("_last", "_end").alias("last"))


def units(words: DataFrame, keys: Sequence[str], order: str, verse: str, index: str, chunk: str) -> DataFrame:
    """(keys, unit, verse, first, last): neighbouring words of one chunk that follow on each other."""
    line = Window.partitionBy(*keys).orderBy(order)
    goes_on = (F.lag(verse).over(line) == F.col(verse)) & (F.lag(chunk).over(line) == F.col(chunk)) & (F.lag(index).over(line) == F.col(index) - 1)
    runs = words.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("unit", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy(*keys, "unit", verse).agg(F.min(index).alias("first"), F.max(index).alias("last"))


def recited(words: Column, shown: Column, look: int = 2) -> Column:
    """For each word whether it was said: both lists in order, a word may be found up to `look` further on; longer
    words also where one holds the other."""
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<boolean>").alias("said"))

    def equal(word: Column, at: Column) -> Column:
        other = F.get(shown, at)
        inside = (F.length(word) >= 3) & (F.length(other) >= 3) & (F.contains(other, word) | F.contains(word, other))
        return F.coalesce((word == other) | inside, F.lit(False))

    def step(state: Column, word: Column) -> Column:
        i = state["i"]
        found = F.when(word == "", None)
        for offset in range(look + 1):
            found = found.when(equal(word, i + offset), i + offset + 1)
        said = (word == "") | found.isNotNull()
        return F.struct(F.coalesce(found, i).alias("i"), F.concat(state["said"], F.array(said)).alias("said"))

    return F.aggregate(words, start, step, lambda s: s["said"])


def longest_pieces(text: Column, pieces: Sequence[str]) -> Column:
    """A text as pieces of a vocabulary, at each place the longest that fits, blanks apart; null where none does."""
    ordered = sorted(pieces, key=lambda p: (-len(p), p))
    either = "|".join(r"\Q" + p + r"\E" for p in ordered)
    bare = F.regexp_replace(text, r"\s+", "")
    found = F.regexp_extract_all(text, F.lit(f"({either})"), 1)
    return F.when(F.length(F.array_join(found, "")) == F.length(bare), found)


def misfit(heard: Column, symbols: Column) -> Column:
    """Edits between two lists of small numbers; each number becomes a character, and Spark counts."""
    written = lambda numbers: F.array_join(F.transform(numbers, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long") + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(written(heard), written(symbols))


def shown_ids(chosen: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """Chosen ids of which something is drawn that does not come from glosses of single words (drawn: key, source)."""
    return chosen.join(drawn.where("source <> 'words'").select(key).distinct(), key, "left_semi")


def sampled(rows: DataFrame, key: str, count: int, seed: str) -> DataFrame:
    """`count` rows, by the digests of their keys and the seed, so that every run and engine takes the same."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(count)


def added_after(verses: DataFrame, keys: Sequence[str], order: str, anchor: int, least: int) -> DataFrame:
    """The verses and a new one (added true) after the row numbered `anchor`: in the gap behind it where that is
    wide enough, else on its second half."""
    line = Window.partitionBy(*keys).orderBy(order)
    noted = verses.withColumns({"_nth": F.row_number().over(line) - 1, "_next": F.lead("start").over(line)})
    here = F.col("_nth") == anchor
    room = here & (F.coalesce("_next", F.col("end") + least) - F.col("end") >= least)
    half = F.floor((F.col("start") + F.col("end")) / 2)
    kept = noted.withColumns({"end": F.when(here & ~room, half).otherwise(F.col("end")), "added": F.lit(False)})
    new = noted.where(here).withColumns({"start": F.when(room, F.col("end")).otherwise(half), "end": F.when(room, F.coalesce("_next", F.col("end") + least)).otherwise(F.col("end")), "added": F.lit(True)})
    return kept.unionByName(new).drop("_nth", "_next")
