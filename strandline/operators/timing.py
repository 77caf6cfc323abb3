"""Levels around a frame, spans held in order, words left over between phrases, and sweeps of thresholds."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.folds import ordered_fold
from strandline.runtime import dealt

#: Fixed value: what stands for digital silence, in decibels; no level at or below it counts.
SILENCE = -90.0


def levels_around(frames: DataFrame, keys: Sequence[str], order: str, level: str, reach: int, share: float, silence: float = SILENCE) -> DataFrame:
    """(keys, order, around): the level below which `share` of the levels lie, from `reach` frames before to `reach` - 1 after.

    Levels at or below `silence` do not count; where none is left, `around` is `silence`. The frame moves on one row
    at a time and is kept sorted, so each row costs one insertion and one removal.
    """
    width = len(keys)

    def begin(first: tuple):
        key = first[:width]
        near: deque = deque()  # (order, level) of the rows in reach of those that wait
        waiting: deque = deque()  # (position, order)
        ranked: list = []
        seen = [0]

        def settle(position: int, at) -> tuple:
            while near and near[0][0] < position - reach:
                _, gone = near.popleft()
                if gone is not None:
                    ranked.pop(bisect_left(ranked, gone))
            return (*key, at, ranked[min(int(len(ranked) * share), len(ranked) - 1)] if ranked else silence)

        def step(row: tuple) -> Iterator[tuple]:
            at, value = row[width:]
            kept = value if value is not None and value > silence else None
            near.append((seen[0], kept))
            if kept is not None:
                insort(ranked, kept)
            waiting.append((seen[0], at))
            seen[0] += 1
            while waiting and waiting[0][0] + reach <= seen[0]:
                yield settle(*waiting.popleft())

        def end() -> Iterator[tuple]:
            while waiting:
                yield settle(*waiting.popleft())

        return step, end

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, order)), "around double"])
    return ordered_fold(frames.select(*keys, order, F.col(level).cast("double").alias(level)), keys, [order], begin, schema)


def placed_spans(words: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """words (keys, n, start, end, unit, opens, low, high) with start and end where their unit was heard, in order.

    low and high are a unit's span, null where it was not heard. A unit's words are held inside it; the first one of
    a unit that opens a chunk starts with it, the last one ends with it. Then no start comes before the one before
    it, and a span ends by the next start but lasts `least`. One shuffle: bounds run forward and back over it.
    """
    order = Window.partitionBy(*keys).orderBy("n")
    unit = Window.partitionBy(*keys, "unit").orderBy("n")
    heard = F.col("low").isNotNull() & F.col("high").isNotNull()
    held = lambda at: F.when(heard, F.least(F.greatest(F.col(at), F.col("low")), F.col("high"))).otherwise(F.col(at))
    first, last = F.lag("n").over(unit).isNull(), F.lead("n").over(unit).isNull()
    start = F.when(heard & first & F.col("opens"), F.col("low")).otherwise(held("start"))
    end = F.when(heard & last, F.col("high")).otherwise(held("end"))
    inside = words.withColumns({"start": start, "end": end})
    ordered = inside.withColumns({"following": F.coalesce(F.lead("start").over(order), F.col("end")), "start": F.max("start").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    shortest = F.col("start") + least
    return ordered.withColumn("end", F.greatest(shortest, F.least(F.col("end"), F.greatest(F.col("following"), shortest)))).drop("following")


def adopted_words(phrases: DataFrame, keys: Sequence[str], most: int = 4, longest: int = 22) -> DataFrame:
    """(keys, n, first, last, score): phrases with the words between them that none claimed.

    phrases has rows (keys, n, verse, first, last, words, said, between, between_verses, closes, opens_word): the
    reference words of a phrase and what was decoded in it, the words left over since the one before, the verses these are
    in, whether the last of them closes a phrase, and whether an unclaimed stretch between opens on a word (null without
    one). Both neighbours of the left-over words' verse may take them, up to `longest` words; the one whose similarity
    falls least does, the earlier one if equal. An unclaimed stretch decides instead where there is one, and a closing word
    always belongs to what came before. What a phrase has taken counts when it is judged again on its other side.
    """
    width = len(keys)

    def similar(said: list, words: list) -> float:
        return SequenceMatcher(None, said, words).ratio() if said and words else 0.0

    def begin(_: tuple):
        held: list = []

        def done() -> Iterator[tuple]:
            if held:
                key, n, _, first, words, said = held[0]
                yield (*key, n, first, first + len(words) - 1, similar(said, words))
                held.clear()

        def step(row: tuple) -> Iterator[tuple]:
            n, verse, first, _, words, said, between, verses, closes, opens_word = row[width:]
            words, said, between = (list(x) if x is not None else [] for x in (words, said, between))
            if held and 0 < len(between) <= most and len(set(verses)) == 1:
                _, _, old_verse, _, old_words, old_said = held[0]
                back = old_verse == verses[0] and len(old_words) + len(between) <= longest
                on = verse == verses[0] and len(words) + len(between) <= longest
                if back and on:
                    loses = similar(old_said, old_words) - similar(old_said, old_words + between)
                    costs = similar(said, words) - similar(said, between + words)
                    on = not closes and (costs < loses if opens_word is None else bool(opens_word))
                if on:
                    first, words = first - len(between), between + words
                elif back:
                    old_words += between
            yield from done()
            held.append((row[:width], n, verse, first, words, said))

        return step, done

    kinds = {f.name: f.dataType.simpleString() for f in phrases.schema}
    columns = [*keys, "n", "verse", "first", "last", "words", "said", "between", "between_verses", "closes", "opens_word"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, "n", "first", "last")), "score double"])
    return ordered_fold(phrases.select(*columns), keys, ["n"], begin, schema)


def swept(evidence: DataFrame, expected: DataFrame, keys: Sequence[str], grid: Mapping[str, Mapping[str, float]], ends: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    """(setting, hits, predicted): how many expected lines each setting of a grid finds.

    evidence has a row for each word (keys, n, w and whatever `ends` reads), expected has lines (keys, first_w,
    last_w). `ends` gives from a setting's values whether a line ends with a word; the last word always ends one.
    A line found twice counts as often as it is expected. The evidence is read, dealt and sorted once and never
    multiplied by the grid: each word carries where the line of every setting began, and a word that ends lines gives
    a row for each different beginning with the settings that found it.
    """
    names = sorted({name for values in grid.values() for name in values})
    settings = range(len(grid))
    order = Window.partitionBy(*keys).orderBy("n")
    ended = dealt(evidence, keys, 2).withColumn("_last", F.lead("n").over(order).isNull())
    ended = ended.select(*keys, "n", "w", F.array(*(F.col("_last") | F.coalesce(ends({n: F.lit(float(values[n])) for n in names}), F.lit(False)) for values in grid.values())).alias("_ends"))
    began = ended.withColumn("_before", F.lag("_ends").over(order))
    here = [F.when(F.coalesce(F.col("_before")[i], F.lit(True)), F.struct("w")) for i in settings]
    began = began.withColumns({f"_began{i}": F.last(here[i], ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for i in settings})
    begun = began.where(F.exists("_ends", lambda e: e)).select(*keys, "w", F.array(*(F.when(F.col("_ends")[i], F.col(f"_began{i}")) for i in settings)).alias("_began"))
    each = begun.withColumn("_first", F.explode(F.array_distinct(F.array_compact("_began"))))
    met = F.array(*(F.coalesce(F.col("_began")[i] == F.col("_first"), F.lit(False)) for i in settings))
    lines = each.select(*keys, F.col("_first.w").alias("first_w"), F.col("w").alias("last_w"), met.alias("_met"))
    both = lines.unionByName(expected.select(*keys, "first_w", "last_w"), allowMissingColumns=True)
    counted = both.groupBy(*keys, "first_w", "last_w").agg(F.count_if(F.col("_met").isNull()).alias("_wanted"), *(F.count_if(F.col("_met")[i]).alias(f"_n{i}") for i in settings))
    known = reduce(and_, (F.col(c).isNotNull() for c in (*keys, "first_w", "last_w")))
    sums = counted.withColumn("_wanted", F.when(known, F.col("_wanted")).otherwise(0)).agg(*(f for i in settings for f in (F.sum(F.least(f"_n{i}", "_wanted")).alias(f"_hits{i}"), F.sum(f"_n{i}").alias(f"_all{i}"))))
    rows = F.array(*(F.struct(F.lit(setting).alias("setting"), F.col(f"_hits{i}").alias("hits"), F.col(f"_all{i}").alias("predicted")) for i, setting in enumerate(grid)))
    return sums.select(F.explode(rows).alias("r")).select("r.*").where("predicted > 0")
