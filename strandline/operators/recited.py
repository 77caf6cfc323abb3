"""What was recited of a script: alignment with steps back and its path, and the choice between two readings.

An alignment is a table of costs, a row for each symbol heard and a column for each place of the script. Only the
costs of every so-manyth row are kept; the way back through a stretch of rows is read off its costs, computed
once more from the kept row before it. A reading of any length takes memory for two square roots of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JUMP = 3


class Alignment:
    """Least edits from what was heard to a script that may go back, before any symbol, to where a unit starts.

    An extra or missing symbol costs one, a step back `jump`. Of equal ways a symbol stands for the script's before
    it counts as extra, and text is passed over unheard only where that is cheaper; a step back comes from the
    first place that is cheapest.
    """

    def __init__(self, script: np.ndarray, starts: np.ndarray, jump: int = JUMP):
        self.script, self.starts, self.jump = script, starts, jump
        self.ramp = np.arange(len(script) + 1)

    def opened(self, costs: np.ndarray) -> np.ndarray:
        """Costs before the next symbol, once steps back are allowed for."""
        out = costs.copy()
        cheapest = np.minimum.accumulate(costs[::-1])[::-1]
        out[self.starts] = np.minimum(out[self.starts], cheapest[self.starts] + self.jump)
        return out

    def after(self, costs: np.ndarray, symbol: int) -> np.ndarray:
        """The next row: each place by the same symbol, an extra one, or on from the place before it, unheard."""
        before = self.opened(costs)
        heard = before + 1
        np.minimum(heard[1:], before[:-1] + (self.script != symbol), out=heard[1:])
        return np.minimum.accumulate(heard - self.ramp) + self.ramp

    def rows(self, costs: np.ndarray, heard: np.ndarray) -> list[np.ndarray]:
        out = [costs]
        for symbol in heard.tolist():
            out.append(self.after(out[-1], symbol))
        return out

    def path(self, heard: np.ndarray) -> tuple[list[int], list[int], int]:
        """(script places in the order read, place in the script after each symbol heard, cost)."""
        stride = max(1, int(len(heard) ** 0.5))
        kept = [self.ramp]
        for at in range(0, len(heard), stride):
            now = kept[-1]
            for symbol in heard[at : at + stride].tolist():
                now = self.after(now, symbol)
            kept.append(now)
        cost, place = int(kept[-1][-1]), len(self.script)
        read, places = [], []
        for block in range(len(kept) - 2, -1, -1):
            part = heard[block * stride : (block + 1) * stride]
            costs = self.rows(kept[block], part)
            for i in range(len(part) - 1, -1, -1):
                before, here = self.opened(costs[i]), costs[i + 1]
                while place and here[place] < min(before[place] + 1, before[place - 1] + (self.script[place - 1] != part[i])):
                    place -= 1
                    read.append(place)
                places.append(place)
                if place and here[place] == before[place - 1] + (self.script[place - 1] != part[i]):
                    place -= 1
                    read.append(place)
                if before[place] < costs[i][place]:
                    place += int(np.argmin(costs[i][place:]))
        read += range(place - 1, -1, -1)
        return read[::-1], places[::-1], cost


def _aligned(rows: DataFrame, jump: int, result, schema: str) -> DataFrame:
    """result(key, alignment's path, units) for each row (key, heard, script, units) that has something heard and a script."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for part in parts:
            out = []
            for key, heard, script, units in part.itertuples(index=False, name=None):
                if heard is None or script is None or not len(heard) or not len(script):
                    continue
                symbols = np.unique(np.concatenate([np.asarray(script), np.asarray(heard)]), return_inverse=True)[1]
                units = np.asarray(units)
                starts = np.flatnonzero(np.r_[True, units[1:] != units[:-1]])
                out += result(key, Alignment(symbols[: len(script)], starts, jump).path(symbols[len(script) :]), units)
            yield pd.DataFrame(out, columns=columns)

    return rows.select("key", "heard", "script", "units").mapInPandas(run, schema)


def recited_runs(rows: DataFrame, jump: int = JUMP) -> DataFrame:
    """key, run, first, last, cost: the units recited, run by run; a run after the first goes back.

    Rows hold arrays: the symbols heard, the script's symbols and the unit of each of these. The first unit starts
    the reading and the last one ends it. Rows without symbols heard or without a script are missing.
    """

    def runs(key, path, units: np.ndarray) -> list[tuple]:
        read, _, cost = path
        places = np.asarray(read)
        begins = np.flatnonzero(np.r_[True, places[1:] <= places[:-1]])
        ends = np.r_[begins[1:], len(places)] - 1
        return [(key, n, int(units[places[a]]), int(units[places[b]]), cost) for n, (a, b) in enumerate(zip(begins, ends, strict=True))]

    return _aligned(rows, jump, runs, f"key {rows.schema['key'].dataType.simpleString()}, run int, first int, last int, cost long")


def heard_units(rows: DataFrame, jump: int = JUMP) -> DataFrame:
    """key, t, unit: the unit that each symbol heard was part of."""

    def units_of(key, path, units: np.ndarray) -> list[tuple]:
        return [(key, t, int(units[min(max(place - 1, 0), len(units) - 1)])) for t, place in enumerate(path[1])]

    return _aligned(rows, jump, units_of, f"key {rows.schema['key'].dataType.simpleString()}, t int, unit int")


def _text(symbol: Column, order: Column) -> Column:
    """The symbols of a group in order, as one text with a letter for each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), symbol.alias("s")))), lambda x: x["s"]), "")


def _blocks(script: DataFrame, keys: Sequence[str], group: str, spelled: DataFrame) -> DataFrame:
    """(keys, group, first, text, words, restarts, distinct): what a reading says of each group, where it says it in one stretch."""
    order = Window.partitionBy(*keys).orderBy("n")
    met = script.withColumns({"back": (F.lag("w").over(order) >= F.col("w")) & (F.lag(group).over(order) == F.col(group))}).join(spelled, "w")
    out = met.groupBy(*keys, group).agg(
        F.min("n").alias("first"), (F.max("n") - F.min("n") + 1).alias("span"), F.count("*").alias("size"), _text(F.col("letters"), F.col("n")).alias("text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"].cast("string")), " ").alias("words"), F.count_if("back").alias("restarts"), F.countDistinct("w").alias("distinct"),
    )
    return out.where("span = size").drop("span", "size")


def group_gains(heard: DataFrame, held: DataFrame, other: DataFrame, spelled: DataFrame, keys: Sequence[str], group: str, least_restarts: int = 2, restarts_a_word: float = 0.1) -> DataFrame:
    """(keys, group, gain): how many edits fewer the other reading needs to what was heard in a group.

    heard has rows (keys, group, t, letter), readings have rows (keys, group, n, w), `spelled` gives the letters of
    each w. Judged are groups that both readings say in one stretch and differently, in which something was heard,
    and where the other one goes back often enough: fit alone cannot choose, as a reading with one restart
    fewer fits what was heard at least as well.
    """
    said = heard.groupBy(*keys, group).agg(_text(F.col("letter"), F.col("t")).alias("said"))
    a = _blocks(held, keys, group, spelled).select(*keys, group, F.col("text").alias("held_text"), F.col("words").alias("held_words"))
    b = _blocks(other, keys, group, spelled).where(F.col("restarts") >= F.greatest(F.lit(least_restarts), F.lit(restarts_a_word) * F.col("distinct")))
    met = said.join(a, [*keys, group]).join(b, [*keys, group]).where("held_words <> words")
    return met.select(*keys, group, (F.levenshtein("said", "held_text") - F.levenshtein("said", "text")).alias("gain"))


def chosen_reading(heard: DataFrame, held: DataFrame, other: DataFrame, spelled: DataFrame, keys: Sequence[str], group: str, least_gain: int = 4, **restarts) -> DataFrame:
    """(keys, place, group, w, chosen): the held reading, with a group's stretch taken from the other one where that gains enough.

    A stretch that is taken stands where the held one stood, so all that follows moves with it.
    """
    won = group_gains(heard, held, other, spelled, keys, group, **restarts).where(F.col("gain") >= least_gain).select(*keys, group)
    at = held.join(won, [*keys, group], "left_semi").groupBy(*keys, group).agg(F.min("n").alias("stands"))
    kept = held.join(won, [*keys, group], "left_anti").select(*keys, group, "w", F.col("n").alias("stands"), F.lit(0).cast("long").alias("inner"), F.lit(False).alias("chosen"))
    taken = other.join(at, [*keys, group]).select(*keys, group, "w", "stands", F.col("n").cast("long").alias("inner"), F.lit(True).alias("chosen"))
    order = Window.partitionBy(*keys).orderBy("stands", "inner")
    return kept.unionByName(taken).select(*keys, (F.row_number().over(order) - 1).alias("place"), group, "w", "chosen")
