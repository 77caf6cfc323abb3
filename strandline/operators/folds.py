"""Ordered folds: rules whose next step depends on what they decided before.

A window function gives another answer for these. Spark deals the rows by key and sorts them; a small
fold then runs over the sorted rows batch by batch and carries only its state from row to row and
from batch to batch (`ordered_fold`). A key of any size takes constant memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Row = tuple
#: Takes a row; gives the rows that are settled by it.
Step = Callable[[Row], Iterator[Row]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable[[Row], tuple[Step, Callable[[], Iterator[Row]]]], schema: str) -> DataFrame:
    """Fold the rows of each key in order.

    `begin` is called with the first row of a key and gives two functions: one takes each of its rows,
    the other ends the key; both yield rows of the schema.
    """
    at = [df.columns.index(k) for k in keys]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step, end = None, None, None
        for rows in parts:
            out: list[Row] = []
            for row in rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if step is None or key != now:
                    if step is not None:
                        out += end()
                    now, (step, end) = key, begin(row)
                out += step(row)
            yield _frame(out)
        if step is not None:
            yield _frame(list(end()))

    columns = [part.split()[0].strip("`") for part in schema.split(",")]

    def _frame(out: list[Row]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, schema)


def _nothing() -> Iterator[Row]:
    return iter(())


def rate_limited(df: DataFrame, limit: int = 3, window: int = 6 * 3_600_000_000) -> DataFrame:
    """user_id, event_id, admitted: at most `limit` admitted within `window`; refused rows do not count."""

    def begin(_: Row):
        recent: deque[int] = deque()

        def step(row: Row) -> Iterator[Row]:
            user, event, t = row
            while recent and t - recent[0] >= window:
                recent.popleft()
            admitted = len(recent) < limit
            if admitted:
                recent.append(t)
            yield user, event, admitted

        return step, _nothing

    return ordered_fold(df.select("user_id", "event_id", "t"), ["user_id"], ["t", "event_id"], begin, "user_id long, event_id long, admitted boolean")


def truncated(df: DataFrame, least: int) -> DataFrame:
    """user_id, start, end: spans in order, each cut at the start of the next; too short ones give way."""

    def begin(_: Row):
        last: list[Row] = []

        def step(row: Row) -> Iterator[Row]:
            user, start, end = row
            if last and last[0][2] > start:
                before = last.pop()
                if start - before[1] >= least:
                    last.append((user, before[1], start))
            if end - start >= least:
                yield from last
                last[:] = [row]

        return step, lambda: iter(last)

    return ordered_fold(df.select("user_id", "start", "end"), ["user_id"], ["start", "end"], begin, "user_id long, start long, end long")


def queue_replay(df: DataFrame, room: int = 5, per_visitor: int = 2, service: int = 1_800_000_000) -> DataFrame:
    """event_id, verdict, begins: one runner, a bounded line and a cap for each visitor, per queue."""

    def begin(_: Row):
        line: deque[tuple[int, int]] = deque()  # visitor, end of service
        free = [0]

        def step(row: Row) -> Iterator[Row]:
            _, event, t, visitor = row
            while line and line[0][1] <= t:
                line.popleft()
            if len(line) >= room:
                yield event, "full", -1
            elif sum(v == visitor for v, _ in line) >= per_visitor:
                yield event, "too_many", -1
            else:
                at = max(t, free[0])
                free[0] = at + service
                line.append((visitor, free[0]))
                yield event, "queued", at

        return step, _nothing

    return ordered_fold(df.select("queue", "event_id", "t", "visitor"), ["queue"], ["t", "event_id"], begin, "event_id long, verdict string, begins long")


def going_back(df: DataFrame) -> DataFrame:
    """user_id, event_id, pass: a new pass begins where the position falls below the furthest reached of the pass's key."""

    def begin(_: Row):
        reached: dict[str, int] = {}
        number = [0]

        def step(row: Row) -> Iterator[Row]:
            user, event, kind, _, v = row
            if kind in reached and v < reached[kind]:
                number[0] += 1
                reached.clear()
            reached[kind] = max(v, reached.get(kind, v))
            yield user, event, number[0]

        return step, _nothing

    return ordered_fold(df.select("user_id", "event_id", "event_type", "t", "v"), ["user_id"], ["t", "event_id"], begin, "user_id long, event_id long, pass long")


def read_again(df: DataFrame) -> DataFrame:
    """user_id, start, end: stretches of a reading that say again what was said: from the first place at or
    below the furthest one to where the reading passes it; rows are position v at time t."""

    def begin(first: Row):
        user, furthest, span = first[0], [None], []

        def step(row: Row) -> Iterator[Row]:
            _, _, t, v = row
            if furthest[0] is not None and v <= furthest[0]:
                if not span:
                    span[:] = [t, t]
                span[1] = t
            else:
                if span:
                    yield user, span[0], t
                    span.clear()
                furthest[0] = v

        def end() -> Iterator[Row]:
            if span:
                yield user, span[0], span[1]

        return step, end

    return ordered_fold(df.select("user_id", "event_id", "t", "v"), ["user_id"], ["t", "event_id"], begin, "user_id long, start long, end long")


def jump_alignment(df: DataFrame, jump: int = 3) -> DataFrame:
    """key, cost: least edits from `heard` to `script`, where the script may start again at a cost.

    Rows hold two arrays of words; a dynamic program over each pair.
    """

    def fold(heard: list[str], script: list[str]) -> int:
        row = list(range(len(script) + 1))
        for word in heard:
            best = min(row) + jump
            row = [min(cost, best + i) for i, cost in enumerate(row)]
            new = [row[0] + 1]
            for i, other in enumerate(script):
                new.append(min(row[i] + (word != other), row[i + 1] + 1, new[i] + 1))
            row = new
        return row[-1]

    def run(parts):
        for rows in parts:
            yield pd.DataFrame({"key": rows["key"], "cost": [fold(list(h), list(s)) for h, s in zip(rows["heard"], rows["script"], strict=True)]})

    return df.select("key", "heard", "script").mapInPandas(run, "key long, cost long")
