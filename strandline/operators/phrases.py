"""Which words of a reference each phrase of a recording says: a search over segmentations, as an ordered fold.

A recording of P phrases has boundaries 0 to P. A reading of a span of phrases proposes reference words for it;
there may be several for one span, or none. A route covers all phrases by spans in order and claims one reading of
each, or nothing. Two routes that have reached different places of the text go on differently, so they are never
compared before the end: at each boundary there is one best route for each place reached.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from strandline.operators.folds import ordered_fold

#: Steps after which what all living routes share is given out.
SETTLE = 64


class Rules(NamedTuple):
    """Bounds of the search, and what a reading must score to be believed."""

    beam: int = 10  # routes that are followed on from a boundary
    least: float = 0.5  # a reading that scores less says nothing
    again: float = 0.75  # what a reading scores at least that only says again what was said
    heard_before: int = 0  # words of the reference that were said before the recording


class Step:
    """A link of a route's history: routes share what they have in common."""

    __slots__ = ("before", "claim", "depth")

    def __init__(self, before: Step | None, claim: tuple | None):
        self.before, self.claim, self.depth = before, claim, before.depth + 1 if before else 0


class Route(NamedTuple):
    """Ordered by worth: words explained, phrases used, then the words said (a bit for each) and the place reached."""

    explained: float
    used: int
    said: int
    reached: int
    last: Step

    def worth(self) -> tuple:
        return self[:4]


def claims(route: Route, first: int, last: int, score: float, rules: Rules) -> bool:
    """Whether a route may claim words first to last.

    What lies behind the place reached must mostly have been said on this route: going back over words that were
    jumped is no repeat. A reading that reaches no further is a repeat only if it is a good one.
    """
    if score < rules.least:
        return False
    if first <= route.reached:
        behind = min(last, route.reached) - first + 1
        known = (route.said >> first) & ((1 << behind) - 1)
        if 2 * (behind - known.bit_count()) > behind:
            return False
    return last > route.reached or score >= rules.again


def extended(route: Route, readings: Sequence[tuple], span: tuple, rules: Rules) -> Iterator[Route]:
    """The route over one more span: with each reading it may claim, and unclaimed where none may or one skips words."""
    fit = [r for r in readings if claims(route, *r, rules)]
    for first, last, score in fit:
        words = ((1 << (last - first + 1)) - 1) << first
        yield Route(route.explained + score * (last - first + 1), route.used + 1, route.said | words, last, Step(route.last, (*span, first, last, score)))
    if not fit or any(first > route.reached + 1 for first, _, _ in fit):
        yield route._replace(used=route.used + 1, last=Step(route.last, None))


def _shared(routes: list[Route]) -> Step:
    """The last step that all routes have in common."""
    ends = [r.last for r in routes]
    while any(e is not ends[0] for e in ends):
        deepest = max(e.depth for e in ends)
        ends = list({id(s): s for s in (e.before if e.depth == deepest else e for e in ends)}.values())
    return ends[0]


def _history(step: Step) -> list[tuple]:
    out = []
    while step is not None:
        if step.claim is not None:
            out.append(step.claim)
        step = step.before
    return out[::-1]


def search_fold(width: int, rules: Rules, settle: int = SETTLE):
    """The fold of assigned_phrases over rows of `width` key columns and a reading."""

    def begin(row: tuple):
        key = row[:width]
        start = Step(None, None)
        open_: dict[int, dict[int, Route]] = {0: {rules.heard_before - 1: Route(0, 0, (1 << rules.heard_before) - 1, rules.heard_before - 1, start)}}
        spans: dict[int, list[tuple]] = {}
        at = [None, 0]  # the boundary that rows are gathered for, and the step settled up to

        def advance() -> Iterator[tuple]:
            i = at[0]
            routes = sorted(open_.pop(i, {}).values(), key=Route.worth, reverse=True)[: rules.beam]
            for j, found in sorted(spans.items()):
                ahead = open_.setdefault(j, {})
                for route in routes:
                    for new in extended(route, found, (i, j), rules):
                        known = ahead.get(new.reached)
                        if known is None or new.worth() > known.worth():
                            ahead[new.reached] = new
            spans.clear()
            living = [r for slot in open_.values() for r in slot.values()]
            if living and min(r.last.depth for r in living) - at[1] > settle:
                common = _shared(living)
                yield from ((*key, *claim) for claim in _history(common))
                at[1], common.before, common.claim = common.depth, None, None

        def step(row: tuple) -> Iterator[tuple]:
            i, j, first, last, score = row[width:]
            if at[0] is not None and i != at[0]:
                yield from advance()
            at[0] = i
            found = spans.setdefault(int(j), [])
            if first is not None:
                found.append((int(first), int(last), score))

        def end() -> Iterator[tuple]:
            yield from advance()
            if open_:
                best = max(open_[max(open_)].values(), key=Route.worth)
                yield from ((*key, *claim) for claim in _history(best.last))

        return step, end

    return begin


def assigned_phrases(readings: DataFrame, keys: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """Readings (keys, i, j, first, last, score) of spans from boundary i to j; null words for a span without one.

    Gives (keys, i, j, first, last, score) of the claimed spans of the route that explains most words, by score;
    among equal ones the one of more phrases. A recording needs a row for each span from i to i + 1; a span of
    several phrases is tried only if it has a row. Rows come sorted by boundary; the state holds the routes of the
    boundaries that spans reach ahead, and what all of them share is given out as the fold goes on.
    """
    kinds = {f.name: f.dataType.simpleString() for f in readings.schema}
    columns = [*keys, "i", "j", "first", "last", "score"]
    return ordered_fold(readings.select(*columns), keys, ["i", "j", "first", "last"], search_fold(len(keys), rules), ", ".join(f"`{c}` {kinds[c]}" for c in columns))
