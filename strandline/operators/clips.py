"""Clips, cuts and blocks on a timeline: making, moving, snapping and mapping of spans in whole milliseconds.

Columns `start` and `end` are a span, end exclusive; `keys` tell recordings apart. Functions of
columns stay in one row; those of frames shuffle once by the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import asof_join

SHORTEST_CLIP, SHORTEST_CUT, SHORTEST_BLOCK = 1000, 50, 200
MOST_CLIPS, MOST_CUTS = 100, 400
LEAD, REACH = 500, 250
#: What is kept of a pause of each kind at least, and how much of the rest.
PAUSE_FLOOR = {"ayah": 700, "stop": 500, "breath": 350}
FASTEST = 125


def new_clip(start: Column, end: Column, duration: Column) -> Column:
    """(start, end) inside the recording, whichever end comes first; null where less than a clip is left."""
    a, b = F.greatest(F.lit(0), F.least(start, end)), F.least(duration, F.greatest(start, end))
    return F.when(b - a >= SHORTEST_CLIP, F.struct(a.alias("start"), b.alias("end")))


def moved_clip(start: Column, end: Column, chosen: Column, to_start: Column, to_end: Column, duration: Column) -> Column:
    """The chosen clip's new window where that is a clip, else the window it has."""
    window = new_clip(to_start, to_end, duration)
    return F.when(chosen & window.isNotNull(), window).otherwise(F.struct(start.alias("start"), end.alias("end")))


def dragged_clip(start: Column, end: Column, edge: Column, delta: Column, duration: Column) -> Column:
    """The window after dragging one edge or the whole, inside the recording and no shorter than a clip."""
    length = end - start
    whole = F.greatest(F.lit(0), F.least(start + delta, duration - length))
    left = F.greatest(F.lit(0), F.least(start + delta, end - SHORTEST_CLIP))
    right = F.least(duration, F.greatest(end + delta, start + SHORTEST_CLIP))
    return (
        F.when(edge == "move", F.struct(whole.alias("start"), (whole + length).alias("end")))
        .when(edge == "start", F.struct(left.alias("start"), end.alias("end")))
        .otherwise(F.struct(start.alias("start"), right.alias("end")))
    )


def added_clips(clips: DataFrame, added: DataFrame, keys: Sequence[str], near: int = 10) -> DataFrame:
    """The added clips that no clip of their recording matches within less than `near` at both ends, in
    recordings that are not full. Ends are dealt over cells of that width, so the match is an equi join."""
    cells = F.array(*[F.floor(F.col("start") / near) + d for d in (-1, 0, 1)])
    held = clips.select(*keys, F.floor(F.col("start") / near).alias("_cell"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    asked = added.withColumn("_id", F.monotonically_increasing_id()).withColumn("_cell", F.explode(cells))
    same = asked.join(held, [*keys, "_cell"]).where((F.abs(F.col("start") - F.col("_a")) < near) & (F.abs(F.col("end") - F.col("_b")) < near)).select(*keys, "start", "end").distinct()
    full = clips.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= MOST_CLIPS).select(*keys)
    return added.join(same, [*keys, "start", "end"], "left_anti").join(full, list(keys), "left_anti")


def verse_windows(verses: DataFrame, keys: Sequence[str], order: Sequence[str], duration: Column) -> DataFrame:
    """Each row with the window that opens in the pause before it and closes in the one after: half of the
    pause, and at most LEAD of it; columns open and close."""
    line = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.coalesce(F.lag("end").over(line), F.lit(0)), F.coalesce(F.lead("start").over(line), duration)
    start, end = F.col("start"), F.col("end")
    opens = F.greatest(before + F.floor(F.greatest(F.lit(0), start - before) / 2), start - LEAD, F.lit(0))
    closes = F.least(end + F.floor(F.greatest(F.lit(0), after - end) / 2), end + LEAD)
    return verses.withColumns({"open": F.least(opens, start), "close": F.greatest(closes, end)})


def snapped(selections: DataFrame, verses: DataFrame, keys: Sequence[str], order: Sequence[str], key: str, duration: Column, cell: int) -> DataFrame:
    """Selections (keys, id, start, end) widened to whole keys: all rows of the keys whose middle they hold,
    with their pauses; selections that hold no middle are missing. Middles are dealt over time cells."""
    line = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(key) == F.lag(key).over(line), 0).otherwise(1)
    marked = verse_windows(verses, keys, order, duration).withColumn("_new", changed)
    placed = marked.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    edges = placed.groupBy(*keys, "_run").agg(F.min_by("open", F.struct(*order)).alias("_open"), F.max_by("close", F.struct(*order)).alias("_close"))
    middles = placed.select(*keys, "_run", ((F.col("start") + F.col("end")) / 2).alias("_middle")).withColumn("_cell", F.floor(F.col("_middle") / cell))
    wide = selections.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    held = wide.join(middles, [*keys, "_cell"]).where((F.col("_middle") >= F.col("start")) & (F.col("_middle") <= F.col("end"))).groupBy(*keys, "id").agg(F.min("_run").alias("_a"), F.max("_run").alias("_b"))
    first, last = edges.select(*keys, F.col("_run").alias("_a"), F.col("_open").alias("open")), edges.select(*keys, F.col("_run").alias("_b"), F.col("_close").alias("close"))
    return held.join(first, [*keys, "_a"]).join(last, [*keys, "_b"]).select(*keys, "id", "open", "close")


def normal_cuts(cuts: DataFrame, keys: Sequence[str], duration: Column) -> DataFrame:
    """(keys, start, end, auto): cuts inside the recording, none too short, overlapping ones as one, the first
    MOST_CUTS of a recording; a joined cut is automatic only where all its parts are."""
    inside = cuts.withColumns({"start": F.greatest(F.lit(0), F.col("start")), "end": F.least(duration, F.col("end"))}).where(F.col("end") - F.col("start") >= SHORTEST_CUT)
    line = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    runs = inside.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and("auto").alias("auto"))
    return joined.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).where(F.col("_nth") <= MOST_CUTS).drop("_nth", "_run")


def to_source(times: DataFrame, cuts: DataFrame, key: str, side: str) -> DataFrame:
    """Times of the edited recording on the clock of the source: column source. At a join the `side` decides,
    the end of what was before the cut or the start of what is after it."""
    line = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.col("end") - F.col("start")).over(line), F.lit(0))
    joins = cuts.select(key, (F.col("start") - gone).alias("time"), F.struct("start", "end", gone.alias("gone"), (F.col("start") - gone).alias("at")).alias("cut"))
    met = asof_join(times, joins, key, "time", "cut")
    at_join = F.col("cut.start") if side == "end" else F.col("cut.end")
    later = F.col("time") + F.coalesce(F.col("cut.gone") + F.col("cut.end") - F.col("cut.start"), F.lit(0))
    return met.withColumn("source", F.when(F.col("cut.at") == F.col("time"), at_join).otherwise(later)).drop("cut")


def pause_kinds(pauses: DataFrame, changes: DataFrame, signs: DataFrame, key: str, cell: int) -> DataFrame:
    """Pauses (key, id, start, end) with their kind: of the first change within REACH, whether the key changes
    there; without one, whether the last word before bears a stopping sign (signs: key, time, stops)."""
    wide = pauses.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("start") - REACH) / cell), F.floor((F.col("end") + REACH) / cell))))
    spots = changes.select(key, F.col("time").alias("_change"), "same").withColumn("_cell", F.floor(F.col("_change") / cell))
    near = wide.join(spots, [key, "_cell"]).where((F.col("_change") >= F.col("start") - REACH) & (F.col("_change") <= F.col("end") + REACH))
    first = near.groupBy(key, "id").agg(F.min(F.struct("_change", "same")).alias("_first"))
    heard = asof_join(pauses.withColumn("time", F.col("start")), signs, key, "time", "stops")
    kind = F.when(F.col("_first").isNotNull(), F.when(F.col("_first.same"), "stop").otherwise("ayah")).when(F.coalesce("stops", F.lit(False)), "stop").otherwise("breath")
    return heard.join(first, [key, "id"], "left").withColumn("kind", kind).drop("_first", "stops", "time")


def pause_cuts(pauses: DataFrame) -> DataFrame:
    """What to cut out of pauses (start, end, kind): all beyond the floor of the kind and a seventh or so of
    the rest, more of what is kept before the cut than after it; short cuts are none."""
    floor = F.coalesce(*[F.when(F.col("kind") == kind, ms) for kind, ms in PAUSE_FLOOR.items()])
    length = F.col("end") - F.col("start")
    keep = F.least(length, floor + F.least(F.lit(300), F.floor(F.greatest(F.lit(0), length - floor) * 15 / 100)))
    shorter = pauses.withColumn("_keep", keep).where(length - F.col("_keep") >= 2 * SHORTEST_CUT)
    before = F.floor(F.col("_keep") * 6 / 10)
    return shorter.withColumns({"cut_start": F.col("start") + before, "cut_end": F.col("end") - (F.col("_keep") - before)}).drop("_keep")


def fitted(recordings: DataFrame, tails: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How a recording (length by hand, length shortened, target) is brought to its target: as it is, with its
    pauses shortened, faster, or with the last verses dropped (tails: keys, nth, length up to that verse).

    Columns way, percent of the speed and, where verses go, how many.
    """
    percent = F.ceil(F.col("shortened") * 100 / F.col("target"))
    way = F.when(F.col("by_hand") <= F.col("target"), "plain").when(F.col("shortened") <= F.col("target"), "shortened").when(percent <= FASTEST, "faster").otherwise("dropped")
    judged = recordings.withColumns({"way": way, "percent": F.when(way == "faster", percent).when(way == "dropped", FASTEST).otherwise(100)})
    last = Window.partitionBy(*keys)
    fits = tails.join(judged.where("way = 'dropped'").select(*keys, "target"), list(keys)).withColumn("_verses", F.count("*").over(last))
    fits = fits.where((F.col("length") * 100 <= F.col("target") * FASTEST) & (F.col("nth") > 0)).groupBy(*keys).agg(F.min(F.col("_verses") - F.col("nth")).alias("dropped"))
    return judged.join(fits, list(keys), "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))


def moved_blocks(blocks: DataFrame, keys: Sequence[str], wanted: Column, duration: Column) -> DataFrame:
    """Each block as if it alone were moved to the wanted start: as long as before, between its neighbours."""
    line = Window.partitionBy(*keys).orderBy("start")
    floor, ceiling = F.coalesce(F.lag("end").over(line), F.lit(0)), F.coalesce(F.lead("start").over(line), duration)
    length = F.col("end") - F.col("start")
    start = F.least(F.greatest(wanted, floor), F.greatest(floor, ceiling - length))
    return blocks.withColumns({"to_start": start, "to_end": start + length})


def resized_blocks(blocks: DataFrame, keys: Sequence[str], edge: str, wanted: Column, duration: Column) -> DataFrame:
    """Each block as if one of its edges alone were moved: its neighbours are walls, SHORTEST_BLOCK stays."""
    line = Window.partitionBy(*keys).orderBy("start")
    floor, ceiling = F.coalesce(F.lag("end").over(line), F.lit(0)), F.coalesce(F.lead("start").over(line), duration)
    start, end = F.col("start"), F.col("end")
    if edge == "start":
        return blocks.withColumns({"to_start": F.least(F.greatest(wanted, floor), F.greatest(floor, end - SHORTEST_BLOCK)), "to_end": end})
    return blocks.withColumns({"to_start": start, "to_end": F.least(F.greatest(wanted, start + SHORTEST_BLOCK), F.greatest(start + SHORTEST_BLOCK, ceiling))})


def appended_blocks(blocks: DataFrame, keys: Sequence[str], duration: Column) -> DataFrame:
    """The blocks and one more (added true) of each lane: on the free tail, else on the second half of the last
    block; lanes whose last block is too short to halve stay."""
    lane = Window.partitionBy(*keys)
    last = F.row_number().over(lane.orderBy(F.desc("start"))) == 1
    marked = blocks.withColumns({"_last": last, "_duration": duration})
    half = F.floor((F.col("start") + F.col("end")) / 2)
    free, room = F.col("end") <= F.col("_duration") - SHORTEST_BLOCK, F.col("end") - F.col("start") >= 2 * SHORTEST_BLOCK
    halved = F.col("_last") & ~free & room
    kept = marked.withColumns({"end": F.when(halved, half).otherwise(F.col("end")), "added": F.lit(False)})
    more = marked.where(F.col("_last") & (free | room)).withColumns({"start": F.when(free, F.col("end")).otherwise(half), "end": F.when(free, F.col("_duration")).otherwise(F.col("end")), "added": F.lit(True)})
    return kept.unionByName(more).drop("_last", "_duration")


def clamped_into(spans: DataFrame, captions: DataFrame, key: str, cell: int) -> DataFrame:
    """Spans (key, id, start, end) cut to the caption (start, end) that holds their middle; others stay."""
    middles = spans.withColumn("_middle", F.floor((F.col("start") + F.col("end")) / 2)).withColumn("_cell", F.floor(F.col("_middle") / cell))
    walls = captions.select(key, F.col("start").alias("_a"), F.col("end").alias("_b")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor((F.col("_b") - 1) / cell))))
    held = middles.join(walls, [key, "_cell"]).where((F.col("_middle") >= F.col("_a")) & (F.col("_middle") < F.col("_b"))).select(key, "id", "_a", "_b")
    both = spans.join(held, [key, "id"], "left")
    return both.withColumns({"start": F.greatest(F.col("start"), F.coalesce("_a", "start")), "end": F.least(F.col("end"), F.coalesce("_b", "end"))}).drop("_a", "_b")


def nearest_spans(points: DataFrame, spans: DataFrame, key: str, reach: int) -> DataFrame:
    """Points (key, id, time) with the nearest span within reach, of equal ones the longest, then the first."""
    wide = points.withColumn("_cell", F.explode(F.array(*[F.floor(F.col("time") / reach) + d for d in (-1, 0, 1)])))
    dealt = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))))
    gap = F.greatest(F.col("start") - F.col("time"), F.col("time") - F.col("end"), F.lit(0))
    near = wide.join(dealt, [key, "_cell"]).withColumn("gap", gap).where(F.col("gap") <= reach)
    best = near.groupBy(key, "id", "time").agg(F.min(F.struct("gap", (F.col("start") - F.col("end")).alias("_short"), "start", "end")).alias("_best"))
    return best.select(key, "id", "time", "_best.start", "_best.end", "_best.gap")


def to_the_voice(captions: DataFrame, quiet: DataFrame, keys: Sequence[str], order: Sequence[str], lead: int = 400, tail: int = 1000) -> DataFrame:
    """Captions (start, end, said, last_word) whose first one opens shortly before what is said, and whose last one
    ends soon after the quiet begins that it ends in."""
    line = Window.partitionBy(*keys).orderBy(*order)
    placed = captions.withColumns({"_first": F.row_number().over(line) == 1, "_last": F.lead(F.lit(1)).over(line).isNull()})
    ends = placed.where("_last AND last_word IS NOT NULL").select(*keys, F.col("end").alias("_end"), F.col("last_word").alias("_word"))
    # one row for each key: the quiet stretches of a key meet only its own last caption
    near = quiet.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b")).join(ends, list(keys)).where("_b >= _end - 100 AND _a <= _end AND _a >= _word")
    first = near.groupBy(*keys).agg(F.min("_a").alias("_quiet"))
    both = placed.join(first, list(keys), "left")
    opens = F.when(F.col("_first") & (F.col("said") - lead > F.col("start")), F.col("said") - lead).otherwise(F.col("start"))
    closes = F.when(F.col("_last") & (F.col("_quiet") + tail < F.col("end")), F.col("_quiet") + tail).otherwise(F.col("end"))
    return both.withColumns({"start": opens, "end": closes}).drop("_first", "_last", "_quiet")


def with_repeats(captions: DataFrame, repeats: DataFrame, key: str, cell: int, sliver: int = 300) -> DataFrame:
    """Captions (key, id, start, end) cut where a repeat begins or ends inside them, without those that repeats cover
    for more than half and without slivers beside a repeat; repeats (start, end) lie apart. The repeats follow, id null."""
    wide = captions.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    dealt = repeats.select(key, F.col("start").alias("_a"), F.col("end").alias("_b")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / cell), F.floor(F.col("_b") / cell))))
    met = wide.join(dealt, [key, "_cell"]).where("_b >= start AND _a <= end").select(key, "id", "_a", "_b").distinct()
    near = met.groupBy(key, "id").agg(F.collect_list(F.struct("_a", "_b")).alias("_runs"))
    joined = captions.join(near, [key, "id"], "left").withColumn("_runs", F.coalesce("_runs", F.expr("array()").cast("array<struct<_a: bigint, _b: bigint>>")))
    cut = F.array_min(F.transform(F.filter("_runs", lambda r: (r["_a"] > F.col("start")) & (r["_a"] < F.col("end"))), lambda r: r["_a"]))
    clipped = joined.withColumn("end", F.coalesce(cut, F.col("end")))
    covered = F.aggregate("_runs", F.lit(0).cast("long"), lambda s, r: s + F.greatest(F.lit(0), F.least(r["_b"], F.col("end")) - F.greatest(r["_a"], F.col("start"))))
    kept = clipped.where(covered * 2 <= F.col("end") - F.col("start"))
    inside = F.array_min(F.transform(F.filter("_runs", lambda r: (F.col("start") >= r["_a"]) & (F.col("start") < r["_b"])), lambda r: r["_b"]))
    moved = kept.withColumn("start", F.coalesce(inside, F.col("start")))
    beside = F.exists("_runs", lambda r: (r["_a"] == F.col("end")) | (r["_b"] == F.col("start")))
    left = moved.where((F.col("end") - F.col("start") >= sliver) | ~beside).select(key, "id", "start", "end")
    return left.unionByName(repeats.select(key, F.lit(None).cast(captions.schema["id"].dataType).alias("id"), "start", "end"))


def layers_at(times: DataFrame, captions: DataFrame, key: str, wanted: int) -> DataFrame:
    """Times (key, time) with what is shown: columns shown and leaving (ids of captions, null for none) and the
    thousandths of the change from the one to the other; captions (key, id, start, end) lie in order."""
    line = Window.partitionBy(key).orderBy("start")
    before = F.lag(F.struct("id", "start", "end")).over(line)

    def window(prior: Column) -> Column:
        over = F.greatest(F.lit(0), wanted - F.greatest(F.lit(0), F.col("start") - prior["end"]))
        half = F.floor(over / 2)
        fades_in = F.col("start") - F.least(F.lit(wanted), F.greatest(F.lit(0), F.col("start")))
        begin = F.when(prior.isNull(), fades_in).otherwise(F.greatest(prior["start"], F.col("start") - wanted + half))
        end = F.when(prior.isNull(), F.col("start")).otherwise(F.least(F.col("end"), F.col("start") + half))
        return F.struct(begin.alias("a"), end.alias("b"))

    noted = captions.withColumn("_prior", before).withColumn("_window", window(F.col("_prior")))
    change = F.struct(F.col("id").alias("id"), F.col("_prior.id").alias("prior"), F.col("_window.a").alias("a"), F.col("_window.b").alias("b"))
    noted = noted.withColumn("_own", change).withColumn("_next", F.lead(change).over(line))
    first = noted.groupBy(key).agg(F.min_by("_own", "start").alias("_first"))
    met = asof_join(times, noted.select(key, F.col("start").alias("time"), F.struct("_own", "_next").alias("_now")), key, "time", "_now").join(first, key, "left")
    following = F.when(F.col("_now").isNull(), F.col("_first")).otherwise(F.col("_now._next"))
    met = met.withColumn("_following", following)
    inside = lambda c: c.isNotNull() & (F.col("time") >= c["a"]) & (F.col("time") < c["b"])
    own = F.col("_now._own")
    chosen = F.when(inside(F.col("_following")), F.col("_following")).when(inside(own), own)
    met = met.withColumn("_chosen", chosen)
    progress = F.floor((F.col("time") - F.col("_chosen.a")) * 1000 / (F.col("_chosen.b") - F.col("_chosen.a")))
    return met.select(key, "time", F.coalesce("_chosen.id", "_now._own.id").alias("shown"), F.col("_chosen.prior").alias("leaving"), progress.alias("thousandths"))
