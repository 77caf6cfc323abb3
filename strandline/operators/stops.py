"""Where a reader stopped, from what the recording shows at each join, and the captions that follow from it.

Keys name a recording. Heard words are rows (keys, verse, word, start, end), word counting from 1; cuts are places a
caption may start: (keys, verse, word, at), with the rules of the text as flags; quiet and silences are spans.
Spans meet words by joins over time cells, and every measure of a cut is one aggregate of such a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import overlap_join

#: Fixed value, in milliseconds: a shorter word takes nothing out of a quiet span.
SPOKEN = 50


@dataclass(frozen=True)
class StopRules:
    """Fixed values of the rules, in milliseconds."""

    breath: int = 300  # quiet that a breath needs
    word_gap: int = 600  # between two words, where no quiet can be measured
    silence: int = 400  # with nothing said
    quiet: int = 200  # that such a silence needs in it
    sung: int = 2500  # with nothing said, where notes are held
    edge: int = 300  # how far from a quiet span a cut may stand
    drift: int = 500  # how far from a cut its words may stand
    reach: int = 200  # how far the edges of a join may be off
    held_factor: int = 2  # quiet that a held sound asks for


def _overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """left (keys, id, l_start, l_end) with the length of each overlap with right (keys, start, end)."""
    met = overlap_join(left, right.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")), keys, cell)
    return met.withColumn("shared", F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))


def unspoken(quiet: DataFrame, heard: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """quiet (keys, start, end) with `unspoken`: its length without the words placed in it."""
    numbered = quiet.select(*keys, F.col("start").alias("l_start"), F.col("end").alias("l_end")).where("l_end > l_start")
    words = heard.where(F.col("end") - F.col("start") > SPOKEN)
    taken = _overlaps(numbered.distinct(), words, keys, cell).groupBy(*keys, "l_start", "l_end").agg(F.sum("shared").alias("taken"))
    left = numbered.join(taken, [*keys, "l_start", "l_end"], "left")
    return left.select(*keys, F.col("l_start").alias("start"), F.col("l_end").alias("end"), (F.col("l_end") - F.col("l_start") - F.coalesce("taken", F.lit(0))).alias("unspoken"))


def join_evidence(cuts: DataFrame, heard: DataFrame, quiet: DataFrame, silences: DataFrame, keys: Sequence[str], cell: int, rules: StopRules = StopRules()) -> DataFrame:
    """cuts with what the recording shows at each: breath, word_gap, unsaid and quiet_inside, 0 where nothing does.

    breath is the most unspoken quiet close by; word_gap lies between the word before the cut, the last one said by
    then, and the cut's own word, the first one said from then; unsaid is the longest silence between their
    edges, a little to either side, and quiet_inside all quiet there. Words of other verses are no edges.
    """
    at = [*keys, "verse", "word", "at"]
    near = unspoken(quiet, heard, keys, cell)
    around = cuts.select(*at, (F.col("at") - rules.edge).alias("l_start"), (F.col("at") + rules.edge + 1).alias("l_end")).distinct()
    closed = near.select(*keys, F.col("start").alias("r_start"), (F.col("end") + 1).alias("r_end"), "unspoken")
    breath = overlap_join(around, closed, keys, cell).groupBy(*at).agg(F.max("unspoken").alias("breath"))
    said = heard.where(F.col("end") - F.col("start") > SPOKEN).select(*keys, "verse", F.col("word").alias("w"), "start", "end")
    own = cuts.select(*at).distinct().join(said, [*keys, "verse"]).where(F.col("w").between(F.col("word") - 1, F.col("word")))
    edges = own.groupBy(*at).agg(
        F.max(F.when((F.col("w") == F.col("word") - 1) & (F.col("end") <= F.col("at") + rules.drift), F.struct("start", "end"))).alias("b"),
        F.min(F.when((F.col("w") == F.col("word")) & (F.col("start") >= F.col("at") - rules.drift), F.struct("start", "end"))).alias("a"),
    )
    met = cuts.join(breath, at, "left").join(edges, at, "left")
    met = met.withColumns({
        "from": F.coalesce(F.col("b.end"), F.col("at") - rules.edge) - rules.reach,
        "to": F.coalesce(F.col("a.start"), F.col("at") + rules.edge) + rules.reach,
        "word_gap": F.coalesce(F.col("a.start") - F.col("b.end"), F.lit(0)),
        "breath": F.coalesce("breath", F.lit(0)),
    })
    spans = met.select(*at, F.col("from").alias("l_start"), F.col("to").alias("l_end")).where("l_end > l_start").distinct()
    unsaid = _overlaps(spans, silences, keys, cell).groupBy(*at).agg(F.max("shared").alias("unsaid"))
    inside = _overlaps(spans, quiet, keys, cell).groupBy(*at).agg(F.sum("shared").alias("quiet_inside"))
    out = met.join(unsaid, at, "left").join(inside, at, "left").drop("a", "b", "from", "to")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("unsaid", "quiet_inside")})


def stops_heard(evidence: DataFrame, measured: Column, listened: Column, sung: Column, rules: StopRules = StopRules()) -> Column:
    """Whether the reader stopped at a cut, from its evidence and the flags licensed, breathable and held.

    `measured` says that quiet was measured in the recording at all, `listened` that its silences were, `sung` that notes
    are held in it. A licence needs a breath, a clear gap, or a silence that also fell quiet; a place to breathe needs the
    breath, across a held sound a longer one. Where notes are held only a long silence counts.
    """
    breath = F.col("breath")
    silent = (F.col("unsaid") >= rules.silence) & (F.col("quiet_inside") >= rules.quiet)
    licensed = (breath >= rules.breath) | (F.col("word_gap") >= rules.word_gap) | ~measured | (listened & silent)
    spoken = F.when(F.col("licensed"), licensed).when(F.col("breathable"), breath >= rules.breath).otherwise(F.col("held") & (breath >= rules.breath * rules.held_factor))
    held = (F.col("licensed") | F.col("breathable")) & (F.col("unsaid") >= rules.sung)
    return F.when(sung & listened, held).otherwise(spoken)


def moved_starts(words: DataFrame, heard: DataFrame, keys: Sequence[str], late: int = 500, named_letters: Column | None = None) -> DataFrame:
    """words (keys, verse, word, start, end) with starts moved to where they were heard, if at least `late` later.

    Only for a verse read plainly: listed and heard once, word by word. `named_letters` is true of verses whose first
    word keeps its start. No word then starts by the one before it, nor runs past the next one's start.
    """
    verse = [*keys, "verse"]
    order = lambda start: Window.partitionBy(*verse).orderBy(start, "word")
    whole = Window.partitionBy(*verse)
    plain = lambda df: df.withColumn("nth", F.row_number().over(order("start"))).withColumn("plain", F.min(F.col("word") == F.col("nth")).over(whole)).withColumn("many", F.count("*").over(whole))
    listed = plain(words)
    said = plain(heard).where("plain").select(*verse, "word", F.col("start").alias("h_start"), F.col("end").alias("h_end"), F.col("many").alias("h_many"))
    met = listed.join(said, [*verse, "word"], "left").withColumn("ok", F.col("plain") & F.coalesce(F.col("many") == F.col("h_many"), F.lit(False)))
    stays = F.lit(False) if named_letters is None else named_letters & (F.col("word") == 1)
    moves = F.col("ok") & (F.col("h_start") - F.col("start") >= late) & ~stays
    first = met.withColumns({"start": F.when(moves, F.col("h_start")).otherwise(F.col("start")), "end": F.when(moves, F.greatest("end", "h_end")).otherwise(F.col("end"))})
    each = F.struct("nth", "word", "start", "end", "h_start", "h_end", *(c for c in words.columns if c not in (*verse, "word", "start", "end")))
    rows = first.groupBy(*verse).agg(F.array_sort(F.collect_list(each)).alias("rows"), F.min("ok").alias("ok"))

    def in_order(done: Column, row: Column) -> Column:
        last = F.element_at(done, -1)
        pushed = row.withField("end", F.greatest(row["end"], row["h_end"])).withField("start", row["h_start"])
        return F.concat(done, F.array(F.when(row["start"] <= last["start"], pushed).otherwise(row)))

    kept = F.when(F.col("ok"), F.aggregate(F.slice("rows", 2, F.size("rows")), F.slice("rows", 1, 1), in_order)).otherwise(F.col("rows"))
    out = rows.select(*verse, "ok", F.explode(kept).alias("r")).select(*verse, "ok", "r.*")
    after = F.lead("start").over(Window.partitionBy(*verse).orderBy("nth"))
    return out.withColumn("end", F.when(F.col("ok"), F.least("end", F.coalesce(after, F.col("end")))).otherwise(F.col("end"))).select(*words.columns)


def cut_places(words: DataFrame, stops: DataFrame, verse: Sequence[str], tolerance: int, lone_tolerance: int) -> DataFrame:
    """(verse keys, place, at): the join among recited words (verse keys, place, word, start) that each stop means.

    It is the one nearest in time, the first of equally near ones, if within the tolerance; a join recited once has
    nothing to be told apart from and may stand further off.
    """
    order = Window.partitionBy(*verse).orderBy("place")
    joins = words.withColumn("before", F.lag("word").over(order)).where("before = word - 1").select(*verse, "place", "word", "start")
    met = stops.select(*verse, "word", "at").distinct().join(joins, [*verse, "word"])
    away = F.abs(F.col("start") - F.col("at"))
    best = met.groupBy(*verse, "word", "at").agg(F.min(F.struct(away.alias("away"), "place")).alias("best"), F.count("*").alias("many"))
    near = F.col("best.away") <= F.when(F.col("many") == 1, lone_tolerance).otherwise(tolerance)
    return best.where(near).select(*verse, F.col("best.place").alias("place"), "at")


def planned_captions(words: DataFrame, verses: DataFrame, places: DataFrame, verse: Sequence[str]) -> DataFrame:
    """(verse keys, caption, first_word, last_word, start, end, restart): captions of verses from recited words and stops.

    verses has rows (verse keys, words, from, to). A caption starts with the verse, where the reading went back, and
    where the reader stopped. Every word is on screen: the first caption starts at word 1, the last one ends with
    the verse; one that the next carries on from ends where that one starts, one that was gone back from ends where it broke
    off. A stop's own time counts if it comes after the word before it began; of several at one place the latest.
    """
    order = Window.partitionBy(*verse).orderBy("place")
    at = places.groupBy(*verse, "place").agg(F.lit(True).alias("stop"), F.sort_array(F.collect_list("at")).alias("times"))
    met = words.join(at, [*verse, "place"], "left").withColumns({"was": F.lag("word").over(order), "was_start": F.lag("start").over(order)})
    back = F.coalesce(F.col("word") <= F.col("was"), F.lit(False))
    heard_at = F.array_max(F.filter("times", lambda t: t > F.col("was_start")))
    met = met.withColumns({"restart": back, "heard_at": heard_at, "opens": F.col("was").isNull() | back | F.col("stop").isNotNull()})
    numbered = met.withColumn("caption", F.count_if("opens").over(order) - 1)
    lines = numbered.groupBy(*verse, "caption").agg(
        F.min_by("word", "place").alias("first_word"), F.max_by("word", "place").alias("broke_off"), F.min_by("start", "place").alias("w_start"), F.min_by("end", "place").alias("first_end"), F.max_by("end", "place").alias("w_end"),
        F.min_by("heard_at", "place").alias("heard_at"), F.min_by("restart", "place").alias("restart"),
    )
    nxt = Window.partitionBy(*verse).orderBy("caption")
    lead = lambda c: F.lead(c).over(nxt)
    wide = lines.join(verses.select(*verse, F.col("words").alias("of"), F.col("from").alias("v_from"), F.col("to").alias("v_to")), list(verse))
    starts = F.coalesce("heard_at", "w_start")
    wide = wide.withColumns({"n_word": lead("first_word"), "n_restart": lead("restart"), "n_start": lead(starts)})
    opens = F.col("caption") == 0
    start = F.when(opens, F.when(F.col("v_from") < F.col("first_end"), F.col("v_from")).otherwise(F.col("w_start"))).otherwise(starts)
    last = F.when(F.col("n_word").isNull(), F.col("of")).when(F.col("n_restart"), F.col("broke_off")).otherwise(F.col("n_word") - 1)
    end = F.when(F.col("n_word").isNotNull(), F.col("n_start")).when(F.col("v_to") > start, F.col("v_to")).otherwise(F.col("w_end"))
    return wide.select(*verse, "caption", F.when(opens, 1).otherwise(F.col("first_word")).alias("first_word"), last.alias("last_word"), start.alias("start"), end.alias("end"), "restart")
