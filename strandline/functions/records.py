"""Rules on single records: making stored values safe, picking and merging them, small codecs. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for the words before a passage, and the path of an edited recording.
OPENINGS = ("istiadha", "basmala")
EDITED_PATH, PASSAGE_PATH = "/api/audio/edited", "/api/audio/ayahs"
KEY = r"^\d+:\d+$"


def parsed_key(key: Column, chapter: Column, verse: Column) -> Column:
    """chapter:verse as it stands, or built from its parts; null without a verse above 0."""
    return F.when(key.rlike(KEY), key).when((verse > 0) & chapter.isNotNull(), F.concat_ws(":", chapter.cast("string"), verse.cast("string")))


def is_opening(key: Column) -> Column:
    return F.coalesce(key.isin(*OPENINGS), F.lit(False))


def sane_text(text: Column, most: int) -> Column:
    """Trimmed and no longer than `most`; null where nothing is left."""
    trimmed = F.trim(text)
    return F.when(trimmed != "", F.substring(trimmed, 1, most))


def sane_tags(texts: dict[str, Column], track: Column, most: int = 200) -> Column:
    """A struct of the texts and the track (1 to 999); null where nothing of them is usable."""
    fields = {name: sane_text(text, most) for name, text in texts.items()} | {"track": F.when((track > 0) & (track < 1000), track)}
    return F.when(F.coalesce(*[f.cast("string") for f in fields.values()]).isNotNull(), F.struct(*[f.alias(name) for name, f in fields.items()]))


def sane_clips(clips: Column, most: int = 100, shortest: int = 1000) -> Column:
    """Of the first `most` clips (id, start, end) those with an id, inside the recording and long enough."""
    fine = F.filter(F.slice(clips, 1, most), lambda c: (F.coalesce(c["id"], F.lit("")) != "") & (c["start"] >= 0) & (c["end"] - c["start"] >= shortest))
    return F.transform(fine, lambda c: F.struct(F.substring(c["id"], 1, 64).alias("id"), c["start"].alias("start"), c["end"].alias("end")))


def sane_payload(count: Column, first: Column, last: Column, most: int) -> Column:
    """Why a request cannot be served: count, order, size or null where it can."""
    return F.when(count.isNull() | (count < 1), "count").when(first.isNull() | last.isNull() | (last < first), "order").when(last - first + 1 > most, "size")


def overlaid(base: Column, own: Column) -> Column:
    """Map with the entries of both; where both have a key, its own."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(own, F.create_map().cast("map<string,string>"))), k))
    return F.when(own.isNull(), base).otherwise(F.map_concat(kept, own))


def changed_entries(config: Column, base: Column) -> Column:
    """The entries of a map that the base has not, or has otherwise."""
    return F.map_filter(config, lambda k, v: ~v.eqNullSafe(base[k]))


def without_keys(entries: Column, removed: Column) -> Column:
    """The map without some keys; null where nothing is left."""
    kept = F.map_filter(entries, lambda k, _: ~F.array_contains(removed, k))
    return F.when(F.size(kept) > 0, kept)


def toggled(ids: Column, chosen: Column, most: int) -> Column:
    """The list with the id taken out or put at its end, never empty and never beyond `most`."""
    return (
        F.when(F.array_contains(ids, chosen), F.when(F.size(ids) == 1, ids).otherwise(F.filter(ids, lambda i: i != chosen)))
        .when(F.size(ids) >= most, ids)
        .otherwise(F.concat(ids, F.array(chosen)))
    )


def all_hold(rows: Column, holds) -> Column:
    """Whether there are rows and every one meets the condition."""
    return (F.size(rows) > 0) & F.forall(rows, holds)


def filled_by_position(rows: Column, other: Column) -> Column:
    """Missing values of a list from the same places of another, only where both are equally long."""
    return F.when(F.size(rows) == F.size(other), F.zip_with(rows, other, lambda a, b: F.coalesce(a, b))).otherwise(rows)


def hidden_by_both(first: Column, second: Column) -> Column:
    """Flags of two lists of the same words: hidden only where both hide; of different lists, one after the other."""
    return F.when(F.size(first) == F.size(second), F.zip_with(first, second, lambda a, b: a & b)).otherwise(F.concat(first, second))


def gloss_line(words: Column) -> Column:
    """The glosses of the words (gloss, excluded) that are shown, as one line."""
    shown = F.transform(F.filter(words, lambda w: ~w["excluded"]), lambda w: F.trim(F.coalesce(w["gloss"], F.lit(""))))
    return F.array_join(F.filter(shown, lambda g: g != ""), " ")


def first_fitting(candidates: Sequence[Column], most: int) -> tuple[Column, Column]:
    """(title, truncated): the first candidate that fits, else the last one cut and ended with an ellipsis."""
    listed = F.array(*candidates)
    fits = F.filter(listed, lambda c: F.length(c) <= most)
    cut = F.concat(F.rtrim(F.substring(candidates[-1], 1, most - 1)), F.lit("…"))
    return F.when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(cut), F.size(fits) == 0


def preferred_text(wanted: Column, carried: Column, local: Column) -> Column:
    """The text of the first wanted id that came along, its local copy before any other id, else any text."""
    first = F.get(wanted, F.lit(0))
    has = lambda i: F.coalesce(carried[i], F.lit("")) != ""
    rest = F.filter(F.slice(wanted, 2, F.greatest(F.size(wanted) - 1, F.lit(0))), has)
    anything = F.filter(F.map_values(carried), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(F.when(has(first), carried[first]), F.nullif(local[first], F.lit("")), carried[F.get(rest, F.lit(0))], F.get(anything, F.lit(0)), F.lit(""))


def clamped_segments(segments: Column, offset: Column, length: Column) -> Column:
    """Segments (number, start, end) on the clock of a file that begins at the offset, cut to it; empty ones go."""
    inside = lambda t: F.greatest(F.lit(0), F.least(length, t - offset))
    moved = F.transform(segments, lambda s: F.struct(s["number"].alias("number"), inside(s["start"]).alias("start"), inside(s["end"]).alias("end")))
    return F.filter(moved, lambda s: s["end"] > s["start"])


def reference_words(text: Column) -> Column:
    """Words (key, place, word) of lines that hold a key, a tab and words; lines without a tab are ignored."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line)), lambda line: F.instr(line, "\t") > 0)
    parts = lambda line: F.filter(F.split(F.substring_index(line, "\t", -1), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(lines, lambda line: F.transform(parts(line), lambda w, i: F.struct(F.trim(F.substring_index(line, "\t", 1)).alias("key"), i.alias("place"), w.alias("word")))))


def made_at(clip: Column, earliest: int, latest: int) -> Column:
    """Milliseconds since 1970 out of an id whose middle is that time in base 36; null outside the bounds."""
    stamp = F.regexp_extract(clip, r"^clip-([0-9a-z]+)-\d+$", 1)
    time = F.when((stamp != "") & (F.length(stamp) <= 10), F.conv(stamp, 36, 10).cast("long"))
    return F.when((time >= earliest) & (time <= latest), time)


def encoded_edit(cuts: Column, tempo: Column, loudness: Column, denoise: Column) -> Column:
    """An edit as short text: JSON of cuts (start, end, auto), tempo and switches, in URL-safe base 64."""
    spans = F.array_join(F.transform(cuts, lambda c: F.concat(F.lit("["), c["start"].cast("string"), F.lit(","), c["end"].cast("string"), F.when(c["auto"], ",1]").otherwise("]"))), ",")
    text = F.concat(F.lit('{"c":['), spans, F.lit('],"t":'), tempo.cast("string"), F.lit(',"l":'), loudness.cast("int").cast("string"), F.lit(',"d":'), denoise.cast("int").cast("string"), F.lit("}"))
    return F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), r"=+$|\s", "")


def decoded_edit(text: Column) -> Column:
    """The edit of encoded text as a struct (c, t, l, d); null for anything else."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    readable = F.when(plain.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(plain) % 4 != 1), F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"))
    edit = F.from_json(readable, "c array<array<double>>, t double, l int, d int")
    return F.when(edit["c"].isNotNull(), edit)


def edited_source(address: Column) -> Column:
    """The passage behind an address: of an edited recording its own address without the edit, else as it stands."""
    query = F.regexp_replace(F.regexp_extract(address, r"\?(.*)$", 1), r"(^|&)edit=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    edited = F.substring_index(address, "?", 1) == EDITED_PATH
    return F.when(~edited, address).when(query.rlike("(^|&)reciter="), F.concat(F.lit(PASSAGE_PATH + "?"), query)).otherwise("")


def edit_of(address: Column) -> Column:
    """The encoded edit of the address of an edited recording, else null."""
    return F.when(F.substring_index(address, "?", 1) == EDITED_PATH, F.nullif(F.regexp_extract(address, r"[?&]edit=([^&]*)", 1), F.lit("")))


def answer_json(text: Column) -> Column:
    """The JSON object in a model's answer: without fences, from the first to the last brace, commas before a
    closing bracket dropped."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(json)?\s*", ""), r"```$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.regexp_replace(F.when(found != "", found).otherwise(bare), r",\s*([}\]])", "$1")
