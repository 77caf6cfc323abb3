"""Timecodes, names, sizes and checks of single values, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of a count, of a bitrate, of a check.
LONGEST_CLIP = 6 * 60 * 60
LEAST_BITRATE, MOST_BITRATE, SOUND_BITRATE = 4_000_000, 60_000_000, 128_000
MOST_BYTES = 312_500_000
#: Name, longer edge and hundredths of a bit for each pixel, best first.
TIERS = (("max", 3840, 8), ("high", 2560, 12), ("standard", 1920, 16))
LOW_MATCH = 0.5


def parsed_timecode(text: Column) -> Column:
    """Seconds of h:m:s, m:s or s, each with an optional fraction; null for anything else."""
    part = r"(?:\d+(?:\.\d*)?|\.\d+)"
    parts = F.split(F.trim(text), ":")
    seconds = F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + F.coalesce(p.try_cast("double"), F.lit(0.0)))
    return F.when(F.trim(text).rlike(rf"^{part}(?::{part}){{0,2}}$"), seconds)


def formatted_duration(tenths: Column) -> Column:
    """m:ss.s of tenths of a second, h:mm:ss.s from an hour on."""
    hours, minutes = F.floor(tenths / 36_000), F.floor(tenths / 600) % 60
    ss = F.format_string("%02d.%d", F.floor(tenths / 10) % 60, tenths % 10)
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), F.lpad(minutes.cast("string"), 2, "0"), ss)).otherwise(F.concat_ws(":", minutes.cast("string"), ss))


def formatted_tick(seconds: Column) -> Column:
    """m:ss of whole seconds, h:mm:ss from an hour on; none below 0."""
    whole = F.greatest(F.lit(0), seconds)
    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60) % 60
    ss = F.lpad((whole % 60).cast("string"), 2, "0")
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), F.lpad(minutes.cast("string"), 2, "0"), ss)).otherwise(F.concat_ws(":", minutes.cast("string"), ss))


def even_size(long_edge: Column, wide: Column, high: Column) -> Column:
    """(width, height) of a ratio whose longer edge is given, both even and at least 2."""
    even = lambda v: F.greatest(F.lit(2), 2 * F.floor(v / 2 + 0.5)).cast("long")
    return F.when(wide >= high, F.struct(even(long_edge).alias("width"), even(long_edge * high / wide).alias("height"))).otherwise(F.struct(even(long_edge * wide / high).alias("width"), even(long_edge).alias("height")))


def bitrate(width: Column, height: Column, fps: Column, hundredths: int) -> Column:
    """Bits a second at so many hundredths of a bit for each pixel, inside the bounds."""
    return F.least(F.lit(MOST_BITRATE), F.greatest(F.lit(LEAST_BITRATE), F.floor(width * height * fps * hundredths / 100 + 0.5))).cast("long")


def output_plan(wide: Column, high: Column, tier: Column, fps: Column, seconds: Column) -> Column:
    """How a clip is written: the asked tier or the first lower one whose file fits MOST_BYTES, else the lowest at what
    bits are left. Fields tier, width, height, bits, bytes, stepped_down, reduced and too_large."""

    def weight(bits: Column) -> Column:
        return F.floor((bits + SOUND_BITRATE) * seconds / 8 + 0.5).cast("long")

    tried = []
    for rank, (name, edge, hundredths) in enumerate(TIERS):
        size = even_size(F.lit(edge), wide, high)
        bits = bitrate(size["width"], size["height"], fps, hundredths)
        tried.append(F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("tier"), size["width"].alias("width"), size["height"].alias("height"), bits.alias("bits")))
    asked = F.coalesce(*[F.when(tier == name, rank) for rank, (name, *_) in enumerate(TIERS)], F.lit(len(TIERS) - 1))
    allowed = F.filter(F.array(*tried), lambda t: t["rank"] >= asked)
    fits = F.filter(allowed, lambda t: weight(t["bits"]) <= MOST_BYTES)
    chosen = F.coalesce(F.get(fits, F.lit(0)), F.element_at(allowed, -1))
    left = F.greatest(F.lit(LEAST_BITRATE), F.floor(F.lit(MOST_BYTES * 8) / seconds) - SOUND_BITRATE).cast("long")
    bits = F.when(F.size(fits) == 0, left).otherwise(chosen["bits"])
    return F.struct(
        chosen["tier"].alias("tier"), chosen["width"].alias("width"), chosen["height"].alias("height"), bits.alias("bits"), weight(bits).alias("bytes"),
        (chosen["rank"] > asked).alias("stepped_down"), (F.size(fits) == 0).alias("reduced"), (weight(bits) > MOST_BYTES).alias("too_large"),
    )


def export_count(chapter: Column, duration: Column, ratio: Column, chapters: int = 114) -> Column:
    """(chapter, duration, ratio) of a count that may be added; null where duration or ratio are no such values, the
    chapter alone null where it is none."""
    fine = duration.isNotNull() & ~F.isnan(duration) & (duration >= 0) & (duration <= LONGEST_CLIP) & F.coalesce(ratio.rlike(r"^\d{1,2}:\d{1,2}$"), F.lit(False))
    known = F.when((chapter == F.floor(chapter)) & chapter.between(1, chapters), chapter.cast("long"))
    return F.when(fine, F.struct(known.alias("chapter"), F.floor(duration + 0.5).cast("long").alias("duration"), ratio.alias("ratio")))


def caption_checks(found: Column, score: Column, checked: Column) -> Column:
    """Reasons to look at a row: marks found on it and a low score; none once it was checked."""
    has = lambda name: F.coalesce(F.array_contains(found, name), F.lit(False))
    reasons = F.array_compact(F.array(F.when(has("stop_mark"), "stop_mark"), F.when(score < LOW_MATCH, "low_match"), F.when(has("misheard"), "misheard")))
    return F.when(F.coalesce(checked, F.lit(False)), F.array().cast("array<string>")).otherwise(reasons)


def matching_preset(config: Column, presets: Sequence[tuple[str, dict[str, str]]]) -> Column:
    """The name of the first preset all of whose entries the config has."""
    rules = ((name, reduce(lambda a, b: a & b, [config[k].eqNullSafe(F.lit(v)) for k, v in look.items()])) for name, look in presets)
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])


def safe_base_name(name: Column, digest: Column) -> Column:
    """A file's name without its extension, other characters than letters, digits, _ and - as _; where nothing of
    its own is left, with the digest."""
    given = F.when(F.coalesce(name, F.lit("")) == "", "timeline").otherwise(name)
    base = F.regexp_replace(F.regexp_replace(given, r"\.[^.]+$", ""), r"[^A-Za-z0-9_-]+", "_")
    base = F.when(base == "", "timeline").otherwise(base)
    own = F.regexp_replace(F.regexp_replace(base, r"(-trimmed)+$", ""), r"[_-]+", "")
    return F.when(own != "", base).otherwise(F.concat_ws("-", base, digest))


def export_name(name: Column, chapter: Column, first: Column, last: Column, extension: str) -> Column:
    """name_chapter_first-last.extension, blanks as _, without characters that file systems refuse."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", "_"), r'[/\\?%*|"<>:]', "")
    return F.concat(F.when(clean == "", "clip").otherwise(clean), F.lit("_"), chapter.cast("string"), F.lit("_"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(f".{extension}"))


def api_path(url: Column, host: str, base: str) -> Column:
    """What follows the base in an address of the host or in a bare path; null for any other."""
    found = F.regexp_extract(url, rf"^(?:https://\Q{host}\E)?\Q{base}\E(/.*)$", 1)
    return F.when(found != "", found)


def numeric_segments(segments: Column) -> Column:
    """(number, start, end) of segments of four or more texts, the second on; others and non-numbers are dropped."""
    long = F.filter(segments, lambda s: F.size(s) >= 4)
    numbers = F.transform(long, lambda s: F.struct(*[s[i].try_cast("double").alias(n) for i, n in ((1, "number"), (2, "start"), (3, "end"))]))
    return F.filter(numbers, lambda s: s["number"].isNotNull() & s["start"].isNotNull() & s["end"].isNotNull())


def synced_words(stored: Column, current: Column) -> Column:
    """The current words with excluded and time of the stored ones where both are equally many; else all shown, untimed."""
    carried = F.zip_with(current, stored, lambda c, s: F.struct(c.alias("word"), F.coalesce(s["excluded"], F.lit(False)).alias("excluded"), s["time"].alias("time")))
    fresh = F.transform(current, lambda c: F.struct(c.alias("word"), F.lit(False).alias("excluded"), F.lit(None).cast("long").alias("time")))
    return F.when(F.size(stored) == F.size(current), carried).otherwise(fresh)


def length_check(measured: Column, expected: Column, fps: Column) -> Column:
    """ok or problem, by a slack of two frames or a tenth of a second; unsure without a length."""
    slack = F.greatest(2 / fps, F.lit(0.1))
    return F.when(measured.isNull() | F.isnan(measured) | (measured <= 0), "unsure").when(F.abs(measured - expected) <= slack, "ok").otherwise("problem")


def patch_change(first: Column, second: Column) -> Column:
    """Mean difference of two lists of lists of numbers; cells that the second lacks count as equal."""
    cells = F.flatten(F.transform(first, lambda cell, i: F.transform(cell, lambda v, c: F.abs(v - F.coalesce(F.get(F.get(second, i), c), v)))))
    return F.when(F.size(cells) > 0, F.aggregate(cells, F.lit(0.0), lambda a, b: a + b) / F.size(cells)).otherwise(F.lit(0.0))


def lane_at(blocks: Column, time: Column) -> Column:
    """The last of the blocks (start, end, ..) that holds a time, or null: lanes may have gaps."""
    held = F.filter(blocks, lambda b: (F.greatest(time, F.lit(0)) >= b["start"]) & (F.greatest(time, F.lit(0)) < b["end"]))
    return F.get(held, F.size(held) - 1)


def cancelled(state: Column) -> Column:
    """The state of a job when all are called off."""
    return F.when(state.isin("queued", "rendering"), "cancelled").otherwise(state)


def removable(state: Column, job: Column, chosen: Column) -> Column:
    """Whether a job leaves the list: the chosen one, unless it is running."""
    return (job == chosen) & (state != "rendering")
