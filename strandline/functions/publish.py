"""Titles, tags and descriptions that fit the limits of the place they are published at, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import fnv_hash

#: Fixed values of the limits, in characters.
TITLE_MOST, DESCRIPTION_MOST, TAGS_MOST = 100, 5000, 500
#: The tag of every title, and those that a title may add, in an order that its seed decides.
SHORT = "#Shorts"
TITLE_TAGS = ("#Quran", "#BeautifulRecitation")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def clipped(text: Column, most: Column | int) -> Column:
    """The text, or as much of it as leaves room for the sign that it goes on."""
    room = F.lit(most) if isinstance(most, int) else most
    cut = F.concat(_trim_end(F.substring(text, F.lit(1), F.greatest(room - 1, F.lit(0)))), F.lit("…"))
    return F.when(F.length(text) <= room, text).otherwise(cut)


def reference(chapter: Column, first: Column, last: Column) -> Column:
    return F.concat(chapter.cast("string"), F.lit(":"), first.cast("string"), F.when(last > first, F.concat(F.lit("-"), last.cast("string"))).otherwise(""))


def fitted_title(subject: Column, author: Column, extras: Column, most: int = TITLE_MOST) -> Column:
    """title and truncated: the fullest of the titles that fit. First the extra tags go, from the last; then the author; then it is cut."""
    named = F.concat(subject, F.when(F.length(author) > 0, F.concat(F.lit(" | "), author)).otherwise(""))
    fewer = F.transform(F.sequence(F.size(extras), F.lit(0)), lambda k: _trim_end(F.concat(named, F.lit(f" {SHORT} "), F.array_join(F.slice(extras, 1, k), " "))))
    ways = F.concat(fewer, F.array(F.concat(subject, F.lit(f" {SHORT}"))))

    def fitted(ways: Column) -> Column:
        fits = F.try_element_at(F.filter(ways, lambda w: F.length(w) <= most), F.lit(1))
        return _bound(F.coalesce(fits, F.element_at(ways, -1)), lambda chosen: F.struct(clipped(chosen, most).alias("title"), (chosen != F.element_at(ways, 1)).alias("truncated")))

    return _bound(ways, fitted)


def kept_tags(tags: Column, most: int = TAGS_MOST, between: int = 2) -> Column:
    """tags and truncated: whole tags in order, each that still fits with what stands between two; empty ones are no tags."""
    fine = F.filter(tags, lambda t: F.length(t) > 0)

    def step(done: Column, tag: Column) -> Column:
        cost = F.length(tag) + F.when(F.size(done["tags"]) > 0, between).otherwise(0)
        fits = done["used"] + cost <= most
        return F.struct(
            F.when(fits, F.concat(done["tags"], F.array(tag))).otherwise(done["tags"]).alias("tags"), F.when(fits, done["used"] + cost).otherwise(done["used"]).alias("used"), (done["truncated"] | ~fits).alias("truncated")
        )

    start = F.struct(F.array().cast("array<string>").alias("tags"), F.lit(0).alias("used"), F.lit(False).alias("truncated"))
    folded = F.aggregate(fine, start, step)
    return F.struct(folded["tags"].alias("tags"), folded["truncated"].alias("truncated"))


def description(head: Column, blocks: Column, tail: Column, most: int = DESCRIPTION_MOST) -> Column:
    """description and truncated: head, the distinct blocks and tail, a blank line between; the blocks give way, the rest stays.

    blocks are structs of a key and a text; the first of each key counts, and empty texts do not.
    """
    first = F.filter(blocks, lambda b, i: ~F.exists(F.slice(blocks, 1, i), lambda earlier: earlier["key"] == b["key"]))
    body = F.array_join(F.transform(F.filter(first, lambda b: F.length(b["text"]) > 0), lambda b: b["text"]), "\n\n")
    room = F.lit(most) - F.length(head) - F.length(tail) - 4
    long = F.length(body) > room
    fitted = F.when(long, clipped(body, F.greatest(room, F.lit(0)))).otherwise(body)
    whole = F.array_join(F.filter(F.array(head, fitted, tail), lambda part: F.length(part) > 0), "\n\n")
    return F.struct(clipped(whole, most).alias("description"), long.alias("truncated"))


def fnv36(text: Column, begin: int, prime: int) -> Column:
    """The last six digits to base 36 of the 32-bit FNV-1a hash of a text's UTF-16 units."""
    value = fnv_hash(text, begin, prime)
    return F.right(F.concat(F.lit("00000"), F.lower(F.conv(value.cast("string"), 10, 36))), F.lit(6))
