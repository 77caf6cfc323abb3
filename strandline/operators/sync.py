"""Stored texts and their sources: merging upstream and local copies, freshness, verdicts, queues."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.script import plain_text
from strandline.operators.folds import ordered_fold


def texts_by_key(rows: DataFrame, key: str, edition: str, html: str, number: Column, first: int, last: int) -> DataFrame:
    """(key, texts): cleaned texts of each key by edition, blank ones left out, keys inside the range only."""
    clean = rows.where(number.between(first, last) & F.col(edition).isNotNull()).select(key, F.col(edition).cast("string").alias("_e"), plain_text(F.coalesce(html, F.lit(""))).alias("_t")).where("_t <> ''")
    last_text = clean.groupBy(key, "_e").agg(F.max("_t").alias("_t"))
    return last_text.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_e", "_t")))).alias("texts"))


def filled_from_local(upstream: DataFrame, local: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Every key of both; the upstream's text where it has one, else the local copy, never a blank one."""
    a, b = upstream.select(*keys, F.nullif(F.col(text), F.lit("")).alias("_up")), local.select(*keys, F.nullif(F.col(text), F.lit("")).alias("_own"))
    both = a.join(b, list(keys), "full").select(*keys, F.coalesce("_up", "_own").alias(text))
    return both.where(F.col(text).isNotNull())


def options_in_order(chosen: DataFrame, order: Sequence[str], catalogue: DataFrame, key: str, name: str) -> DataFrame:
    """Chosen ids with the catalogue's name, in their order; an unknown id keeps its place under its own id."""
    named = chosen.join(catalogue.select(key, F.col(name).alias("_name")), key, "left")
    return named.select(*order, key, F.coalesce("_name", F.col(key).cast("string")).alias(name))


def readable(manifest: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """Entries of a manifest whose content is there."""
    return manifest.join(contents.select(key).distinct(), key, "left_semi")


def fresh_only(rows: DataFrame, resources: DataFrame, key: str, resource: str, wanted: Sequence, updated: str, since: Column) -> DataFrame:
    """Rows of the keys for which every wanted resource is there and fresh."""
    fresh = resources.where(F.col(resource).isin(*wanted) & (F.col(updated) >= since)).groupBy(key).agg(F.countDistinct(resource).alias("_n"))
    return rows.join(fresh.where(F.col("_n") == len(wanted)).select(key), key, "left_semi")


def stamped(rows: DataFrame, records: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the columns of the record of their key; rows without a record stay as they are."""
    found = records.select(key, F.struct(*columns).alias("_record"))
    joined = rows.join(found, key, "left")
    return joined.withColumns({c: F.when(F.col("_record").isNotNull(), F.col(f"_record.{c}")).otherwise(F.col(c)) for c in columns}).drop("_record")


def stale(cuts: DataFrame, files: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, stale): whether a cut (url, size, cut_at) is of another file, of no file, or older than a change."""
    now = files.select(key, F.col("url").alias("_url"), F.col("size").alias("_size"), F.col("updated").alias("_updated"))
    last = changes.groupBy(key).agg(F.max("updated").alias("_last"))
    both = cuts.join(now, key, "left").join(last, key, "left")
    other = F.col("_url").isNull() | ~F.col("url").eqNullSafe(F.col("_url")) | ~F.col("size").eqNullSafe(F.col("_size"))
    later = F.coalesce(F.greatest("_updated", "_last") > F.col("cut_at"), F.lit(False))
    return both.select(key, (other | F.col("cut_at").isNull() | later).alias("stale"))


def verdicts(checks: DataFrame, keys: Sequence[str], verse: str, order: str, reason: str) -> DataFrame:
    """(keys, verse, reasons): reasons against a chapter (verse null: the chapter as a whole), in the order found."""
    found = checks.groupBy(*keys, verse).agg(F.array_sort(F.collect_list(F.struct(order, reason))).alias("_r"))
    return found.select(*keys, verse, F.array_join(F.transform("_r", lambda r: r[reason]), "; ").alias("reasons"))


def added_jobs(waiting: DataFrame, added: DataFrame, same: Sequence[str], state: str = "state") -> DataFrame:
    """The added jobs of which no equal one still waits; nulls of the compared columns are equal."""
    queued = waiting.where(F.col(state) == "queued").select(*[F.col(c).alias(f"_{c}") for c in same]).distinct()
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return added.join(queued, equal, "left_anti")


def carried_marks(captions: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Marks (key, id, word, middle) with the first caption (nth, from, to, start, end) of their key that holds
    both the word and its middle; captions without a number come last.

    No mark meets captions one by one. Equal captions and equal marks count once, captions are dealt by word, and one
    pass over both in the order of time keeps those captions alone that may still be the first of a later moment.
    """
    void = F.col("nth").isNull()
    number = captions.schema["nth"].dataType
    fine = captions.where((F.col("from") <= F.col("to")) & (F.col("start") < F.col("end"))).groupBy(key, "from", "to", "start", "end").agg(F.min("nth").alias("nth"))
    dealt = fine.select(key, "start", "end", "nth", F.explode(F.sequence("from", "to")).alias("word")).groupBy(key, "word", "start", "end").agg(F.min("nth").alias("nth"))
    # a null would turn whole numbers into doubles on their way to Python
    opens = dealt.select(key, "word", F.col("start").alias("at"), F.lit(0).alias("kind"), "end", void.alias("void"), F.coalesce("nth", F.lit(0)).cast(number).alias("nth"))
    asked = marks.select(key, "word", F.col("middle").alias("at")).where(F.col(key).isNotNull() & F.col("word").isNotNull() & F.col("at").isNotNull()).distinct()
    asks = asked.select(key, "word", "at", F.lit(1).alias("kind"), F.col("at").alias("end"), F.lit(False).alias("void"), F.lit(0).cast(number).alias("nth"))
    line = opens.unionByName(asks)
    kinds = {f.name: f.dataType.simpleString() for f in line.schema}
    schema = f"`{key}` {kinds[key]}, word {kinds['word']}, at {kinds['at']}, void boolean, nth {kinds['nth']}"
    found = ordered_fold(line, [key, "word"], ["at", "kind"], _first_open, schema)
    same = [F.col(f"m.{c}") == F.col(f"f.{d}") for c, d in ((key, key), ("word", "word"), ("middle", "at"))]
    held = marks.alias("m").join(found.alias("f"), same).select(f"m.{key}", "m.id", F.when(~F.col("f.void"), F.col("f.nth")).alias("nth"))
    return held.groupBy(key, "id").agg(F.min("nth").alias("nth"))


def _first_open(_: tuple):
    """The fold of carried_marks over rows (key, word, at, kind, end, void, nth): kind 0 opens a caption, 1 asks for the first open one."""
    ends: list = []  # of the open captions that no other outlasts under a lower number, by their end
    numbers: list = []  # theirs, which rise with the end

    def step(row: tuple) -> Iterator[tuple]:
        key, word, at, kind, end, void, nth = row
        gone = bisect_right(ends, at)
        del ends[:gone], numbers[:gone]
        if kind == 0:
            place, number = bisect_left(ends, end), (void, nth)
            if place == len(ends) or number < numbers[place]:
                after = place + (place < len(ends) and ends[place] == end)
                while place > 0 and numbers[place - 1] >= number:
                    place -= 1
                ends[place:after], numbers[place:after] = [end], [number]
        elif numbers:
            yield (key, word, at, *numbers[0])

    return step, lambda: iter(())


def restored_keys(said: DataFrame, keys: DataFrame, recording: str, key: str) -> DataFrame:
    """Inner keys that a recording passes over: between its lowest and its highest, none of them said.

    (recording, key, before): the first said key beyond it, where its words are to be put in.
    """
    bounds = said.groupBy(recording).agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    inner = bounds.select(recording, F.explode(F.sequence("_a", "_b")).alias(key)).join(keys.select(key).distinct(), key, "left_semi")
    missing = inner.join(said.select(recording, key).distinct(), [recording, key], "left_anti").withColumn("_missing", F.lit(True))
    line = Window.partitionBy(recording).orderBy(key).rowsBetween(1, Window.unboundedFollowing)
    both = missing.unionByName(said.select(recording, key, F.lit(False).alias("_missing")).distinct())
    return both.withColumn("before", F.min(F.when(~F.col("_missing"), F.col(key))).over(line)).where("_missing").drop("_missing")
