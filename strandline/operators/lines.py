"""Rules over ordered lines of a key: neighbours, peaks, paths, edited spans and small readings of values, with parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import dealt


def _over(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


# neighbours -------------------------------------------------------------------------------


def with_neighbour(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], by: int, prefix: str) -> DataFrame:
    """rows with columns of the line `by` places on (before, if negative), named with the prefix."""
    over = _over(keys, order)
    return rows.withColumns({f"{prefix}{c}": F.lead(c, by).over(over) if by > 0 else F.lag(c, -by).over(over) for c in columns})


def twins(rows: DataFrame, keys: Sequence[str], place: str, alike: Sequence[str], apart: int) -> DataFrame:
    """Pairs (keys, place, twin) of lines of a key that are alike and stand exactly so far apart: an equi join on the place."""
    on = [*keys, *alike, place]
    other = rows.select(*keys, *alike, (F.col(place) - apart).alias(place), F.col(place).alias("twin"))
    return rows.select(*on).join(other, on).select(*keys, place, "twin")


def equal_stretches(rows: DataFrame, keys: Sequence[str], place: str, value: str) -> DataFrame:
    """(keys, value, a, b): stretches of consecutive places with one value; a place that is repeated starts a new one."""
    return _stretches(dealt(rows.select(*keys, place, value), keys), keys, place, value)


def _stretches(rows: DataFrame, keys: Sequence[str], place: str, value: str) -> DataFrame:
    over = Window.partitionBy(*keys, value).orderBy(place)
    marked = rows.withColumn("_grp", F.col(place) - F.row_number().over(over))
    return marked.groupBy(*keys, value, "_grp").agg(F.min(place).alias("a"), F.max(place).alias("b")).drop("_grp")


def first_of(rows: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """(keys, columns) of the first row of each key that counts, by partial sums."""
    fine = rows if where is None else rows.where(where)
    return fine.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_f")).select(*keys, *(F.col(f"_f.{c}").alias(c) for c in columns))


def swapped_turns(turns: DataFrame, keys: Sequence[str], order: str, role: str, first: str) -> DataFrame:
    """turns with `swapped`: a turn of the first role takes the next one's role, any other the one before; edges keep theirs."""
    over = _over(keys, [order])
    return turns.withColumn("swapped", F.when(F.col(role) == first, F.coalesce(F.lead(role).over(over), role)).otherwise(F.coalesce(F.lag(role).over(over), role)))


# peaks and levels -------------------------------------------------------------------------


def peaks(rows: DataFrame, keys: Sequence[str], at: str, value: str, width: int) -> DataFrame:
    """(keys, bucket, peak, n): the largest absolute value in each bucket of time."""
    return rows.groupBy(*keys, F.floor(F.col(at) / width).alias("bucket")).agg(F.max(F.abs(value)).alias("peak"), F.count("*").alias("n"))


def wider_peaks(peaked: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Peaks of `factor` buckets made one, from the peaks alone."""
    return peaked.groupBy(*keys, F.floor(F.col("bucket") / factor).alias("bucket")).agg(F.max("peak").alias("peak"), F.sum("n").alias("n"))


def hop_energy(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, hop: int) -> DataFrame:
    """(keys, hop, energy) of each full hop of so many lines."""
    placed = rows.withColumn("_place", F.row_number().over(_over(keys, order)) - 1)
    sums = placed.groupBy(*keys, F.floor(F.col("_place") / hop).alias("hop")).agg(F.sum(F.col(value) * F.col(value)).alias("energy"), F.count("*").alias("_n"))
    return sums.where(F.col("_n") == hop).drop("_n")


def cut_before(rows: DataFrame, keys: Sequence[str], at: str, cut: str) -> DataFrame:
    """rows with `mapped`: their time less all cuts of the key that begin earlier."""
    before = F.sum(cut).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("mapped", F.col(at) - F.coalesce(before, F.lit(0)))


def forward_clamp(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int) -> DataFrame:
    """rows with start_v, which never goes back, and end_v, `length` on or at the next start."""
    over = _over(keys, order)
    started = rows.withColumn("start_v", F.max(value).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return started.withColumn("end_v", F.least(F.col("start_v") + length, F.lead("start_v").over(over)))


# paths ------------------------------------------------------------------------------------


def least_frames(rows: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str) -> DataFrame:
    """(keys, frames): frames that a path of these symbols needs, one more between two that are the same."""
    doubled = F.col(symbol) == F.lag(symbol).over(_over(keys, order))
    return rows.withColumn("_doubled", doubled).groupBy(*keys).agg((F.count("*") + F.count_if("_doubled")).alias("frames"))


def path_spans(rows: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str, blank: str) -> DataFrame:
    """(keys, symbol, a, b): runs of one symbol along a path, from frame a to before b; blanks are none."""
    placed = dealt(rows, keys).withColumn("_i", F.row_number().over(_over(keys, order)))
    return _stretches(placed.select(*keys, symbol, "_i"), keys, "_i", symbol).where(F.col(symbol) != blank).withColumn("b", F.col("b") + 1)


def collapsed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], symbol: str, blank: str) -> DataFrame:
    """(keys, i, symbol): a path without blanks and repeats, each symbol at the frame where it begins."""
    spans = path_spans(rows, keys, order, symbol, blank)
    return spans.select(*keys, F.col("a").alias("i"), symbol)


# edited spans -----------------------------------------------------------------------------


def split_at(spans: DataFrame, start: str, end: str, at: int) -> DataFrame:
    """spans with part, a and b: a span that the time lies inside is two."""
    inside = (F.col(start) < at) & (F.col(end) > at)
    whole = F.struct(F.lit(0).alias("part"), F.col(start).alias("a"), F.when(inside, F.lit(at)).otherwise(F.col(end)).alias("b"))
    rest = F.struct(F.lit(1).alias("part"), F.lit(at).alias("a"), F.col(end).alias("b"))
    return spans.withColumn("_p", F.explode(F.array_compact(F.array(whole, F.when(inside, rest))))).select(*spans.columns, "_p.*")


def retimed(spans: DataFrame, start: str, end: str, origin: int, rate: tuple[int, int], least: int) -> DataFrame:
    """spans with a and b, their times at another rate from an origin; shorter ones than `least` go."""
    times, by = rate
    at = lambda c: F.floor((F.col(c) - origin) * times / by).cast("long")
    return spans.withColumns({"a": at(start), "b": at(end)}).where(F.col("b") - F.col("a") >= least)


def seams(rows: DataFrame, keys: Sequence[str], order: Sequence[str], place: str, least: int = 1) -> DataFrame:
    """(keys, a, b): places left out between two lines that stand more than `least` apart."""
    met = with_neighbour(rows, keys, order, [place], 1, "_next_")
    return met.where(F.col(f"_next_{place}") - F.col(place) > least).select(*keys, (F.col(place) + 1).alias("a"), F.col(f"_next_{place}").alias("b"))


# values -----------------------------------------------------------------------------------


def byte_range(header: Column, size: Column) -> Column:
    """satisfiable, a and z of a header `bytes=first-last`, the last byte of the file where it names none or one
    beyond; nulls for a header of another form."""
    fine = header.rlike(r"^bytes=\d+-\d*$")
    named = [F.when(fine, F.regexp_extract(header, r"^bytes=(\d+)-(\d*)$", i)) for i in (1, 2)]
    first = named[0].cast("long")
    last = F.when(fine, F.least(size - 1, F.when(named[1] == "", size - 1).otherwise(named[1].try_cast("long"))))
    return F.struct((first < size).alias("satisfiable"), first.alias("a"), last.alias("z"))


def numbered_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with `unique`: the first of a name keeps it, others carry their number."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("unique", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def digits(text: Column, signs: str) -> Column:
    """A text with its digits written as the ten given signs."""
    return F.translate(text, "0123456789", signs)


def suffixed(path: Column, suffix: str) -> Column:
    """A path with a suffix in place of its extension, or behind it where there is none."""
    bare = F.regexp_extract(path, r"^(.*)[.][a-z]+$", 1)
    return F.concat(F.when(path.rlike(r"[.][a-z]+$"), bare).otherwise(path), F.lit(suffix))


def kind_of(path: Column, kinds: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """The kind whose extensions a path ends with."""
    out = F.lit(otherwise)
    for kind, endings in reversed(kinds.items()):
        out = F.when(F.substring_index(path, ".", -1).isin(*endings) & path.contains("."), kind).otherwise(out)
    return out


def tenths_code(tenths: Column) -> Column:
    """m:ss.t of a number of tenths of a second."""
    return F.format_string("%d:%02d.%d", F.floor(tenths / 600).cast("long"), F.floor(F.pmod(tenths, F.lit(600)) / 10).cast("long"), F.pmod(tenths, F.lit(10)).cast("long"))


def chunk_plan(size: Column, chunk: int) -> Column:
    """chunks, last_from and last_to of a file read in chunks, where a remainder belongs to the last one."""
    chunks = F.greatest(F.floor(size / chunk).cast("long"), F.lit(1))
    return F.struct(chunks.alias("chunks"), ((chunks - 1) * chunk).alias("last_from"), size.alias("last_to"))
