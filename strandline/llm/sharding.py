"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the cell of a row becomes its index on a
Hilbert curve, rows are ordered by it, and the order is cut into runs of equal numbers of rows (the law
`rows`: counts differ by one at most). Neighbours on the curve are neighbours in every dimension, so the
smallest and largest values of a shard prune files on any of them.

Dimensions are (column, kind): `linear` and `log` span the smallest to the largest value, `rank` cuts the
distinct values in their order into equal runs; of these only the 2^BITS first values reach the driver. A null
has code 0, below all values. Equal texts in one cell stand together (checksum of the text, then id). Null texts
have no bytes and checksum 0. Repeated rows each have a slot; an empty table gives an empty result; with fewer rows
than shards some shards are empty. Further columns travel with `assign`; the names of the columns that it
adds (shard, slot) must be free.

No task sees more than its share: the order is range-partitioned, with the row's own number last, so even rows
that are the same throughout are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.positions import positions
from strandline.runtime import materialize

BITS = 5
#: Bytes that a document takes besides its text.
OVERHEAD = 16
DIMENSIONS = (("source", "rank"), ("lang", "rank"), ("size", "log"), ("doc_id", "linear"))


def entries(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, size and text_crc32 of every row: all that sharding needs to know."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    return documents.select("doc_id", "source", "lang", size.alias("size"), F.crc32(text).alias("text_crc32"))


def first_values(df: DataFrame, column: str, bits: int) -> list:
    """The first value of each of 2^bits - 1 equal runs of the distinct values, in order."""
    values = materialize(df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), "distinct-values")
    many = values.count()
    if not many:
        return []
    top = (1 << bits) - 1
    run = F.floor(F.col("place") * top / F.lit(many)) if many > top else F.col("place")
    return sorted(r["value"] for r in positions(values, ["value"]).groupBy(run.alias("run")).agg(F.min("value").alias("value")).collect())


def _rank(value: Column, firsts: list, top: int) -> Column:
    """The run that a value is in, spread over the codes from 1 to `top`, so few values use the high bits too."""
    if not firsts:
        return F.lit(0)
    run = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x <= value)) - 1
    return F.floor(run * top / len(firsts)) + 1


def codes(df: DataFrame, dimensions: tuple[tuple[str, str], ...] = DIMENSIONS, bits: int = BITS) -> list[Column]:
    """A number from 0 to 2^bits - 1 for each dimension; 0 is null."""
    spanned = [c for c, kind in dimensions if kind != "rank"]
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(spanned) for n, f in (("lo", F.min), ("hi", F.max)))).first() if spanned else None
    top, out = (1 << bits) - 1, []
    for column, kind in dimensions:
        if kind == "rank":
            code = _rank(F.col(column), first_values(df, column, bits), top)
        else:
            lo, hi = (ends[f"{n}_{spanned.index(column)}"] for n in ("lo", "hi"))
            if lo is None:
                out.append(F.lit(0))
                continue
            steps = F.col(column).cast("double") - F.lit(lo)
            share = steps / F.lit((hi - lo) or 1.0) if kind == "linear" else F.ln(steps + 1) / F.ln(F.lit(((hi - lo) or 1.0) + 1))
            code = F.least(F.floor(share * top), F.lit(top - 1)) + 1
        out.append(F.when(F.col(column).isNull(), 0).otherwise(code.cast("int")))
    return out


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a cell, whose coordinates have `bits` bits each.

    The usual way: from the highest bit down a coordinate's bit decides whether the lower bits of the first
    coordinate are inverted or exchanged with its own; then the Gray code is undone and bits are interleaved.
    Coordinates stand in an array that the steps are folded over, and each intermediate value has a name, so
    nothing is computed twice.
    """
    n = len(axes)
    high = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q in high for i in range(n))) if high else None

    def turn(x: Column, step: Column) -> Column:
        q, i, own = step["q"], step["i"], F.get(x, step["i"])
        inverts = own.bitwiseAND(q) != 0
        change = F.when(inverts, q - 1).otherwise(F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(q - 1))
        swaps = F.when(inverts, F.lit(-1)).otherwise(i)
        apply = lambda c: F.array(F.get(x, F.lit(0)).bitwiseXOR(c["t"]), *(F.get(x, F.lit(k)).bitwiseXOR(F.when(c["at"] == k, c["t"]).otherwise(0)) for k in range(1, n)))
        return _named(F.struct(change.alias("t"), swaps.alias("at")), apply)

    def gray(x: Column) -> Column:
        out = [F.get(x, F.lit(0))]
        for k in range(1, n):
            out.append(out[-1].bitwiseXOR(F.get(x, F.lit(k))))
        return F.array(*out)

    def flip(g: Column) -> Column:
        out = F.lit(0)
        for q in high:
            out = out.bitwiseXOR(F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, q - 1).otherwise(0))
        return out

    def interleaved(g: Column, t: Column) -> Column:
        out = F.lit(0).cast("long")
        for place, (b, i) in enumerate((b, i) for b in range(bits) for i in range(n - 1, -1, -1)):
            out = out + F.when(F.get(g, F.lit(i)).bitwiseXOR(t).bitwiseAND(1 << b) != 0, F.lit(1 << place).cast("long")).otherwise(0)
        return out

    cell = F.array(*(a.cast("int") for a in axes))
    turned = F.aggregate(steps, cell, turn) if high else cell
    return _named(turned, lambda x: _named(gray(x), lambda g: _named(flip(g), lambda t: interleaved(g, t))))


def assign(df: DataFrame, dimensions: tuple[tuple[str, str], ...] = DIMENSIONS, shards: int = 40, ties: tuple[str, ...] = ("text_crc32", "doc_id"), bits: int = BITS) -> DataFrame:
    """df, which should be a written table, with curve, shard and slot; all its columns travel along."""
    ordered = df.withColumn("curve", hilbert_index(codes(df, dimensions, bits), bits)).withColumn("nth", F.monotonically_increasing_id())
    placed = positions(ordered, ["curve", *ties, "nth"])
    many = df.count()
    shard = F.expr(f"place * {shards} div {max(many, 1)}")
    cut = placed.withColumn("shard", shard.cast("int"))
    return cut.withColumn("slot", F.col("place") - F.expr(f"(cast(shard as bigint) * {many} + {shards - 1}) div {shards}")).drop("nth", "place")


def shard_rows(documents: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row."""
    known = materialize(entries(documents), "shard-entries")
    return assign(known, shards=shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(assigned: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Write a folder for each shard, rows in the order of their slots, in files of so many rows at most.

    Tasks take ranges of slots, so a shard of any size is written by many tasks.
    """
    ordered = assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def zone_map(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """shard, n_rows and the smallest and largest value of each column in it: what a reader prunes by."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)


def pruned_share(zones: DataFrame, wanted: Column) -> float:
    """The share of shards that a condition on the zone map's columns leaves unread."""
    kept, everything = zones.agg(F.count_if(wanted), F.count("*")).first()
    return 1 - kept / everything if everything else 0.0



def _oracle(shards: int = 40, bits: int = BITS) -> str:
    """DuckDB SQL of shard_rows(): the checksum from its polynomial, the curve index by folds over lists."""
    top, n = (1 << bits) - 1, len(DIMENSIONS)
    rank = lambda c: f"(SELECT {c}, (row_number() OVER (ORDER BY {c}) - 1) * {top} // count(*) OVER () + 1 AS code FROM (SELECT DISTINCT {c} FROM e WHERE {c} IS NOT NULL)) {c}s"
    spans = {c: f"({c}::DOUBLE - min({c}) OVER ())" for c in ("size", "doc_id")}
    widths = {c: f"coalesce(nullif(max({c}) OVER () - min({c}) OVER (), 0), 1)" for c in spans}
    shares = {"size": f"ln({spans['size']} + 1) / ln({widths['size']} + 1.0)", "doc_id": f"{spans['doc_id']} / {widths['doc_id']}"}
    code = {c: f"CASE WHEN {c} IS NULL THEN 0 ELSE least(floor({share} * {top}), {top - 1})::BIGINT + 1 END" for c, share in shares.items()}
    steps = [[1 << b, i] for b in range(bits - 1, 0, -1) for i in range(1, n + 1)]
    t = "CASE WHEN x[s[2]] & s[1] <> 0 THEN s[1] - 1 ELSE xor(x[1], x[s[2]]) & (s[1] - 1) END"
    turned = [f"xor(x[1], {t})", *(f"CASE WHEN s[2] = {i} AND x[{i}] & s[1] = 0 THEN xor(x[{i}], {t}) ELSE x[{i}] END" for i in range(2, n + 1))]
    flip = "list_reduce([{}], lambda t, q: CASE WHEN g[{}] & q <> 0 THEN xor(t, q - 1) ELSE t END, 0::BIGINT)".format(", ".join(f"{1 << b}::BIGINT" for b in range(bits - 1, 0, -1)), n)
    gray = ["x[1]"]
    for i in range(2, n + 1):
        gray.append(f"xor(x[{i}], {gray[-1]})")
    places = [(b, i) for b in range(bits) for i in range(n, 0, -1)]
    index = " + ".join(f"(((xor(g[{i}], f) >> {b}) & 1) << {k})" for k, (b, i) in enumerate(places))
    return f"""
WITH bytes AS (SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, v) ORDER BY v) AS t FROM range(256) r(v)),
e AS (SELECT doc_id, source, lang, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
  xor(list_reduce([CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')], lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32 FROM documents, bytes),
c AS (SELECT e.*, [coalesce(sources.code, 0), coalesce(langs.code, 0), {code['size']}, {code['doc_id']}]::BIGINT[] AS x FROM e LEFT JOIN {rank('source')} USING (source) LEFT JOIN {rank('lang')} USING (lang)),
h AS (SELECT doc_id, size, text_crc32, list_reduce({steps}::BIGINT[][], lambda x, s: [{', '.join(turned)}], x) AS x FROM c),
g AS (SELECT doc_id, size, text_crc32, [{', '.join(gray)}] AS g FROM h),
i AS (SELECT doc_id, size, text_crc32, {index} AS curve FROM (SELECT *, {flip} AS f FROM g)),
p AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS many FROM i)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * {shards} // many AS INTEGER) AS shard, place - ((place * {shards} // many) * many + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve FROM p
"""


ORACLE = _oracle()
