"""Queries of the formats and checks, on orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import formats
from strandline.plans.record_queries import customers, order_lines, known_entries, order_rows

PRESETS = [("first", {"tone": "FURNITURE", "size": "11"}), ("second", {"tone": "FURNITURE"}), ("third", {"edge": "1", "size": "12"}), ("plain", {"size": "13"})]


def _choice(key: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


CODES = ("3:31.7", "3:31", "1:02:05.4", "211.7", "3:", "", ".5", "1:2:3:4", " 7:08 ", "x:1", "5.", "-1:02", "1..2")


def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed times of many forms, and those that are none."""
    code = F.when(F.col("o") % 3 == 0, _choice(F.col("o"), CODES)).otherwise(F.concat_ws(":", F.col("c"), F.col("o") % 77, F.col("c") % 60))
    return order_rows(spark, sf_dir).select("o", F.floor(formats.parsed_timecode(code) * 10 + 0.5).cast("long").alias("tenths"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rows(spark, sf_dir).select("o", formats.formatted_duration(F.floor(F.col("x") / 300)).alias("duration"), formats.formatted_tick(F.floor(F.col("x") / 3000) - 100).alias("tick"))


def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = _choice(F.col("c"), (9, 16, 1, 4)), _choice(F.col("c"), (16, 9, 1, 5))
    sized = order_rows(spark, sf_dir).withColumn("z", formats.even_size(F.lit(200) + F.col("o") % 3641, wide, high))
    return sized.select("o", "z.width", "z.height", formats.bitrate(F.col("z.width"), F.col("z.height"), F.col("o") % 2 * 30 + 30, 9).alias("bits"))


def output_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = _choice(F.col("c"), (9, 16, 1, 4)), _choice(F.col("c"), (16, 9, 1, 5))
    plan = formats.output_plan(wide, high, _choice(F.col("o"), ("max", "high", "standard")), F.col("o") % 2 * 30 + 30, F.col("x") % 900 + 1)
    return order_rows(spark, sf_dir).withColumn("p", plan).select("o", "p.*")


def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = F.when(F.col("o") % 11 == 0, None).otherwise(F.col("x") / 700 - 1000)
    ratio = _choice(F.col("o"), ("9:16", "16:9", "1x1", "123:4", "4:5"))
    counted = order_rows(spark, sf_dir).withColumn("e", formats.export_count((F.col("c") / 2).cast("double"), duration.cast("double"), ratio))
    return counted.select("o", F.col("e").isNull().alias("refused"), "e.chapter", "e.duration", "e.ratio")


def caption_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against each order, and how many rows of its customer have any."""
    found = F.array_compact(F.array(F.when(F.col("o") % 3 == 0, "stop_mark"), F.when(F.col("o") % 5 == 0, "misheard")))
    score = F.when(F.col("o") % 7 > 0, F.col("x") % 100 / 100)
    return order_rows(spark, sf_dir).select("o", F.array_join(formats.caption_checks(found, score, F.when(F.col("c") % 4 > 0, F.col("c") % 4 == 1)), ",").alias("reasons"))


def rows_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caption_reasons(spark, sf_dir).join(order_rows(spark, sf_dir).select("o", "c"), "o").groupBy("c").agg(F.count_if(F.col("reasons") != "").alias("n"))


def preset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = known_entries(tone=F.col("segment"), size=F.col("c") % 4 + 10, edge=F.when(F.col("c") % 3 == 0, F.col("n") % 3))
    return customers(spark, sf_dir).select("c", formats.matching_preset(config, PRESETS).alias("preset"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("c") % 6 == 0, F.concat(F.lit("ـ-trimmed-trimmed."), F.col("segment"))).when(F.col("c") % 6 == 1, "").when(F.col("c") % 6 == 2, None).otherwise(F.concat(F.col("name"), F.lit(" (a) 😭."), F.col("segment")))
    base = formats.safe_base_name(given, F.substring(F.md5(F.coalesce(given, F.lit(""))), 1, 6))
    named = formats.export_name(F.when(F.col("c") % 5 == 0, " ?: ").otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(" <x>"))), F.col("n"), F.col("c") % 9, F.col("c") % 9 + 3, "mp4")
    return customers(spark, sf_dir).select("c", base.alias("base"), named.alias("named"))


def api_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(_choice(F.col("c"), ("https://api.example.org/content/v4", "/content/v4", "http://api.example.org/content/v4", "/other", "https://apiXexample.org/content/v4")), F.when(F.col("c") % 7 > 0, F.concat(F.lit("/"), F.col("name"))).otherwise(""))
    return customers(spark, sf_dir).select("c", formats.api_path(url, "api.example.org", "/content/v4").alias("path"))


def numbered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of texts, of which some are short and some are no numbers."""
    text = lambda c: c.cast("string")
    segment = lambda r: F.when(r["k"] % 4 == 3, F.array(text(r["k"]), text(r["p"]))).otherwise(F.array(F.lit("w"), text(r["k"]), F.when(r["p"] % 5 == 0, F.lit("none")).otherwise(text(r["p"])), text(r["p"] + 7)))
    found = order_lines(spark, sf_dir).select("o", F.explode(formats.numeric_segments(F.transform("rows", segment))).alias("s"))
    return found.select("o", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("number", "start", "end")])


def synced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.transform("rows", lambda r: F.struct(F.when(r["p"] % 3 > 0, r["excluded"]).alias("excluded"), F.when(r["x"] % 2 == 0, r["x"]).alias("time")))
    current = F.transform(F.slice("rows", 1, F.greatest(F.lit(1), F.size("rows") - F.when(F.col("o") % 2 == 0, 0).otherwise(1)).cast("int")), lambda r: r["p"].cast("string"))
    rows = order_lines(spark, sf_dir).select("o", F.posexplode(formats.synced_words(stored, current)).alias("nth", "w"))
    return rows.select("o", "nth", "w.word", "w.excluded", "w.time")


def length_checks_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = F.when(F.col("o") % 13 > 0, (F.col("x") % 3000) / 1000)
    return order_rows(spark, sf_dir).select("o", formats.length_check(measured.cast("double"), ((F.col("x") % 3000 + F.col("c") % 300 - 150) / 1000).cast("double"), (F.col("o") % 3 * 12 + 6).cast("double")).alias("state"))


def patch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between the lines of an order, as cells of two numbers, and the same ones turned round, one cell short."""
    first = F.transform("rows", lambda r: F.array(r["k"].cast("double"), (r["p"] % 50).cast("double")))
    second = F.slice(F.reverse(first), 1, F.greatest(F.size("rows") - 1, F.lit(1)))
    return order_lines(spark, sf_dir).select("o", F.floor(formats.patch_change(first, second) * 1000 + 0.5).cast("long").alias("thousandths"))


def lane_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line of an order, as a block of its part's length, plays at a time."""
    blocks = F.transform("rows", lambda r: F.struct((r["k"] * 30).alias("start"), (r["k"] * 30 + r["p"] % 90).alias("end"), r["x"].alias("x")))
    block = formats.lane_at(blocks, F.col("o") % 300 - 20)
    return order_lines(spark, sf_dir).withColumn("b", block).select("o", "b.start", "b.x")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _choice(F.col("o"), ("queued", "rendering", "done"))
    return order_rows(spark, sf_dir).select("o", formats.cancelled(state).alias("called_off"), formats.removable(state, F.col("o") % 5, F.lit(2)).alias("leaves"))


QUERIES = {f.__name__: f for f in (
    timecodes, durations, frame_sizes, output_plans, export_counts, caption_reasons, rows_to_check, preset_names, file_names, api_paths, numbered_segments, synced_words, length_checks_by_frame, patch_changes, lane_blocks, job_states,
)}

_O = "o AS (SELECT o_orderkey AS o, o_custkey AS c, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS x FROM orders)"
_C = "k AS (SELECT c_custkey AS c, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS n FROM customer)"
_L = "r AS (SELECT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS x, CASE WHEN l_returnflag = 'A' THEN '  ' ELSE ' ' || l_returnflag || l_suppkey END AS gloss, l_linestatus = 'F' AS excluded FROM lineitem), l AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k, p, x, gloss, excluded) AS nth, count(*) OVER (PARTITION BY o) AS size FROM r)"
_REASONS = "q AS (SELECT o, c, concat_ws(',', CASE WHEN o % 3 = 0 THEN 'stop_mark' END, CASE WHEN o % 7 > 0 AND x % 100 < 50 THEN 'low_match' END, CASE WHEN o % 5 = 0 THEN 'misheard' END) AS all_ FROM o), w AS (SELECT o, c, CASE WHEN c % 4 = 1 THEN '' ELSE all_ END AS reasons FROM q)"
_TENTHS = {"3:31.7": 2117, "3:31": 2110, "1:02:05.4": 37254, "211.7": 2117, ".5": 5, " 7:08 ": 4280, "5.": 50}
_CASES = " ".join(f"WHEN {i} THEN {_TENTHS.get(c, 'NULL')}" for i, c in enumerate(CODES))

ORACLES = {
    "timecodes": f"WITH {_O} SELECT o, CAST(CASE WHEN o % 3 = 0 THEN CASE o % {len(CODES)} {_CASES} END ELSE (c * 3600 + o % 77 * 60 + c % 60) * 10 END AS BIGINT) AS tenths FROM o",
    "durations": f"""WITH {_O}, t AS (SELECT o, CAST(floor(x / 300) AS BIGINT) AS t, greatest(0, CAST(floor(x / 3000) AS BIGINT) - 100) AS s FROM o) SELECT o, CASE WHEN t >= 36000 THEN t // 36000 || ':' || lpad(CAST(t // 600 % 60 AS VARCHAR), 2, '0') ELSE CAST(t // 600 % 60 AS VARCHAR) END || ':' || lpad(CAST(t // 10 % 60 AS VARCHAR), 2, '0') || '.' || t % 10 AS duration,
      CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 % 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS tick FROM t""",
    "frame_sizes": f"""WITH {_O}, e AS (SELECT o, 200 + o % 3641 AS e, CASE c % 4 WHEN 0 THEN 9 WHEN 1 THEN 16 WHEN 2 THEN 1 ELSE 4 END AS w, CASE c % 4 WHEN 0 THEN 16 WHEN 1 THEN 9 WHEN 2 THEN 1 ELSE 5 END AS h FROM o),
      z AS (SELECT o, greatest(2, 2 * CAST(floor((CASE WHEN w >= h THEN e ELSE e * w / h END) / 2 + 0.5) AS BIGINT)) AS width, greatest(2, 2 * CAST(floor((CASE WHEN w >= h THEN e * h / w ELSE e END) / 2 + 0.5) AS BIGINT)) AS height FROM e)
      SELECT o, width, height, CAST(least({formats.MOST_BITRATE}, greatest({formats.LEAST_BITRATE}, floor(width * height * (o % 2 * 30 + 30) * 9 / 100 + 0.5))) AS BIGINT) AS bits FROM z""",
    "output_plans": f"""WITH {_O}, t(rank, tier, edge, hundredths) AS (VALUES (0, 'max', 3840, 8), (1, 'high', 2560, 12), (2, 'standard', 1920, 16)), e AS (SELECT o, c, x % 900 + 1 AS sec, o % 2 * 30 + 30 AS fps, o % 3 AS asked, CASE c % 4 WHEN 0 THEN 9 WHEN 1 THEN 16 WHEN 2 THEN 1 ELSE 4 END AS w, CASE c % 4 WHEN 0 THEN 16 WHEN 1 THEN 9 WHEN 2 THEN 1 ELSE 5 END AS h FROM o),
      z AS (SELECT e.*, t.*, greatest(2, 2 * CAST(floor((CASE WHEN w >= h THEN edge ELSE edge * w / h END) / 2 + 0.5) AS BIGINT)) AS width, greatest(2, 2 * CAST(floor((CASE WHEN w >= h THEN edge * h / w ELSE edge END) / 2 + 0.5) AS BIGINT)) AS height FROM e JOIN t ON t.rank >= asked),
      b AS (SELECT *, CAST(least(60000000, greatest(4000000, floor(width * height * fps * hundredths / 100 + 0.5))) AS BIGINT) AS full_bits FROM z), f AS (SELECT *, floor((full_bits + 128000) * sec / 8 + 0.5) <= 312500000 AS fits FROM b),
      r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY fits DESC, CASE WHEN fits THEN rank ELSE -rank END) AS nth FROM f), g AS (SELECT *, CASE WHEN fits THEN full_bits ELSE greatest(4000000, CAST(floor(2500000000 / sec) AS BIGINT) - 128000) END AS bits FROM r WHERE nth = 1)
      SELECT o, tier, width, height, bits, CAST(floor((bits + 128000) * sec / 8 + 0.5) AS BIGINT) AS bytes, rank > asked AS stepped_down, NOT fits AS reduced, floor((bits + 128000) * sec / 8 + 0.5) > 312500000 AS too_large FROM g""",
    "export_counts": f"""WITH {_O}, d AS (SELECT *, CASE WHEN o % 11 > 0 THEN x / 700 - 1000 END AS d, CASE o % 5 WHEN 0 THEN '9:16' WHEN 1 THEN '16:9' WHEN 4 THEN '4:5' END AS r FROM o), f AS (SELECT *, coalesce(d >= 0 AND d <= 21600 AND r IS NOT NULL, false) AS fine FROM d)
      SELECT o, NOT fine AS refused, CASE WHEN fine AND c % 2 = 0 AND c // 2 BETWEEN 1 AND 114 THEN c // 2 END AS chapter, CASE WHEN fine THEN CAST(floor(d + 0.5) AS BIGINT) END AS duration, CASE WHEN fine THEN r END AS ratio FROM f""",
    "caption_reasons": f"WITH {_O}, {_REASONS} SELECT o, reasons FROM w",
    "rows_to_check": f"WITH {_O}, {_REASONS} SELECT c, count(CASE WHEN reasons <> '' THEN 1 END) AS n FROM w GROUP BY c",
    "preset_names": f"WITH {_C} SELECT c, CASE WHEN segment = 'FURNITURE' AND c % 4 = 1 THEN 'first' WHEN segment = 'FURNITURE' THEN 'second' WHEN c % 3 = 0 AND n % 3 = 1 AND c % 4 = 2 THEN 'third' WHEN c % 4 = 3 THEN 'plain' END AS preset FROM k",
    "file_names": f"""WITH {_C} SELECT c, CASE WHEN c % 6 = 0 THEN '_-trimmed-trimmed-' || left(md5('ـ-trimmed-trimmed.' || segment), 6) WHEN c % 6 < 3 THEN 'timeline' ELSE replace(name, '#', '_') || '_a_' END AS base,
      CASE WHEN c % 5 = 0 THEN 'clip' ELSE name || '_x' END || '_' || n || '_' || c % 9 || '-' || (c % 9 + 3) || '.mp4' AS named FROM k""",
    "api_paths": f"WITH {_C} SELECT c, CASE WHEN c % 5 < 2 AND c % 7 > 0 THEN '/' || name END AS path FROM k",
    "numbered_segments": f"""WITH {_L} SELECT o, CAST(k AS BIGINT) AS number, p AS start, p + 7 AS "end" FROM l WHERE k % 4 <> 3 AND p % 5 <> 0""",
    "synced_words": f"WITH {_L} SELECT o, nth - 1 AS nth, CAST(p AS VARCHAR) AS word, CASE WHEN o % 2 = 0 OR size = 1 THEN p % 3 > 0 AND excluded ELSE false END AS excluded, CASE WHEN (o % 2 = 0 OR size = 1) AND x % 2 = 0 THEN x END AS time FROM l WHERE o % 2 = 0 OR size = 1 OR nth < size",
    "length_checks_by_frame": f"WITH {_O} SELECT o, CASE WHEN o % 13 = 0 OR x % 3000 = 0 THEN 'unsure' WHEN abs((x % 3000)::DOUBLE / 1000 - (x % 3000 + c % 300 - 150)::DOUBLE / 1000) <= greatest(2.0::DOUBLE / (o % 3 * 12 + 6), 0.1) THEN 'ok' ELSE 'problem' END AS state FROM o",
    "patch_changes": f"""WITH {_L}, m AS (SELECT a.o, a.size, abs(a.k - coalesce(b.k, a.k)) + abs(a.p % 50 - coalesce(b.p % 50, a.p % 50)) AS d FROM l a LEFT JOIN l b ON b.o = a.o AND b.nth = a.size + 1 - a.nth AND a.nth <= greatest(a.size - 1, 1)) SELECT o, CAST(floor(sum(d) / (2 * count(*)) * 1000 + 0.5) AS BIGINT) AS thousandths FROM m GROUP BY o""",
    "lane_blocks": f"WITH {_L}, h AS (SELECT o, k * 30 AS start, x, row_number() OVER (PARTITION BY o ORDER BY nth DESC) AS last FROM l WHERE greatest(o % 300 - 20, 0) >= k * 30 AND greatest(o % 300 - 20, 0) < k * 30 + p % 90) SELECT q.o, start, x FROM (SELECT DISTINCT o FROM l) q LEFT JOIN h ON h.o = q.o AND last = 1",
    "job_states": f"WITH {_O} SELECT o, CASE WHEN o % 3 = 2 THEN 'done' ELSE 'cancelled' END AS called_off, o % 5 = 2 AND o % 3 <> 1 AS leaves FROM o",
}
