"""Queries of the rules on records and of the stored texts, on customers, orders and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import records
from strandline.operators import sync
from strandline.operators.intervals import micros
from strandline.runtime import ship_package, table

EARLIEST, LATEST = 1_577_836_800_000, 1_700_000_000_000


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("x"), micros("o_orderdate").alias("d"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("n"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, rows): the lines of each order in order, with a gloss that may be blank."""
    gloss = F.when(F.col("l_returnflag") == "A", "  ").otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.col("l_suppkey").cast("string")))
    line = F.struct(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("x"), gloss.alias("gloss"), (F.col("l_linestatus") == "F").alias("excluded"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("rows"))


def _bits(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda f: f.cast("int").cast("string")), "")


def _pairs(entries: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(entries), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


def parsed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("o") % 3 == 0, F.concat_ws(":", "c", F.col("o") % 10)).when(F.col("o") % 3 == 1, F.concat(F.lit("x"), F.col("o")))
    chapter = F.when(F.col("c") % 5 > 0, F.col("c"))
    return order_rows(spark, sf_dir).select("o", records.parsed_key(given, chapter, F.col("o") % 4).alias("key"))


def opening_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*map(F.lit, ("istiadha", "basmala", "1:1", "Basmala"))), (F.col("o") % 4 + 1).cast("int"))
    return order_rows(spark, sf_dir).select("o", records.is_opening(F.when(F.col("c") % 7 > 0, key)).alias("opening"))


def sane_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    artist = F.when(F.col("c") % 3 == 0, "  ").when(F.col("c") % 3 == 1, F.concat(F.lit("  "), F.col("name"), F.lit(" ")))
    title = F.when(F.col("c") % 4 == 1, F.repeat("segment", 3))
    tags = records.sane_tags({"artist": artist, "title": title}, F.col("c") * 37 % 1300 - 50, 20)
    return customers(spark, sf_dir).withColumn("t", tags).select("c", F.col("t").isNull().alias("nothing"), "t.artist", "t.title", "t.track")


def sane_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o") * 37 % 5000 - 200
    clip = F.struct(F.when(F.col("o") % 6 == 0, "").when(F.col("o") % 6 == 1, None).otherwise(F.col("p")).alias("id"), start.alias("start"), (start + F.col("x") % 3000).alias("end"))
    listed = order_rows(spark, sf_dir).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("o", clip.alias("clip")))).alias("l"))
    clean = listed.select("c", F.posexplode(records.sane_clips(F.transform("l", lambda e: e["clip"]), 8)).alias("nth", "k"))
    return clean.select("c", "nth", "k.id", "k.start", "k.end")


def payload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = records.sane_payload(F.when(F.col("o") % 9 > 0, F.col("o") % 5), F.col("c") % 50, F.when(F.col("o") % 8 > 0, F.col("c") % 50 + F.col("o") % 30 - 5), 20)
    return order_rows(spark, sf_dir).select("o", fault.alias("fault"))


def known_entries(**entries: Column) -> Column:
    """A map of the entries that are not null."""
    return F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def _base() -> Column:
    return known_entries(font=F.lit("plain"), size=F.lit("12"), tone=F.col("segment"))


def _own() -> Column:
    return known_entries(size=F.when(F.col("c") % 2 == 0, F.col("c") % 3 + 11), tone=F.when(F.col("c") % 3 == 0, F.col("segment")), edge=F.when(F.col("c") % 5 == 0, F.col("n")))


def overlaid_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("c") % 7 > 0, _own())
    return customers(spark, sf_dir).select("c", _pairs(records.overlaid(_base(), own)).alias("style"))


def changed_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c", _pairs(records.changed_entries(_own(), _base())).alias("style"))


def remaining_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.array(F.lit("size"), F.when(F.col("c") % 2 == 1, "tone").otherwise("none"))
    return customers(spark, sf_dir).select("c", _pairs(records.without_keys(_own(), removed)).alias("style"))


def toggled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = order_rows(spark, sf_dir).groupBy("c").agg(F.sort_array(F.collect_set("p")).alias("ids"))
    chosen = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "9-NEW"))), (F.col("c") % 3 + 1).cast("int"))
    return listed.select("c", F.array_join(records.toggled(F.col("ids"), chosen, 4), ",").alias("ids"))


def all_lines_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select("o", records.all_hold(F.col("rows"), lambda r: (r["x"] > 1_000_000) & (r["p"] > 20)).alias("every"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, a, b): the lines of an order by the parity of their part."""
    return order_lines(spark, sf_dir).select("o", F.filter("rows", lambda r: r["p"] % 2 == 0).alias("a"), F.filter("rows", lambda r: r["p"] % 2 == 1).alias("b"))


def filled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.transform("a", lambda r: F.when(r["x"] % 3 > 0, r["k"])), F.transform("b", lambda r: r["k"] + 10)
    filled = records.filled_by_position(a, b)
    return _halves(spark, sf_dir).select("o", F.array_join(F.transform(filled, lambda k: F.coalesce(k.cast("string"), F.lit("-"))), ",").alias("filled"))


def hidden_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).select("o", _bits(records.hidden_by_both(F.transform("a", lambda r: r["excluded"]), F.transform("b", lambda r: r["excluded"]))).alias("hidden"))


def gloss_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select("o", records.gloss_line(F.col("rows")).alias("line"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three titles of at most 24 characters, and how a stored passage is named."""
    title, cut = records.first_fitting([F.concat_ws(" | ", "name", "segment", F.repeat("segment", (F.col("c") % 2).cast("int"))), F.concat_ws(" | ", "name", F.repeat("segment", (F.col("c") % 3).cast("int")))], 24)
    stored = F.format_string("%s (%d:%d-%d) Clip", "name", "n", F.col("c") % 9 + 1, F.col("c") % 9 + 4)
    return customers(spark, sf_dir).select("c", title.alias("title"), cut.alias("cut"), stored.alias("stored"))


def preferred_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("c") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("c") % 3 == 1, F.array(F.lit("b"), F.lit("d"), F.lit("a"))).otherwise(F.array(F.lit("e")))
    carried = known_entries(a=F.when(F.col("c") % 2 == 0, F.concat(F.lit("A"), "c")), b=F.when(F.col("c") % 5 == 0, F.lit("")).when(F.col("c") % 5 == 1, F.concat(F.lit("B"), "c")), d=F.when(F.col("c") % 7 == 0, F.lit("D")))
    local = known_entries(a=F.when(F.col("c") % 4 == 1, F.lit("own a")), b=F.when(F.col("c") % 4 == 3, F.lit("own b")))
    return customers(spark, sf_dir).select("c", records.preferred_text(wanted, carried, local).alias("text"))


def clamped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.transform("rows", lambda r: F.struct(r["k"].alias("number"), (r["p"] * 40).alias("start"), (r["p"] * 40 + r["x"] % 900).alias("end")))
    cut = order_lines(spark, sf_dir).select("o", F.explode(records.clamped_segments(segments, F.col("o") % 3000, F.lit(4000))).alias("s"))
    return cut.select("o", "s.number", "s.start", "s.end")


def reference_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), "c", F.lit(":1\t"), F.translate("name", "#", " "), F.lit(" \nno tab here\n"), "n", F.lit(":2 \t  "), "segment", F.lit("  x"))
    words = customers(spark, sf_dir).select("c", F.explode(records.reference_words(text)).alias("w"))
    return words.select("c", "w.key", F.col("w.place").cast("long").alias("place"), "w.word")


def clip_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = F.concat(F.when(F.col("c") % 11 > 0, "clip-k").otherwise("clip_k"), F.lpad((F.col("c") * 7919 % 9_999_991).cast("string"), 7, "7"), F.lit("-"), F.col("n"))
    return customers(spark, sf_dir).select("c", records.made_at(clip, EARLIEST, LATEST).alias("made_at"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.transform("rows", lambda r: F.struct((r["k"] * 1000).alias("start"), (r["k"] * 1000 + r["p"]).alias("end"), r["excluded"].alias("auto")))
    return order_lines(spark, sf_dir).withColumn("text", records.encoded_edit(cuts, 100 + F.col("o") % 26, F.col("o") % 2 == 0, F.col("o") % 3 == 0))


def encoded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edits(spark, sf_dir).select("o", "text")


def decoded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits read back, those of every fifth order broken before."""
    given = F.when(F.col("o") % 5 == 0, F.concat(F.lit("*"), "text")).otherwise(F.col("text"))
    read = _edits(spark, sf_dir).withColumn("e", records.decoded_edit(given))
    return read.select("o", F.size("e.c").alias("cuts"), F.aggregate("e.c", F.lit(0.0), lambda s, c: s + c[1] - c[0]).cast("long").alias("removed"), F.col("e.t").cast("long").alias("tempo"), "e.l", "e.d")


def edit_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("c") % 4 == 3, "/api/audio/other?edit=zz").when(F.col("c") % 4 == 2, F.concat(F.lit("/api/audio/edited?edit=e"), "c")).otherwise(F.concat(F.lit("/api/audio/edited?reciter="), "n", F.lit("&edit=e"), "c", F.lit("&ayah=3")))
    return customers(spark, sf_dir).select("c", records.edited_source(path).alias("source"), records.edit_of(path).alias("edit"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c") % 3 == 0, F.concat(F.lit('```json\n{"n": '), "n", F.lit(', }\n```'))).when(F.col("c") % 3 == 1, F.concat(F.lit('Here: {"n": ['), "n", F.lit(',  ]} as asked'))).otherwise(F.concat(F.lit('{"n": '), "n", F.lit("}")))
    return customers(spark, sf_dir).select("c", records.answer_json(text).alias("json"))


# stored texts ------------------------------------------------------------------------------


def texts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.when(F.col("o") % 6 == 0, " <i></i>").otherwise(F.concat(F.lit("<b>"), "p", F.lit("</b><sup>1</sup> , "), "o"))
    rows = order_rows(spark, sf_dir).select("c", F.when(F.col("o") % 10 > 0, F.col("o") % 4).alias("edition"), html.alias("html"))
    found = sync.texts_by_key(rows, "c", "edition", "html", F.col("c"), 10, 100_000)
    return found.select("c", _pairs(F.col("texts")).alias("texts"))


def filled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    upstream = order_rows(spark, sf_dir).where("o % 3 > 0").groupBy("c").agg(F.when(F.col("c") % 4 == 0, "").otherwise(F.min("p")).alias("text"))
    local = customers(spark, sf_dir).select("c", F.when(F.col("c") % 5 == 0, "").otherwise(F.col("segment")).alias("text"))
    return sync.filled_from_local(upstream, local, ["c"], "text")


def chosen_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("name"))
    lines = order_lines(spark, sf_dir).select("o", F.posexplode("rows").alias("at_", "r")).select("o", F.col("at_").cast("long").alias("place"), F.col("r.p").alias("p"))
    return sync.options_in_order(lines, ["o", "place"], parts, "p", "name")


def readable_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.readable(customers(spark, sf_dir).select("c", "name"), order_rows(spark, sf_dir).where("x > 20000000"), "c")


def fresh_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers that have orders of three priorities since 1997."""
    orders = order_rows(spark, sf_dir)
    wanted = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    return sync.fresh_only(orders.select("c", "o"), orders, "c", "p", wanted, "d", F.lit(852_076_800_000_000)).select("c", "o")


def stamped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = order_rows(spark, sf_dir).where("o % 4 = 0").groupBy("c").agg(F.max("o").alias("o"), F.max("d").alias("d"))
    rows = customers(spark, sf_dir).select("c", F.lit(-1).cast("long").alias("o"), F.col("n").alias("d"))
    return sync.stamped(rows, newest, "c", ["o", "d"])


def stale_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = order_rows(spark, sf_dir)
    cuts = customers(spark, sf_dir).select("c", F.col("segment").alias("url"), (F.col("c") % 3).alias("size"), F.when(F.col("c") % 13 > 0, F.lit(860_000_000_000_000) + F.col("n") * 3_000_000_000_000).alias("cut_at"))
    files = customers(spark, sf_dir).where("c % 6 > 0").select("c", F.when(F.col("c") % 5 == 0, "other").otherwise(F.col("segment")).alias("url"), (F.col("c") % 3).alias("size"), F.lit(850_000_000_000_000).alias("updated"))
    return sync.stale(cuts, files, orders.select("c", F.col("d").alias("updated")), "c")


def chapter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = order_rows(spark, sf_dir).where("x % 3 = 0").select("c", F.when(F.col("o") % 4 > 0, F.col("o") % 4).alias("verse"), "o", "p")
    return sync.verdicts(checks, ["c"], "verse", "o", "p")


def added_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = order_rows(spark, sf_dir).select("o", "p", (F.col("c") % 40).alias("tier"), F.when(F.col("c") % 3 > 0, F.col("c") % 20).alias("clip"), F.when(F.col("s") == "O", "queued").otherwise("done").alias("state"))
    return sync.added_jobs(jobs.where("o % 2 = 0"), jobs.where("o % 2 = 1"), ["p", "tier", "clip"]).select("o")


def carried_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    captions = order_rows(spark, sf_dir).select((F.col("c") % 50).alias("key"), F.col("o").alias("nth"), (F.col("x") % 60).alias("from"), (F.col("x") % 60 + F.col("o") % 9).alias("to"), (F.col("x") % 700).alias("start"), (F.col("x") % 700 + 150).alias("end"))
    marks = customers(spark, sf_dir).select((F.col("c") % 50).alias("key"), F.col("c").alias("id"), (F.col("c") * 7 % 60).alias("word"), (F.col("c") * 13 % 800).alias("middle"))
    return sync.carried_marks(captions, marks, "key").select("id", "nth")


def restored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a year in which a customer ordered nothing, between the first and the last in which they did."""
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording"), F.month("o_orderdate").alias("key"))
    return sync.restored_keys(said, said.select("key"), "recording", "key").select("recording", "key", "before")


QUERIES = {f.__name__: f for f in (
    parsed_keys, opening_keys, sane_tags, sane_clips, payload_faults, overlaid_styles, changed_styles, remaining_styles, toggled_ids, all_lines_priced, filled_lists, hidden_words, gloss_lines, titles,
    preferred_texts, clamped_segments, reference_words, clip_times, encoded_edits, decoded_edits, edit_addresses, answers, texts_by_key, filled_texts, chosen_options, readable_editions, fresh_texts,
    stamped_rows, stale_cuts, chapter_verdicts, added_jobs, carried_marks, restored_keys,
)}

_O = "o AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS x, epoch_us(o_orderdate) AS d FROM orders)"
_C = "k AS (SELECT c_custkey AS c, c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS n FROM customer)"
_L = """r AS (SELECT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS x, CASE WHEN l_returnflag = 'A' THEN '  ' ELSE ' ' || l_returnflag || l_suppkey END AS gloss, l_linestatus = 'F' AS excluded FROM lineitem),
  l AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k, p, x, gloss, excluded) AS nth FROM r)"""
_HALVES = "h AS (SELECT o, p % 2 AS side, k, x, excluded, row_number() OVER (PARTITION BY o, p % 2 ORDER BY nth) AS i FROM l), z AS (SELECT o, count(CASE WHEN side = 0 THEN 1 END) AS na, count(CASE WHEN side = 1 THEN 1 END) AS nb FROM h GROUP BY o)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<sup\b[^>]*>.*?</sup>', '', 'g'), '<[^>]*>?', '', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s{2,}', ' ', 'g'))"
_STYLE = "m AS (SELECT c, unnest(['edge', 'size', 'tone']) AS key, unnest([CASE WHEN c % 5 = 0 THEN CAST(n AS VARCHAR) END, CASE WHEN c % 2 = 0 THEN CAST(c % 3 + 11 AS VARCHAR) END, CASE WHEN c % 3 = 0 THEN segment END]) AS v FROM k), b AS (SELECT c, unnest(['font', 'size', 'tone']) AS key, unnest(['plain', '12', segment]) AS v FROM k)"
_EDIT = """t AS (SELECT o, '{"c":[' || string_agg('[' || k * 1000 || ',' || (k * 1000 + p) || CASE WHEN excluded THEN ',1]' ELSE ']' END, ',' ORDER BY nth) || '],"t":' || (100 + o % 26) || ',"l":' || CASE WHEN o % 2 = 0 THEN 1 ELSE 0 END || ',"d":' || CASE WHEN o % 3 = 0 THEN 1 ELSE 0 END || '}' AS j FROM l GROUP BY o)"""

ORACLES = {
    "parsed_keys": f"WITH {_O} SELECT o, CASE WHEN o % 3 = 0 THEN c || ':' || o % 10 WHEN o % 4 > 0 AND c % 5 > 0 THEN c || ':' || o % 4 END AS key FROM o",
    "opening_keys": f"WITH {_O} SELECT o, c % 7 > 0 AND o % 4 < 2 AS opening FROM o",
    "sane_tags": f"WITH {_C}, t AS (SELECT c, CASE WHEN c % 3 = 1 THEN left(trim(name), 20) END AS artist, CASE WHEN c % 4 = 1 THEN left(segment || segment || segment, 20) END AS title, CASE WHEN c * 37 % 1300 BETWEEN 51 AND 1049 THEN c * 37 % 1300 - 50 END AS track FROM k) SELECT c, artist IS NULL AND title IS NULL AND track IS NULL AS nothing, artist, title, track FROM t",
    "sane_clips": f"""WITH {_O}, n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) AS i, o * 37 % 5000 - 200 AS a FROM o), g AS (SELECT c, i, p AS id, a, a + x % 3000 AS b FROM n WHERE i <= 8 AND o % 6 > 1 AND a >= 0 AND x % 3000 >= 1000)
      SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) - 1 AS nth, id, a AS start, b AS "end" FROM g""",
    "payload_faults": f"WITH {_O} SELECT o, CASE WHEN o % 9 = 0 OR o % 5 < 1 THEN 'count' WHEN o % 8 = 0 OR o % 30 < 5 THEN 'order' WHEN o % 30 > 24 THEN 'size' END AS fault FROM o",
    "overlaid_styles": f"WITH {_C}, {_STYLE}, w AS (SELECT c, key, v FROM m WHERE c % 7 > 0 AND v IS NOT NULL UNION ALL SELECT b.c, b.key, b.v FROM b LEFT JOIN m ON m.c = b.c AND m.key = b.key WHERE b.c % 7 = 0 OR m.v IS NULL) SELECT c, string_agg(key || '=' || v, ',' ORDER BY key) AS style FROM w GROUP BY c",
    "changed_styles": f"WITH {_C}, {_STYLE}, w AS (SELECT m.c, m.key, m.v FROM m LEFT JOIN b ON b.c = m.c AND b.key = m.key WHERE m.v IS NOT NULL AND m.v IS DISTINCT FROM b.v) SELECT k.c, coalesce(string_agg(key || '=' || v, ',' ORDER BY key), '') AS style FROM k LEFT JOIN w ON w.c = k.c GROUP BY k.c",
    "remaining_styles": f"WITH {_C}, {_STYLE} SELECT c, string_agg(CASE WHEN v IS NOT NULL AND key <> 'size' AND NOT (key = 'tone' AND c % 2 = 1) THEN key || '=' || v END, ',' ORDER BY key) AS style FROM m GROUP BY c",
    "toggled_ids": f"""WITH {_O}, i AS (SELECT DISTINCT c, p FROM o), n AS (SELECT c, count(*) AS n FROM i GROUP BY c), t AS (SELECT c, n, CASE c % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '9-NEW' END AS q FROM n),
      h AS (SELECT t.*, EXISTS (SELECT 1 FROM i WHERE i.c = t.c AND i.p = q) AS has FROM t), u AS (SELECT i.c, p, n, q, has, 0 AS late FROM i JOIN h ON h.c = i.c UNION ALL SELECT c, q, n, q, has, 1 FROM h WHERE NOT has AND n < 4)
      SELECT c, string_agg(p, ',' ORDER BY late, p) AS ids FROM u WHERE NOT (has AND n > 1 AND p = q) GROUP BY c""",
    "all_lines_priced": f"WITH {_L} SELECT o, min(x) > 1000000 AND min(p) > 20 AS every FROM l GROUP BY o",
    "filled_lists": f"""WITH {_L}, {_HALVES}, f AS (SELECT z.o, a.i, CASE WHEN a.x % 3 > 0 THEN CAST(a.k AS VARCHAR) WHEN na = nb THEN CAST(b.k + 10 AS VARCHAR) ELSE '-' END AS t, a.i IS NOT NULL AS is FROM z LEFT JOIN h a ON a.o = z.o AND a.side = 0 LEFT JOIN h b ON b.o = z.o AND b.side = 1 AND b.i = a.i)
      SELECT o, coalesce(string_agg(CASE WHEN i IS NOT NULL THEN t END, ',' ORDER BY i), '') AS filled FROM f GROUP BY o""".replace(", a.i IS NOT NULL AS is", ""),
    "hidden_words": f"""WITH {_L}, {_HALVES}, s AS (SELECT a.o, a.i AS at_, CAST(a.excluded AND b.excluded AS INT) AS t FROM z JOIN h a ON a.o = z.o AND a.side = 0 JOIN h b ON b.o = z.o AND b.side = 1 AND b.i = a.i WHERE na = nb
      UNION ALL SELECT h.o, h.i + CASE WHEN side = 1 THEN 100000 ELSE 0 END, CAST(excluded AS INT) FROM h JOIN z ON z.o = h.o WHERE na <> nb) SELECT o, string_agg(CAST(t AS VARCHAR), '' ORDER BY at_) AS hidden FROM s GROUP BY o""",
    "gloss_lines": f"WITH {_L} SELECT o, coalesce(string_agg(CASE WHEN NOT excluded AND trim(gloss) <> '' THEN trim(gloss) END, ' ' ORDER BY nth), '') AS line FROM l GROUP BY o",
    "titles": f"""WITH {_C}, t AS (SELECT c, name, n, name || ' | ' || segment || ' | ' || repeat(segment, c % 2) AS a, name || ' | ' || repeat(segment, c % 3) AS b FROM k)
      SELECT c, CASE WHEN length(a) <= 24 THEN a WHEN length(b) <= 24 THEN b ELSE rtrim(left(b, 23)) || '…' END AS title, length(a) > 24 AND length(b) > 24 AS cut, name || ' (' || n || ':' || (c % 9 + 1) || '-' || (c % 9 + 4) || ') Clip' AS stored FROM t""",
    "preferred_texts": f"""WITH {_C}, t AS (SELECT c, CASE WHEN c % 2 = 0 THEN 'A' || c END AS a, CASE WHEN c % 5 = 1 THEN 'B' || c END AS b, CASE WHEN c % 7 = 0 THEN 'D' END AS d, CASE WHEN c % 4 = 1 THEN 'own a' END AS la, CASE WHEN c % 4 = 3 THEN 'own b' END AS lb FROM k)
      SELECT c, coalesce(CASE c % 3 WHEN 0 THEN coalesce(a, la, b) WHEN 1 THEN coalesce(b, lb, d, a) END, a, b, d, '') AS text FROM t""",
    "clamped_segments": f"""WITH {_L}, s AS (SELECT o, k AS number, greatest(0, least(4000, p * 40 - o % 3000)) AS a, greatest(0, least(4000, p * 40 + x % 900 - o % 3000)) AS b FROM l) SELECT o, number, a AS start, b AS "end" FROM s WHERE b > a""",
    "reference_words": f"""WITH {_C}, w AS (SELECT c, c || ':1' AS key, string_split(replace(name, '#', ' '), ' ') AS x FROM k UNION ALL SELECT c, n || ':2', [segment, 'x'] FROM k) SELECT c, key, i - 1 AS place, x[i] AS word FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM w)""",
    "clip_times": f"""WITH {_C}, s AS (SELECT c, 'k' || lpad(CAST(c * 7919 % 9999991 AS VARCHAR), 7, '7') AS t FROM k), v AS (SELECT c, list_reduce([CAST(strpos('0123456789abcdefghijklmnopqrstuvwxyz', t[i]) - 1 AS BIGINT) for i in range(1, 9)], lambda a, b: a * 36 + b) AS ms FROM s) SELECT c, CASE WHEN c % 11 > 0 AND ms BETWEEN {EARLIEST} AND {LATEST} THEN ms END AS made_at FROM v""",
    "encoded_edits": f"WITH {_L}, {_EDIT} SELECT o, rtrim(translate(to_base64(CAST(j AS BLOB)), '+/', '-_'), '=') AS text FROM t",
    "decoded_edits": f"WITH {_L}, g AS (SELECT o, count(*) AS cuts, CAST(sum(p) AS BIGINT) AS removed FROM l GROUP BY o) SELECT o, CASE WHEN o % 5 > 0 THEN cuts END AS cuts, CASE WHEN o % 5 > 0 THEN removed END AS removed, CASE WHEN o % 5 > 0 THEN 100 + o % 26 END AS tempo, CASE WHEN o % 5 > 0 THEN CAST(o % 2 = 0 AS INT) END AS l, CASE WHEN o % 5 > 0 THEN CAST(o % 3 = 0 AS INT) END AS d FROM g",
    "edit_addresses": f"WITH {_C} SELECT c, CASE c % 4 WHEN 3 THEN '/api/audio/other?edit=zz' WHEN 2 THEN '' ELSE '/api/audio/ayahs?reciter=' || n || '&ayah=3' END AS source, CASE WHEN c % 4 < 3 THEN 'e' || c END AS edit FROM k",
    "answers": f"""WITH {_C} SELECT c, CASE c % 3 WHEN 0 THEN '{{"n": ' || n || '}}' WHEN 1 THEN '{{"n": [' || n || ']}}' ELSE '{{"n": ' || n || '}}' END AS json FROM k""",
    "texts_by_key": f"""WITH {_O}, h AS (SELECT c, CAST(o % 4 AS VARCHAR) AS e, CASE WHEN o % 6 = 0 THEN ' <i></i>' ELSE '<b>' || p || '</b><sup>1</sup> , ' || o END AS html FROM o WHERE o % 10 > 0 AND c BETWEEN 10 AND 100000), t AS (SELECT c, e, {_PLAIN} AS t FROM h), u AS (SELECT c, e, max(t) AS t FROM t WHERE t <> '' GROUP BY c, e)
      SELECT c, string_agg(e || '=' || t, ',' ORDER BY e) AS texts FROM u GROUP BY c""",
    "filled_texts": f"WITH {_O}, {_C}, u AS (SELECT c, CASE WHEN c % 4 = 0 THEN NULL ELSE min(p) END AS t FROM o WHERE o % 3 > 0 GROUP BY c), b AS (SELECT coalesce(u.c, k.c) AS c, coalesce(u.t, CASE WHEN k.c % 5 > 0 THEN segment END) AS text FROM u FULL JOIN k ON k.c = u.c) SELECT c, text FROM b WHERE text IS NOT NULL",
    "chosen_options": f"WITH {_L} SELECT o, nth - 1 AS place, l.p, coalesce(p_name, CAST(l.p AS VARCHAR)) AS name FROM l LEFT JOIN part ON p_partkey = l.p AND p_size > 20",
    "readable_editions": f"WITH {_O}, {_C} SELECT c, name FROM k WHERE EXISTS (SELECT 1 FROM o WHERE o.c = k.c AND x > 20000000)",
    "fresh_texts": f"WITH {_O} SELECT c, o FROM o WHERE c IN (SELECT c FROM o WHERE d >= 852076800000000 GROUP BY c HAVING bool_or(p = '1-URGENT') AND bool_or(p = '2-HIGH') AND bool_or(p = '3-MEDIUM'))",
    "stamped_rows": f"WITH {_O}, {_C} SELECT k.c, coalesce(max(o), -1) AS o, CASE WHEN count(o) > 0 THEN max(d) ELSE max(n) END AS d FROM k LEFT JOIN o ON o.c = k.c AND o % 4 = 0 GROUP BY k.c",
    "stale_cuts": f"WITH {_O}, {_C}, m AS (SELECT c, max(d) AS d FROM o GROUP BY c) SELECT k.c, k.c % 6 = 0 OR k.c % 5 = 0 OR k.c % 13 = 0 OR coalesce(greatest(850000000000000, d) > 860000000000000 + n * 3000000000000, false) AS stale FROM k LEFT JOIN m ON m.c = k.c",
    "chapter_verdicts": f"WITH {_O} SELECT c, CASE WHEN o % 4 > 0 THEN o % 4 END AS verse, string_agg(p, '; ' ORDER BY o) AS reasons FROM o WHERE x % 3 = 0 GROUP BY 1, 2",
    "added_jobs": f"WITH {_O}, j AS (SELECT o, p || '/' || c % 40 || '/' || CASE WHEN c % 3 > 0 THEN CAST(c % 20 AS VARCHAR) ELSE 'none' END AS same, s FROM o) SELECT o FROM j WHERE o % 2 = 1 AND same NOT IN (SELECT same FROM j WHERE o % 2 = 0 AND s = 'O')",
    "carried_marks": f"WITH {_O}, {_C} SELECT k.c AS id, min(o) AS nth FROM k JOIN o ON o.c % 50 = k.c % 50 AND k.c * 7 % 60 BETWEEN x % 60 AND x % 60 + o % 9 AND k.c * 13 % 800 >= x % 700 AND k.c * 13 % 800 < x % 700 + 150 GROUP BY k.c",
    "restored_keys": """WITH s AS (SELECT DISTINCT o_custkey AS r, month(o_orderdate) AS k FROM orders), g AS (SELECT r, k, lead(k) OVER (PARTITION BY r ORDER BY k) AS next FROM s), m AS (SELECT r, next, unnest(range(k + 1, next)) AS k FROM g WHERE next > k + 1) SELECT r AS recording, k AS key, next AS before FROM m WHERE k IN (SELECT k FROM s)""",
}
