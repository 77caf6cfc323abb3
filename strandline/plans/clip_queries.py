"""Queries of the clip operators: each user is a recording, each event a clip, cut, pause or block on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import clips, runs
from strandline.plans.run_queries import frames

USER = ["user_id"]
DURATION, HOUR = 2_500_000_000, 3_600_000


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with m: milliseconds since the start of 2024."""
    return frames(spark, sf_dir).withColumn("m", F.floor(F.col("t") / 1000) - 1_704_067_200_000)


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a verse that takes six tenths of the time to the next one."""
    after = F.lead("m").over(Window.partitionBy("user_id").orderBy("n"))
    length = F.coalesce(F.floor((after - F.col("m")) * 6 / 10), F.lit(1000))
    return moments(spark, sf_dir).withColumns({"start": F.col("m"), "end": F.col("m") + length})


def new_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clips.new_clip(F.col("m"), F.col("m") + F.col("v") % 5000 - 2500, F.lit(DURATION))
    return moments(spark, sf_dir).withColumn("c", made).where("c IS NOT NULL").select("event_id", "c.start", "c.end")


def moved_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = clips.moved_clip(F.col("m"), F.col("m") + 4000, F.col("event_id") % 3 == 0, F.col("m") - 1000, F.col("m") + F.col("v") % 3000 - 1000, F.lit(DURATION))
    return moments(spark, sf_dir).withColumn("c", window).select("event_id", "c.start", "c.end")


def dragged_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.element_at(F.array(F.lit("move"), F.lit("start"), F.lit("end")), (F.col("event_id") % 3 + 1).cast("int"))
    window = clips.dragged_clip(F.col("m"), F.col("m") + 3000, edge, (F.col("v") % 7000 - 3500) * 100, F.lit(DURATION))
    return moments(spark, sf_dir).withColumn("c", window).select("event_id", "c.start", "c.end")


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("event_id") * 7919 % 60) * 20 + F.col("event_id") % 3 * 4
    return moments(spark, sf_dir).select("user_id", "event_id", "event_type", start.alias("start"), (start + 1000 + F.col("event_id") % 2 * 20).alias("end"))


def added_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coarse(spark, sf_dir)
    added = rows.where("event_type <> 'click'").select("user_id", "event_id", "start", "end")
    return clips.added_clips(rows.where("event_type = 'click'"), added, USER).select("event_id")


def removed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coarse(spark, sf_dir)
    gone = rows.where("event_type = 'error'").select((F.col("event_id") + 1).alias("event_id"))
    return rows.join(gone, "event_id", "left_anti").select("event_id", "start", "end")


def verse_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.verse_windows(verses(spark, sf_dir), USER, ["n"], F.lit(DURATION)).select("event_id", "open", "close")


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), (F.col("m") - 6 * HOUR).alias("start"), (F.col("m") + 30 * HOUR).alias("end"))


def snapped_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.snapped(_selections(spark, sf_dir), verses(spark, sf_dir), USER, ["n"], "event_type", F.lit(DURATION), 24 * HOUR).select("id", "open", "close")


def clip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verses that a stretch of a recording holds, as chapter:first-last; nothing where it holds several chapters."""
    held = verses(spark, sf_dir).where((F.col("end") > 24 * HOUR) & (F.col("start") < 24 * 30 * HOUR)).select("user_id", (F.floor(F.col("user_id") / 2) + F.floor(F.col("n") / 70)).alias("chapter_"), (F.col("n") % 70 + 1).alias("verse"))
    found = runs.passage(held, USER, "chapter_", "verse", (-1, 0, 0))
    label = F.when(F.col("chapter") < 0, "").when(F.col("first") == F.col("last"), F.format_string("%d:%d", "chapter", "first")).otherwise(F.format_string("%d:%d–%d", "chapter", "first", "last"))
    return found.select("user_id", label.alias("label"))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(spark, sf_dir).select("user_id", (F.col("m") - F.col("v") * 9000).alias("start"), (F.col("m") + F.col("v") % 900 * 60_000 - 60_000).alias("end"), (F.col("event_id") % 5 > 0).alias("auto"))


def normal_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.normal_cuts(_cuts(spark, sf_dir), USER, F.lit(DURATION)).select("user_id", "start", "end", "auto")


def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the edited recordings, joins of the cuts among them, on the clock of the source."""
    cuts = clips.normal_cuts(_cuts(spark, sf_dir), USER, F.lit(DURATION))
    line = Window.partitionBy("user_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    joins = cuts.select("user_id", (F.col("start") - F.coalesce(F.sum(F.col("end") - F.col("start")).over(line), F.lit(0))).alias("time"))
    times = moments(spark, sf_dir).select("user_id", F.floor(F.col("m") / 3).alias("time")).unionByName(joins).distinct()
    closes = clips.to_source(times, cuts, "user_id", "end").select("user_id", "time", F.col("source").alias("as_end"))
    return clips.to_source(times, cuts, "user_id", "start").select("user_id", "time", F.col("source").alias("as_start")).join(closes, ["user_id", "time"])


def _pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moments(spark, sf_dir)
    pauses = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("m").alias("start"), (F.col("m") + F.col("v") % 3000).alias("end"))
    changes = rows.where("event_type = 'click' OR event_id % 4 = 0").select("user_id", (F.col("m") + F.when(F.col("event_type") == "click", 2 * HOUR).otherwise(100)).alias("time"), (F.col("v") % 2 == 0).alias("same"))
    changes = changes.groupBy("user_id", "time").agg(F.min("same").alias("same"))
    signs = rows.where("event_type <> 'error'").groupBy("user_id", F.col("m").alias("time")).agg(F.max(F.col("v") % 3 == 0).alias("stops"))
    return clips.pause_kinds(pauses, changes, signs, "user_id", HOUR)


def pause_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pauses(spark, sf_dir).select("id", "kind")


def pause_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.pause_cuts(_pauses(spark, sf_dir)).select("id", "cut_start", "cut_end")


def fitted_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings that play their verses one after the other, brought to 700 minutes."""
    said = verses(spark, sf_dir).select("user_id", "n", (F.col("v") * 300).alias("length"))
    line = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    tails = said.select("user_id", F.col("n").alias("nth"), F.coalesce(F.sum(F.col("length") * 9 / 10).over(line), F.lit(0)).alias("length"))
    whole = said.groupBy("user_id").agg(F.sum("length").alias("by_hand"), F.floor(F.sum("length") * 9 / 10).alias("shortened"))
    judged = clips.fitted(whole.withColumn("target", F.lit(150_000_000) + F.col("user_id") % 7 * 40_000_000), tails, USER)
    return judged.select("user_id", "way", "percent", "dropped")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verses(spark, sf_dir).select("user_id", "event_id", "v", "start", "end")


def moved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.moved_blocks(_blocks(spark, sf_dir), USER, F.col("start") + (F.col("v") - 10_000) * 2000, F.lit(DURATION)).select("event_id", "to_start", "to_end")


def resized_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.resized_blocks(_blocks(spark, sf_dir), USER, "start", F.col("start") + (F.col("v") - 10_000) * 2000, F.lit(DURATION)).select("event_id", "to_start", "to_end")


def resized_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.resized_blocks(_blocks(spark, sf_dir), USER, "end", F.col("end") + (F.col("v") - 10_000) * 2000, F.lit(DURATION)).select("event_id", "to_start", "to_end")


def appended_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block more on every lane; lanes of odd users are full."""
    ends = Window.partitionBy("user_id")
    rows = _blocks(spark, sf_dir).withColumn("duration", F.max("end").over(ends) + F.when(F.col("user_id") % 2 == 0, 90_000).otherwise(0))
    return clips.appended_blocks(rows, USER, F.col("duration")).select("user_id", "start", "end", "added")


def clamped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = moments(spark, sf_dir).where("event_type <> 'view'").select("user_id", F.col("event_id").alias("id"), (F.col("m") - F.col("v") * 500).alias("start"), (F.col("m") + F.col("v") * 700).alias("end"))
    return clips.clamped_into(spans, verses(spark, sf_dir).where("end > start").select("user_id", "start", "end"), "user_id", 6 * HOUR).select("id", "start", "end")


def nearest_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = moments(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("m").alias("time"))
    quiet = moments(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("m").alias("start"), (F.col("m") + F.col("v") * 100).alias("end"))
    return clips.nearest_spans(points, quiet, "user_id", 12 * HOUR).select("id", "start", "end", "gap")


def voice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = verses(spark, sf_dir).withColumns({"said": F.when(F.col("event_id") % 7 > 0, F.col("start") + F.col("v")), "last_word": F.when(F.col("user_id") % 5 > 0, F.col("start"))})
    quiet = moments(spark, sf_dir).select("user_id", (F.col("m") + F.col("v") % 900 - 300).alias("start"), (F.col("m") + 3 * HOUR).alias("end"))
    return clips.to_the_voice(captions, quiet, USER, ["n"]).select("event_id", "start", "end")


def captions_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verses(spark, sf_dir).where("end > start")
    captions = rows.where("n % 5 <> 2").select("user_id", F.col("event_id").alias("id"), "start", (F.col("end") + F.col("v") * 400).alias("end"))
    repeats = rows.where("n % 5 = 2").select("user_id", (F.col("start") - F.col("v") * 100).alias("start"), (F.col("start") + F.col("v") * 50 + 1).alias("end"))
    return clips.with_repeats(captions, clips.normal_cuts(repeats.withColumn("auto", F.lit(True)), USER, F.lit(DURATION)), "user_id", 6 * HOUR, HOUR)


def caption_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = verses(spark, sf_dir).dropDuplicates(["user_id", "start"]).select("user_id", F.col("event_id").alias("id"), "start", "end")
    times = moments(spark, sf_dir).select("user_id", (F.col("m") + F.col("v") * 150 - HOUR).alias("time")).distinct()
    return clips.layers_at(times, captions, "user_id", 8 * HOUR)


QUERIES = {f.__name__: f for f in (
    voice_edges, captions_with_repeats, caption_layers, new_clips, moved_clips, dragged_clips, added_clips, removed_clips, verse_windows, snapped_clips, clip_labels, normal_cuts, source_times, pause_kinds, pause_cuts, fitted_lengths,
    moved_blocks, resized_starts, resized_ends, appended_blocks, clamped_spans, nearest_quiet,
)}

_M = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) - 1704067200000 AS m, event_id, event_type FROM events),
  s AS (SELECT *, m AS a, m + coalesce(CAST(floor((lead(m) OVER (PARTITION BY user_id ORDER BY n) - m) * 6 / 10) AS BIGINT), 1000) AS b FROM e)"""
_D = DURATION
_CUTS = f"""c AS (SELECT user_id, greatest(0, m - v * 9000) AS a, least({_D}, m + v % 900 * 60000 - 60000) AS b, event_id % 5 > 0 AS auto FROM e), d AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c WHERE b - a >= 50),
  f AS (SELECT *, sum(CASE WHEN was IS NULL OR a > was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM d), k AS (SELECT user_id, min(a) AS a, max(b) AS b, bool_and(auto) AS auto FROM f GROUP BY user_id, run)"""
_PAUSES = """p AS (SELECT user_id, event_id AS id, m AS a, m + v % 3000 AS b FROM e WHERE event_type = 'error'), x AS (SELECT user_id, m + CASE WHEN event_type = 'click' THEN 7200000 ELSE 100 END AS t, min(v % 2 = 0) AS same FROM e WHERE event_type = 'click' OR event_id % 4 = 0 GROUP BY 1, 2),
  w AS (SELECT user_id, m AS t, max(v % 3 = 0) AS stops FROM e WHERE event_type <> 'error' GROUP BY 1, 2),
  q AS (SELECT p.*, (SELECT same FROM x WHERE x.user_id = p.user_id AND x.t BETWEEN a - 250 AND b + 250 ORDER BY x.t LIMIT 1) AS same, (SELECT stops FROM w WHERE w.user_id = p.user_id AND w.t <= a ORDER BY w.t DESC LIMIT 1) AS stops FROM p),
  y AS (SELECT *, CASE WHEN same THEN 'stop' WHEN NOT same THEN 'ayah' WHEN stops THEN 'stop' ELSE 'breath' END AS kind FROM q)"""
_WALLS = f"z AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY a), 0) AS lo, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), {_D}) AS hi FROM s)"
_WINDOW = f"""g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY n), 0) AS lo, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY n), {_D}) AS hi FROM s),
  h AS (SELECT *, least(a, greatest(lo + CAST(floor(greatest(0, a - lo) / 2) AS BIGINT), a - 500, 0)) AS o, greatest(b, least(b + CAST(floor(greatest(0, hi - b) / 2) AS BIGINT), b + 500)) AS c FROM g)"""

ORACLES = {
    "voice_edges": f"""WITH {_M}, k AS (SELECT *, min(n) OVER (PARTITION BY user_id) = n AS f, max(n) OVER (PARTITION BY user_id) = n AS l, CASE WHEN event_id % 7 > 0 THEN a + v END AS said FROM s)
      SELECT event_id, CASE WHEN f AND said - 400 > a THEN said - 400 ELSE a END AS start, CASE WHEN l AND user_id % 5 > 0 THEN coalesce((SELECT CASE WHEN min(q.m + q.v % 900 - 300) + 1000 < k.b THEN min(q.m + q.v % 900 - 300) + 1000 END FROM e q
        WHERE q.user_id = k.user_id AND q.m + 10800000 >= k.b - 100 AND q.m + q.v % 900 - 300 <= k.b AND q.m + q.v % 900 - 300 >= k.a), b) ELSE b END AS "end" FROM k""",
    "captions_with_repeats": f"""WITH {_M}, c AS (SELECT user_id, greatest(0, a - v * 100) AS a, least({_D}, a + v * 50 + 1) AS b FROM s WHERE b > a AND n % 5 = 2), d AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c WHERE b - a >= 50),
      g AS (SELECT *, sum(CASE WHEN was IS NULL OR a > was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM d), r0 AS (SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, run),
      r AS (SELECT user_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS nth FROM r0) WHERE nth <= 400), x AS (SELECT user_id, event_id AS id, a, b + v * 400 AS b FROM s WHERE b > a AND n % 5 <> 2),
      y AS (SELECT user_id, id, a, coalesce((SELECT min(r.a) FROM r WHERE r.user_id = x.user_id AND r.a > x.a AND r.a < x.b), b) AS b FROM x), z AS (SELECT *, coalesce((SELECT sum(greatest(0, least(r.b, y.b) - greatest(r.a, y.a))) FROM r WHERE r.user_id = y.user_id), 0) AS c FROM y),
      w AS (SELECT user_id, id, coalesce((SELECT min(r.b) FROM r WHERE r.user_id = z.user_id AND z.a >= r.a AND z.a < r.b), a) AS a, b FROM z WHERE c * 2 <= b - a)
      SELECT user_id, id, a AS start, b AS "end" FROM w WHERE b - a >= 3600000 OR NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = w.user_id AND (r.a = w.b OR r.b = w.a)) UNION ALL SELECT user_id, NULL, a, b FROM r""",
    "caption_layers": f"""WITH {_M}, c AS (SELECT user_id, event_id AS id, a, b, lag(event_id) OVER q AS pid, lag(a) OVER q AS pa, lag(b) OVER q AS pb, row_number() OVER q AS i FROM s WINDOW q AS (PARTITION BY user_id ORDER BY a)), h AS (SELECT *, CAST(floor(greatest(0, 28800000 - greatest(0, a - pb)) / 2) AS BIGINT) AS half FROM c),
      w AS (SELECT user_id, id, pid, a, i, CASE WHEN pid IS NULL THEN a - least(28800000, greatest(0, a)) ELSE greatest(pa, a - 28800000 + half) END AS x, CASE WHEN pid IS NULL THEN a ELSE least(b, a + half) END AS y FROM h),
      t AS (SELECT DISTINCT user_id, m + v * 150 - 3600000 AS time FROM e), k AS (SELECT t.*, coalesce((SELECT max(i) FROM w WHERE w.user_id = t.user_id AND w.a <= t.time), 0) AS i FROM t),
      p AS (SELECT k.*, n.id AS nid, n.pid AS npid, n.x AS nx, n.y AS ny, o.id AS oid, o.pid AS opid, o.x AS ox, o.y AS oy FROM k LEFT JOIN w n ON n.user_id = k.user_id AND n.i = k.i + 1 LEFT JOIN w o ON o.user_id = k.user_id AND o.i = k.i)
      SELECT user_id, time, CASE WHEN time >= nx AND time < ny THEN nid ELSE oid END AS shown, CASE WHEN time >= nx AND time < ny THEN npid WHEN time >= ox AND time < oy THEN opid END AS leaving,
        CAST(floor(CASE WHEN time >= nx AND time < ny THEN (time - nx) * 1000 / (ny - nx) WHEN time >= ox AND time < oy THEN (time - ox) * 1000 / (oy - ox) END) AS BIGINT) AS thousandths FROM p""",
    "new_clips": f'WITH {_M}, c AS (SELECT event_id, greatest(0, least(m, m + v % 5000 - 2500)) AS start, least({_D}, greatest(m, m + v % 5000 - 2500)) AS "end" FROM e) SELECT * FROM c WHERE "end" - start >= 1000',
    "moved_clips": f'WITH {_M}, c AS (SELECT *, greatest(0, least(m - 1000, m + v % 3000 - 1000)) AS x, least({_D}, greatest(m - 1000, m + v % 3000 - 1000)) AS y FROM e) SELECT event_id, CASE WHEN event_id % 3 = 0 AND y - x >= 1000 THEN x ELSE m END AS start, CASE WHEN event_id % 3 = 0 AND y - x >= 1000 THEN y ELSE m + 4000 END AS "end" FROM c',
    "dragged_clips": f"""WITH {_M}, c AS (SELECT *, (v % 7000 - 3500) * 100 AS d FROM e) SELECT event_id, CASE event_id % 3 WHEN 0 THEN greatest(0, least(m + d, {_D} - 3000)) WHEN 1 THEN greatest(0, least(m + d, m + 2000)) ELSE m END AS start,
      CASE event_id % 3 WHEN 0 THEN greatest(0, least(m + d, {_D} - 3000)) + 3000 WHEN 1 THEN m + 3000 ELSE least({_D}, greatest(m + 3000 + d, m + 1000)) END AS "end" FROM c""",
    "added_clips": f"""WITH {_M}, c AS (SELECT user_id, event_id, event_type, (event_id * 7919 % 60) * 20 + event_id % 3 * 4 AS a, (event_id * 7919 % 60) * 20 + event_id % 3 * 4 + 1000 + event_id % 2 * 20 AS b FROM e), k AS (SELECT * FROM c WHERE event_type = 'click')
      SELECT event_id FROM c WHERE event_type <> 'click' AND (SELECT count(*) FROM k WHERE k.user_id = c.user_id) < 100 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = c.user_id AND abs(k.a - c.a) < 10 AND abs(k.b - c.b) < 10)""",
    "removed_clips": f'WITH {_M} SELECT event_id, (event_id * 7919 % 60) * 20 + event_id % 3 * 4 AS start, (event_id * 7919 % 60) * 20 + event_id % 3 * 4 + 1000 + event_id % 2 * 20 AS "end" FROM e WHERE event_id NOT IN (SELECT event_id + 1 FROM events WHERE event_type = \'error\')',
    "verse_windows": f"WITH {_M}, {_WINDOW} SELECT event_id, o AS open, c AS close FROM h",
    # the run of a row: rows of the same kind that no other kind stands between
    "snapped_clips": f"""WITH {_M}, {_WINDOW}, r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) AS r FROM h), i AS (SELECT *, min(n) OVER (PARTITION BY user_id, event_type, r) AS first, max(n) OVER (PARTITION BY user_id, event_type, r) AS last FROM r),
      q AS (SELECT user_id, event_id AS id, m - 21600000 AS x, m + 108000000 AS y FROM e WHERE event_type = 'purchase'), t AS (SELECT q.user_id, id, min(first) AS first, max(last) AS last FROM q JOIN i ON i.user_id = q.user_id AND (a + b) / 2 BETWEEN x AND y GROUP BY 1, 2)
      SELECT id, p.o AS open, z.c AS close FROM t JOIN h p ON p.user_id = t.user_id AND p.n = first JOIN h z ON z.user_id = t.user_id AND z.n = last""",
    "clip_labels": f"""WITH {_M}, h AS (SELECT user_id, CAST(floor(user_id / 2) + floor(n / 70) AS BIGINT) AS c, n % 70 + 1 AS x FROM s WHERE b > 86400000 AND a < 2592000000)
      SELECT user_id, CASE WHEN count(DISTINCT c) > 1 THEN '' WHEN min(x) = max(x) THEN min(c) || ':' || min(x) ELSE min(c) || ':' || min(x) || '–' || max(x) END AS label FROM h GROUP BY user_id""",
    "normal_cuts": f'WITH {_M}, {_CUTS} SELECT user_id, a AS start, b AS "end", auto FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS nth FROM k) WHERE nth <= 400',
    "source_times": f"""WITH {_M}, {_CUTS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a) AS nth FROM k), j AS (SELECT *, a - coalesce(sum(b - a) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM l WHERE nth <= 400),
      t AS (SELECT user_id, CAST(floor(m / 3) AS BIGINT) AS time FROM e UNION SELECT user_id, CAST(t AS BIGINT) FROM j)
      SELECT t.user_id, t.time, CAST(coalesce(max(CASE WHEN j.t = t.time THEN j.b END), t.time + coalesce(sum(j.b - j.a), 0)) AS BIGINT) AS as_start, CAST(coalesce(max(CASE WHEN j.t = t.time THEN j.a END), t.time + coalesce(sum(j.b - j.a), 0)) AS BIGINT) AS as_end
      FROM t LEFT JOIN j ON j.user_id = t.user_id AND j.t <= t.time GROUP BY t.user_id, t.time""",
    "pause_kinds": f"WITH {_M}, {_PAUSES} SELECT id, kind FROM y",
    "pause_cuts": f"""WITH {_M}, {_PAUSES}, f AS (SELECT *, CASE kind WHEN 'ayah' THEN 700 WHEN 'stop' THEN 500 ELSE 350 END AS fl FROM y), g AS (SELECT *, least(b - a, fl + least(300, CAST(floor(greatest(0, b - a - fl) * 15 / 100) AS BIGINT))) AS keep FROM f)
      SELECT id, a + CAST(floor(keep * 6 / 10) AS BIGINT) AS cut_start, b - (keep - CAST(floor(keep * 6 / 10) AS BIGINT)) AS cut_end FROM g WHERE b - a - keep >= 100""",
    "fitted_lengths": f"""WITH {_M}, l AS (SELECT user_id, n, v * 300 AS x FROM e), r AS (SELECT user_id, CAST(sum(x) AS BIGINT) AS h, CAST(floor(sum(x) * 9 / 10) AS BIGINT) AS s, 150000000 + user_id % 7 * 40000000 AS target, count(*) AS k FROM l GROUP BY user_id),
      w AS (SELECT *, CASE WHEN h <= target THEN 'plain' WHEN s <= target THEN 'shortened' WHEN ceil(s * 100 / target) <= 125 THEN 'faster' ELSE 'dropped' END AS way FROM r)
      SELECT user_id, way, CAST(CASE way WHEN 'faster' THEN ceil(s * 100 / target) WHEN 'dropped' THEN 125 ELSE 100 END AS BIGINT) AS percent,
        CASE WHEN way = 'dropped' THEN coalesce((SELECT min(w.k - l.n) FROM l WHERE l.user_id = w.user_id AND l.n > 0 AND (SELECT sum(y.x) * 0.9 FROM l y WHERE y.user_id = l.user_id AND y.n < l.n) * 100 <= target * 125), 0) ELSE 0 END AS dropped FROM w""",
    "moved_blocks": f"WITH {_M}, {_WALLS}, y AS (SELECT event_id, b - a AS len, least(greatest(a + (v - 10000) * 2000, lo), greatest(lo, hi - (b - a))) AS x FROM z) SELECT event_id, x AS to_start, x + len AS to_end FROM y",
    "resized_starts": f"WITH {_M}, {_WALLS} SELECT event_id, least(greatest(a + (v - 10000) * 2000, lo), greatest(lo, b - 200)) AS to_start, b AS to_end FROM z",
    "resized_ends": f"WITH {_M}, {_WALLS} SELECT event_id, a AS to_start, least(greatest(b + (v - 10000) * 2000, a + 200), greatest(a + 200, hi)) AS to_end FROM z",
    "appended_blocks": f"""WITH {_M}, d AS (SELECT *, max(b) OVER (PARTITION BY user_id) + CASE WHEN user_id % 2 = 0 THEN 90000 ELSE 0 END AS d, max(a) OVER (PARTITION BY user_id) = a AS last FROM s), h AS (SELECT *, last AND b > d - 200 AND b - a >= 400 AS halved, CAST(floor((a + b) / 2) AS BIGINT) AS mid FROM d)
      SELECT user_id, a AS start, CASE WHEN halved THEN mid ELSE b END AS "end", false AS added FROM h UNION ALL SELECT user_id, CASE WHEN halved THEN mid ELSE b END, CASE WHEN halved THEN b ELSE d END, true FROM h WHERE last AND (halved OR b <= d - 200)""",
    "clamped_spans": f"""WITH {_M}, p AS (SELECT user_id, event_id AS id, m - v * 500 AS x, m + v * 700 AS y FROM e WHERE event_type <> 'view') SELECT id, greatest(x, coalesce(a, x)) AS start, least(y, coalesce(b, y)) AS "end" FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.b > s.a AND floor((x + y) / 2) >= a AND floor((x + y) / 2) < b""",
    "nearest_quiet": f"""WITH {_M}, p AS (SELECT user_id, event_id AS id, m AS t FROM e WHERE event_type = 'purchase'), q AS (SELECT user_id, m AS a, m + v * 100 AS b FROM e WHERE event_type = 'error'), g AS (SELECT id, a, b, greatest(a - t, t - b, 0) AS gap FROM p JOIN q USING (user_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, a - b, a) AS nth FROM g WHERE gap <= 43200000) SELECT id, a AS start, b AS "end", gap FROM r WHERE nth = 1""",
}
