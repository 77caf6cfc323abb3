"""Queries of the reading operators, on each user's events as words heard and levels, and on benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import readings, sync
from strandline.plans.clip_queries import HOUR, moments, verses
from strandline.plans.run_queries import USER, frames
from strandline.runtime import table

PIECES = ("a", "b", "ab", "the", "th", "e", "n", "an", "and", "er", "r", "s", "t", "st", "o", "on", "i", "in", "ing", "g", "h", "l", "ly", "y", "d", "w", "u", "f", "c", "m", "p", ".", ",")


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, n, w, start, end, m): words of a text of forty, mostly read onward, now and then again."""
    at = F.col("n") - F.when(F.col("event_type") == "error", 2).otherwise(0)
    return verses(spark, sf_dir).select("user_id", "event_id", "n", (at % 40).alias("w"), "start", "end", "m", "v", "event_type")


def uncut_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = heard(spark, sf_dir)
    licensed = words.where("v % 3 = 0").select("user_id", "w")
    cut = words.where("v % 5 = 0").select("user_id", "w")
    return readings.uncut_stops(words, USER, ["n"], "w", licensed, cut).select("user_id", "event_id", "w")


def long_breaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = heard(spark, sf_dir).where("n < 55")
    quiet = moments(spark, sf_dir).select("user_id", (F.col("m") - 4 * HOUR).alias("start"), (F.col("m") - HOUR).alias("end"))
    return readings.long_breaths(words, USER, ["n"], "w", quiet, 3 * HOUR, HOUR, 12 * HOUR).select("user_id", "w", "from", "to")


def unrushed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.without_rushed_runs(heard(spark, sf_dir).select("user_id", "event_id", "n", "w", "start", "end"), USER, "n", "w", 9 * HOUR).select("event_id", "start", "end")


def dip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readings.boundary_level(frames(spark, sf_dir), USER, "n", "v", [0.15, 0.2, 0.25, 0.3, 0.35, 0.4], 1, F.lit(14_000), 2, 12)
    return found.select("user_id", F.floor(F.col("share") * 100 + 0.5).cast("long").alias("percent"), "dips")


def join_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = frames(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("n").alias("target"))
    return readings.nearest_quietest(frames(spark, sf_dir), targets, USER, "n", "v", 6, 3, 1500).select("id", "cut")


def lull_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = frames(spark, sf_dir).where("event_type = 'error'").select("user_id", F.col("event_id").alias("id"), F.col("n").alias("pick"), (F.col("v") + 2500).alias("bar"))
    return readings.lulls(frames(spark, sf_dir), picks, USER, "n", "v").select("id", "start", "end")


def next_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.next_windows(frames(spark, sf_dir), USER, "n", "v", 120_000, 40_000).select("user_id", "keep", "last")


def chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = heard(spark, sf_dir).select("user_id", "n", "w", F.floor(F.col("w") / 10).alias("verse"), F.floor(F.col("w") / 4).alias("chunk"))
    return readings.units(words, USER, "n", "verse", "w", "chunk").select("user_id", F.col("unit").cast("long").alias("unit"), "verse", "first", "last")


def recited_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each benchmark item of which every third one was not shown, and every fifth one shown shortened."""
    words = F.slice(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), 1, 30)
    shown = F.filter(F.transform(words, lambda w, i: F.when(i % 3 == 2, F.lit("")).when(i % 5 == 1, F.substring(w, 1, 3)).otherwise(w)), lambda w: w != "")
    said = readings.recited(words, shown)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(said, lambda s: s.cast("int").cast("string")), "").alias("said"))


def vocabulary_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = readings.longest_pieces(F.lower(F.coalesce("text", F.lit(""))), PIECES)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(pieces, "|").alias("pieces"))


def misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between the line numbers of an order by part and by price."""
    line = F.struct("l_partkey", "l_linenumber"), F.struct("l_extendedprice", "l_linenumber")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.array_sort(F.collect_list(x)).alias(name) for name, x in zip(("a", "b"), line, strict=True)])
    number = lambda c: F.transform(c, lambda r: r["l_linenumber"])
    return lists.select("l_orderkey", readings.misfit(number("a"), number("b")).cast("long").alias("edits"))


def shown_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    drawn = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "words").otherwise("text").alias("source"))
    return readings.shown_ids(chosen, drawn, "id")


def sampled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.sampled(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 25, "seed")


def added_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verses(spark, sf_dir).select("user_id", "n", "start", "end")
    return readings.added_after(rows, USER, "n", 3, 12 * HOUR).select("user_id", "n", "start", "end", "added")


def credited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts an order asks for, where the catalogue knows them and something of them is drawn."""
    chosen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("f")).distinct()
    drawn = chosen.select("id", F.when(F.col("f") == "N", "words").otherwise("text").alias("source"))
    shown = readings.shown_ids(chosen.select("o", "id").distinct(), drawn, "id")
    return sync.options_in_order(shown, ["o"], table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id", "name")


QUERIES = {f.__name__: f for f in (
    uncut_stops, long_breaths, unrushed_words, dip_levels, join_cuts, lull_spans, next_windows, chunk_units, recited_words, vocabulary_pieces, misfits, shown_editions, credited_names, sampled_parts, added_verses,
)}

_E = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) - 1704067200000 AS m, event_id, event_type FROM events),
  s AS (SELECT *, m AS a, m + coalesce(CAST(floor((lead(m) OVER (PARTITION BY user_id ORDER BY n) - m) * 6 / 10) AS BIGINT), 1000) AS b FROM e), h AS (SELECT *, (n - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) % 40 AS w FROM s)"""
_EITHER = "|".join(p.replace(".", "[.]") for p in sorted(PIECES, key=lambda p: (-len(p), p)))

ORACLES = {
    "uncut_stops": f"WITH {_E} SELECT x.user_id, x.event_id, x.w FROM h x JOIN h y ON y.user_id = x.user_id AND y.n = x.n - 1 AND y.w = x.w - 1 WHERE EXISTS (SELECT 1 FROM h z WHERE z.user_id = x.user_id AND z.w = x.w - 1 AND z.v % 3 = 0) AND NOT EXISTS (SELECT 1 FROM h z WHERE z.user_id = x.user_id AND z.w = x.w AND z.v % 5 = 0)",
    "long_breaths": f"""WITH {_E}, g AS (SELECT *, count(*) OVER (PARTITION BY user_id, w) AS c FROM h WHERE n < 55), p AS (SELECT x.user_id, x.w, y.b AS f, x.a AS t FROM g x JOIN g y ON y.user_id = x.user_id AND y.n = x.n - 1 AND y.w = x.w - 1 WHERE x.c = 1 AND y.c = 1 AND x.a - y.b >= 10800000)
      SELECT user_id, w, f AS "from", t AS "to" FROM p WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = p.user_id AND least(m - 3600000, t) - greatest(m - 14400000, f) >= 3600000)""",
    "unrushed_words": f"""WITH {_E}, i AS (SELECT *, w - n AS d FROM h), k AS (SELECT *, sum(CASE WHEN d = was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY n) AS was FROM i)),
      r AS (SELECT user_id, run, min(n) AS first, max(n) AS last, count(*) >= 2 AND (max(a) - min(a)) / (count(*) - 1) < 32400000 AS rushed, max(b) AS b FROM k GROUP BY user_id, run),
      u AS (SELECT k.*, (SELECT max(z.last) FROM r z WHERE z.user_id = k.user_id AND NOT z.rushed AND z.last <= k.n) AS last_kept, r.rushed FROM k JOIN r ON r.user_id = k.user_id AND r.run = k.run),
      t AS (SELECT user_id, last_kept, max(b) AS reach FROM u WHERE rushed AND last_kept IS NOT NULL GROUP BY 1, 2) SELECT u.event_id, u.a AS start, greatest(u.b, coalesce(t.reach, u.b)) AS "end" FROM u LEFT JOIN t ON t.user_id = u.user_id AND t.last_kept = u.n WHERE NOT u.rushed""",
    "dip_levels": f"""WITH {_E}, q AS (SELECT user_id, unnest([0.15, 0.2, 0.25, 0.3, 0.35, 0.4]) AS p, unnest(quantile_cont(v, [0.15, 0.2, 0.25, 0.3, 0.35, 0.4])) AS line, count(*) AS size FROM e GROUP BY user_id),
      f AS (SELECT e.user_id, p, n, v, v < line AS ok FROM e JOIN q USING (user_id)), g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, p ORDER BY n) AS run FROM f), i AS (SELECT user_id, p, min(n) AS a, max(n) + 1 AS b FROM g WHERE ok GROUP BY user_id, p, run),
      j AS (SELECT *, lag(b) OVER (PARTITION BY user_id, p ORDER BY a) AS was FROM i), k AS (SELECT *, sum(CASE WHEN a - was <= 1 AND (SELECT max(v) FROM e WHERE e.user_id = j.user_id AND e.n >= was AND e.n < a) < 14000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, p ORDER BY a) AS isle FROM j),
      d AS (SELECT user_id, p, isle FROM k GROUP BY 1, 2, 3 HAVING sum(b - a) >= 2), c AS (SELECT q.user_id, q.p, size, count(isle) AS dips FROM q LEFT JOIN d ON d.user_id = q.user_id AND d.p = q.p GROUP BY 1, 2, 3),
      o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN dips * 12 >= size THEN 0 ELSE 1 END, CASE WHEN dips * 12 >= size THEN p END, dips DESC, p) AS r FROM c) SELECT user_id, CAST(floor(p * 100 + 0.5) AS BIGINT) AS percent, dips FROM o WHERE r = 1""",
    "join_cuts": f"""WITH {_E}, t AS (SELECT user_id, event_id AS id, n AS t FROM e WHERE event_type = 'purchase'), w AS (SELECT t.id, t.t, e.n, e.v, min(e.v) OVER (PARTITION BY t.id) AS lo FROM t JOIN e ON e.user_id = t.user_id AND e.n BETWEEN t.t - 6 AND t.t + 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(n - t), n) AS k FROM w WHERE v <= lo + 1500) SELECT id, n AS cut FROM r WHERE k = 1""",
    "lull_spans": f"""WITH {_E}, p AS (SELECT user_id, event_id AS id, n AS x, v + 2500 AS bar FROM e WHERE event_type = 'error') SELECT id, coalesce((SELECT max(n) + 1 FROM e WHERE e.user_id = p.user_id AND n < x AND v > bar), 0) AS start,
      coalesce((SELECT min(n) FROM e WHERE e.user_id = p.user_id AND n > x AND v > bar), (SELECT max(n) + 1 FROM e WHERE e.user_id = p.user_id)) AS "end" FROM p""",
    "next_windows": f"""WITH {_E}, c AS (SELECT user_id, n, sum(v) OVER (PARTITION BY user_id ORDER BY n) AS s, max(n) OVER (PARTITION BY user_id) AS z FROM e), k AS (SELECT user_id, coalesce(min(CASE WHEN s >= 120000 THEN n END), max(z)) AS keep FROM c GROUP BY user_id), q AS (SELECT k.user_id, keep, s AS ks FROM k JOIN c ON c.user_id = k.user_id AND c.n = keep)
      SELECT q.user_id, keep, coalesce(min(CASE WHEN n > keep AND s - ks >= 40000 THEN n END), max(z)) AS last FROM q JOIN c ON c.user_id = q.user_id GROUP BY q.user_id, keep""",
    "chunk_units": f"""WITH {_E}, x AS (SELECT user_id, n, w, CAST(floor(w / 10) AS BIGINT) AS verse, CAST(floor(w / 4) AS BIGINT) AS chunk FROM h), y AS (SELECT *, lag(w) OVER q AS pw, lag(verse) OVER q AS pv, lag(chunk) OVER q AS pc FROM x WINDOW q AS (PARTITION BY user_id ORDER BY n)),
      z AS (SELECT *, sum(CASE WHEN pw + 1 = w AND pv = verse AND pc = chunk THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) - 1 AS unit FROM y) SELECT user_id, CAST(unit AS BIGINT) AS unit, verse, min(w) AS first, max(w) AS last FROM z GROUP BY user_id, unit, verse""",
    "recited_words": """WITH RECURSIVE w AS (SELECT item_id, list_slice(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), 1, 30) AS w FROM benchmark), x AS (SELECT item_id, w, list_filter([CASE WHEN k % 3 = 0 THEN '' WHEN k % 5 = 2 THEN left(w[k], 3) ELSE w[k] END for k in range(1, len(w) + 1)], lambda y: y <> '') AS d FROM w),
      g AS (SELECT item_id, w, d, 0 AS k, 0 AS i, '' AS said FROM x UNION ALL
        SELECT item_id, w, d, k + 1, coalesce(f, i), said || CASE WHEN w[k + 1] = '' OR f IS NOT NULL THEN '1' ELSE '0' END FROM (SELECT *, CASE WHEN w[k + 1] = '' THEN NULL
          WHEN d[i + 1] = w[k + 1] OR (length(w[k + 1]) >= 3 AND length(d[i + 1]) >= 3 AND (contains(d[i + 1], w[k + 1]) OR contains(w[k + 1], d[i + 1]))) THEN i + 1
          WHEN d[i + 2] = w[k + 1] OR (length(w[k + 1]) >= 3 AND length(d[i + 2]) >= 3 AND (contains(d[i + 2], w[k + 1]) OR contains(w[k + 1], d[i + 2]))) THEN i + 2
          WHEN d[i + 3] = w[k + 1] OR (length(w[k + 1]) >= 3 AND length(d[i + 3]) >= 3 AND (contains(d[i + 3], w[k + 1]) OR contains(w[k + 1], d[i + 3]))) THEN i + 3 END AS f FROM g WHERE k < len(w)))
      SELECT item_id, said FROM g WHERE k = len(w)""",
    "vocabulary_pieces": rf"WITH t AS (SELECT item_id, regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g') AS bare, regexp_extract_all(lower(coalesce(text, '')), '{_EITHER}') AS p FROM benchmark) SELECT item_id, CASE WHEN length(array_to_string(p, '')) = length(bare) THEN array_to_string(p, '|') END AS pieces FROM t",
    "misfits": "SELECT l_orderkey, levenshtein(string_agg(chr(97 + l_linenumber), '' ORDER BY l_partkey, l_linenumber), string_agg(chr(97 + l_linenumber), '' ORDER BY l_extendedprice, l_linenumber)) AS edits FROM lineitem GROUP BY l_orderkey",
    "shown_editions": "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')",
    "credited_names": "SELECT DISTINCT l_orderkey AS o, l_partkey AS id, coalesce(p_name, CAST(l_partkey AS VARCHAR)) AS name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'N')",
    "sampled_parts": "SELECT p_partkey, p_name FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || 'seed'), p_partkey LIMIT 25",
    "added_verses": f"""WITH {_E}, x AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY n) AS nx FROM s), y AS (SELECT *, coalesce(nx, b + 43200000) - b >= 43200000 AS room, CAST(floor((a + b) / 2) AS BIGINT) AS mid FROM x)
      SELECT user_id, n, a AS start, CASE WHEN n = 3 AND NOT room THEN mid ELSE b END AS "end", false AS added FROM y UNION ALL SELECT user_id, n, CASE WHEN room THEN b ELSE mid END, CASE WHEN room THEN coalesce(nx, b + 43200000) ELSE b END, true FROM y WHERE n = 3""",
}
