"""Queries of the caption operators, on each user's events as words heard, with pauses around some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import captions
from strandline.plans.reading_queries import heard
from strandline.plans.run_queries import USER

MINUTE, HOUR = 60_000, 3_600_000
BARS = captions.Bars(
    shortest=30 * MINUTE, marked=1 * HOUR, unmarked=4 * HOUR, borderline=2 * HOUR, hesitation=2 * HOUR, hesitation_factor=1.5, restart=6 * HOUR,
    inset=90 * MINUTE, vowel_inset=3 * HOUR, joined=12 * HOUR, held_factor=1.5, reach=30 * MINUTE, near=20 * MINUTE,
)


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, n, verse, w, start, end, flags): words of verses of ten, of which some carry signs."""
    v = F.col("v")
    return heard(spark, sf_dir).select(
        "user_id", F.col("n").cast("long").alias("n"), F.floor(F.col("w") / 10).alias("verse"), "w", "start", "end", (v % 3 == 0).alias("mark"), (v % 11 == 0).alias("hanging"),
        (v % 4 == 1).alias("sustained"), (v % 6 == 0).alias("drops"), (F.col("event_type") == "purchase").alias("again"), "v",
    )


def _quiet(words: DataFrame) -> DataFrame:
    """A pause around the join of a word and the next, from well before its end to well after the next start."""
    after = F.lead("start").over(Window.partitionBy("user_id").orderBy("n"))
    edges = words.select("user_id", (F.col("end") + (F.col("v") % 7 - 4) * (30 * MINUTE)).alias("start"), (after + (F.col("v") % 5 - 3) * (30 * MINUTE)).alias("end"))
    return edges.where("end > start")


def _phrase_ends(words: DataFrame) -> DataFrame:
    return words.where("v % 2 = 0").select("user_id", "w", (F.col("end") + 15 * MINUTE).alias("at"))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spoken(spark, sf_dir)
    return captions.captions(words, _quiet(words), USER, BARS, 6 * HOUR, _phrase_ends(words))


def lone_word_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of the lines that are taken back, where nearly every join is a cut to begin with."""
    words = spoken(spark, sf_dir)
    easy = captions.Bars(**(vars(BARS) | {"marked": 0, "unmarked": 1 * HOUR, "held_factor": 1.0, "shortest": 0}))
    cut = captions.breaks(words, _quiet(words), USER, easy, 6 * HOUR)
    return captions.taken_back(cut, _quiet(words), USER, easy, 6 * HOUR)


QUERIES = {f.__name__: f for f in (caption_lines, lone_word_cuts)}


def _sql(bars: captions.Bars, phrase_ends: bool) -> str:
    """Common table expressions up to `cuts` and `back`, by correlated conditions on neighbours."""
    ended = f"EXISTS (SELECT 1 FROM x y WHERE y.user_id = p.user_id AND y.v % 2 = 0 AND y.w = x.w AND y.b + {15 * MINUTE} BETWEEN p.a - {bars.reach} AND p.b + {bars.reach})" if phrase_ends else "false"
    marked, unmarked, borderline = (max(bars.shortest, b * bars.scale) for b in (bars.marked, bars.unmarked, bars.borderline))
    stop = lambda c: f"(coalesce((SELECT max(q.b - q.a) FROM p q WHERE q.user_id = {c}.user_id AND q.b > {c}.b - {bars.inset} AND q.a < {c}.na + {bars.inset}), 0)::DOUBLE)"
    return f"""e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) - 1704067200000 AS a, event_type FROM events),
  f AS (SELECT *, a + coalesce(CAST(floor((lead(a) OVER (PARTITION BY user_id ORDER BY n) - a) * 6 / 10) AS BIGINT), 1000) AS b, (n - CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) % 40 AS w FROM e),
  g AS (SELECT *, CAST(floor(w / 10) AS BIGINT) AS verse, v % 3 = 0 AS mark, v % 11 = 0 AS hanging, v % 4 = 1 AS sustained, v % 6 = 0 AS drops, event_type = 'purchase' AS again FROM f),
  x0 AS (SELECT *, lead(verse) OVER o AS nverse, lead(w) OVER o AS nw, lead(a) OVER o AS na, lead(b) OVER o AS nb, lead(again) OVER o AS nagain, lead(w, 2) OVER o AS nnw, lead(a) OVER o - b AS gap FROM g WINDOW o AS (PARTITION BY user_id ORDER BY n)),
  u AS (SELECT user_id, list_sort(list(greatest(gap, 0))) AS l FROM x0 WHERE nverse = verse GROUP BY user_id),
  u2 AS (SELECT user_id, list_aggregate(l[1 : greatest(len(l) // 2, 1)], 'median') AS usual FROM u),
  x AS (SELECT x0.*, coalesce(verse = nverse AND nw = w + 1, false) AS joins, greatest({bars.hesitation}, {bars.hesitation_factor} * coalesce(usual, 0)) * {bars.scale} AS stop_gap FROM x0 LEFT JOIN u2 USING (user_id)),
  p AS (SELECT user_id, b + (v % 7 - 4) * {30 * MINUTE} AS a, na + (v % 5 - 3) * {30 * MINUTE} AS b FROM x WHERE na + (v % 5 - 3) * {30 * MINUTE} > b + (v % 7 - 4) * {30 * MINUTE}),
  r AS (SELECT p.*, (SELECT max(y.n) FROM x y WHERE y.user_id = p.user_id AND y.a <= p.a) AS n FROM p WHERE p.b - p.a >= {marked}),
  m AS (SELECT r.user_id, r.a, r.b, r.n + CASE WHEN x.nnw <= x.nw AND x.na >= r.a - {bars.near / 2} AND x.nb <= r.b + {bars.near / 2} THEN 1 ELSE 0 END AS n FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n),
  q AS (SELECT DISTINCT x.user_id, x.n FROM m p JOIN x ON x.user_id = p.user_id AND x.n = p.n WHERE x.na IS NOT NULL AND p.b >= x.b - CASE WHEN mark AND drops THEN {bars.vowel_inset} ELSE {bars.inset} END
    AND (x.na >= p.a - {bars.near} OR p.b <= x.b + {bars.near}) AND (mark OR NOT hanging)
    AND p.b - p.a >= CASE WHEN mark THEN {marked} WHEN gap >= stop_gap AND {ended} THEN {borderline} ELSE {unmarked} END * CASE WHEN sustained AND NOT mark AND gap <= {bars.joined} THEN {bars.held_factor} ELSE 1.0 END),
  c0 AS (SELECT x.*, na IS NULL OR verse <> nverse OR q.n IS NOT NULL OR (nw <= w AND (again OR nagain OR gap >= {bars.restart} OR EXISTS (SELECT 1 FROM p WHERE p.user_id = x.user_id AND p.b - p.a >= {bars.restart} AND p.a < x.nb AND p.b > x.a))) AS sure,
    coalesce(verse = nverse AND mark AND NOT sustained AND gap >= stop_gap, false) AS marked FROM x LEFT JOIN q ON q.user_id = x.user_id AND q.n = x.n),
  cuts AS (SELECT *, {stop('c0')} AS quiet, marked AND NOT sure AS on_mark, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM c0 WHERE sure OR marked),
  back AS (SELECT user_id, k, n AS held, joins, quiet, gap, NULL::BIGINT AS taken FROM cuts WHERE k = 1 UNION ALL
    SELECT c.user_id, c.k, CASE WHEN h.held = c.n - 1 AND h.joins AND c.joins AND NOT (h.quiet, h.gap) <= (c.quiet, c.gap) THEN h.held ELSE c.n END, CASE WHEN h.held = c.n - 1 AND h.joins AND c.joins AND NOT (h.quiet, h.gap) <= (c.quiet, c.gap) THEN h.joins ELSE c.joins END,
      CASE WHEN h.held = c.n - 1 AND h.joins AND c.joins AND NOT (h.quiet, h.gap) <= (c.quiet, c.gap) THEN h.quiet ELSE c.quiet END, CASE WHEN h.held = c.n - 1 AND h.joins AND c.joins AND NOT (h.quiet, h.gap) <= (c.quiet, c.gap) THEN h.gap ELSE c.gap END,
      CASE WHEN h.held = c.n - 1 AND h.joins AND c.joins THEN CASE WHEN (h.quiet, h.gap) <= (c.quiet, c.gap) THEN h.held ELSE c.n END END
    FROM back h JOIN cuts c ON c.user_id = h.user_id AND c.k = h.k + 1)"""


ORACLES = {
    "caption_lines": f"""WITH RECURSIVE {_sql(BARS, True)}, ends AS (SELECT * FROM cuts WHERE (user_id, n) NOT IN (SELECT user_id, taken FROM back WHERE taken IS NOT NULL)),
      l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) - 1 AS caption, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY n), -1) + 1 AS f, lag(w) OVER (PARTITION BY user_id ORDER BY n) AS before FROM ends)
      SELECT l.user_id, l.caption, s.verse, s.w AS first_w, l.w AS last_w, s.a AS start, l.b AS "end", l.on_mark AS to_check, coalesce(s.w <= l.before, false) AS restart FROM l JOIN x s ON s.user_id = l.user_id AND s.n = l.f""",
    "lone_word_cuts": f"WITH RECURSIVE {_sql(captions.Bars(**(vars(BARS) | {'marked': 0, 'unmarked': 1 * HOUR, 'held_factor': 1.0, 'shortest': 0})), False)} SELECT user_id, taken AS n FROM back WHERE taken IS NOT NULL",
}
