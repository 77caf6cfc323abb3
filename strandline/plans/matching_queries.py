"""Queries of the matching and pairing operators, on benchmark texts, turns of conversations and names of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import matching, pairing
from strandline.runtime import ship_package, table


def _words(text: str):
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _pieces(text, size):
    """The text in pieces of `size` letters."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size) - 1, F.lit(0)))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * size + 1, size))).otherwise(F.array().cast("array<string>"))


def range_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's middle words, every fourth one misheard, in the item itself; keys are stretches of nine words."""
    ship_package(spark)
    items = table(spark, sf_dir, "benchmark").select("item_id", _words("text").alias("w"))
    heard = F.transform(F.slice("w", F.greatest(F.floor(F.size("w") / 2), F.lit(1)).cast("int"), 8), lambda w, i: F.when(i % 4 == 3, F.lit("?")).otherwise(w))
    phrases = items.select(F.col("item_id").alias("id"), F.col("item_id").alias("passage"), heard.alias("heard"), (F.col("item_id") % 7).cast("int").alias("cursor"))
    words = items.select(F.col("item_id").alias("passage"), F.posexplode("w").alias("place", "word")).withColumn("key", F.floor(F.col("place") / 9))
    found = matching.located_phrases(phrases, words, near=10, least=0.3)
    return found.select("id", "start", "stop", F.floor(F.col("score") * 10_000 + 0.5).cast("long").alias("score"))


def unheard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each benchmark item that neither of two garbled readings carries."""
    ship_package(spark)
    readings = F.array(F.regexp_replace("text", "[aeiou]h?", ""), F.regexp_replace("text", r"th\S*", ""))
    rows = table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull()).select(F.col("item_id").alias("id"), _words("text").alias("words"), readings.alias("readings"))
    return matching.unheard_words(rows)


def turn_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each turn says what the one before said, over each conversation."""
    from pyspark.sql import Window

    ship_package(spark)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order)).where("before IS NOT NULL")
    return matching.agreements(turns.select("conv_id", _words("text").alias("decoded"), _words("before").alias("placed")), "conv_id")


def paired_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut into pieces of one to five letters: the pieces of each word, where words end with pieces."""
    bare = F.replace("p_name", F.lit(" "))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), _pieces(bare, F.col("p_size") % 5 + 1).alias("t"))
    return rows.select("p_partkey", F.array_join(pairing.paired_tokens(F.col("w"), F.col("t")), "|").alias("spelled"))


def chunk_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each piece of sixteen letters covers, in every benchmark item, with some letters misheard."""
    plain = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "x").alias("text"))  # engines count edits of other letters differently
    bare = F.translate(F.regexp_replace("text", r"\s+", ""), "eo", "au")
    rows = plain.select("item_id", _words("text").alias("w"), _pieces(bare, F.lit(16)).alias("c"))
    sizes = pairing.chunk_sizes(F.col("w"), F.col("c"))
    return rows.select("item_id", F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


def seeded_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each part's type, in the order that its brand and key name."""
    seed = F.concat_ws("-", "p_brand", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(pairing.seeded_order(F.split("p_type", ""), seed), "").alias("letters"))


QUERIES = {f.__name__: f for f in (range_matches, unheard_words, turn_agreements, paired_pieces, chunk_covers, seeded_letters)}

ORACLES = {
    "paired_pieces": """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_size % 5 + 1 AS k FROM part)
      SELECT p_partkey, CASE WHEN len(list_filter(w[1 : len(w) - 1], lambda x: length(x) % k <> 0)) = 0 THEN array_to_string([array_to_string([substr(x, i, k) FOR i IN range(1, length(x) + 1, k)], ' ') FOR x IN w], '|') END AS spelled FROM p""",
    "chunk_covers": r"""WITH RECURSIVE plain AS (SELECT item_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS text FROM benchmark), b AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w, translate(regexp_replace(coalesce(text, ''), '\s+', '', 'g'), 'eo', 'au') AS s FROM plain),
      c AS (SELECT item_id, w, [substr(s, i, 16) FOR i IN range(1, length(s) + 1, 16)] AS c FROM b),
      g AS (SELECT item_id, 0 AS j, 0 AS i, 0::BIGINT AS cost, []::BIGINT[] AS sizes FROM c UNION ALL
        SELECT g.item_id, g.j + 1, g.i + k, g.cost + levenshtein(array_to_string(c.w[g.i + 1 : g.i + k], ''), c.c[g.j + 1]) AS cost, list_append(g.sizes, k) FROM g JOIN c USING (item_id), range(1, 8) r(k) WHERE g.j < len(c.c) AND g.i + k <= len(c.w)
        QUALIFY row_number() OVER (PARTITION BY g.item_id, g.i + k ORDER BY g.cost + levenshtein(array_to_string(c.w[g.i + 1 : g.i + k], ''), c.c[g.j + 1]), k DESC) = 1)
      SELECT c.item_id, array_to_string(g.sizes, ',') AS sizes FROM c LEFT JOIN g ON g.item_id = c.item_id AND g.j = len(c.c) AND g.i = len(c.w)""",
    "seeded_letters": """WITH p AS (SELECT p_partkey, string_split(p_type, '') AS x, list_reduce([ord(u) FOR u IN string_split(p_brand || '-' || p_partkey, '')]::BIGINT[], lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM part),
      o AS (SELECT p_partkey, x, list_reduce([[i] FOR i IN range(len(x) - 1, 0, -1)]::BIGINT[][], lambda a, i: list_prepend((a[1] * 1664525 + 1013904223) & 4294967295,
        [CASE WHEN k = i[1] THEN a[((a[1] * 1664525 + 1013904223) & 4294967295) % (i[1] + 1) + 2] WHEN k = ((a[1] * 1664525 + 1013904223) & 4294967295) % (i[1] + 1) THEN a[i[1] + 2] ELSE a[k + 2] END FOR k IN range(len(a) - 1)]), list_prepend(h, range(1, len(x) + 1)::BIGINT[])) AS a FROM p)
      SELECT p_partkey, array_to_string([x[k] FOR k IN a[2:]], '') AS letters FROM o""",
}
