"""Queries of published titles, tags and descriptions, on parts as passages and their lines as captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import publish
from strandline.functions.text import hashtag
from strandline.operators import matching, pairing
from strandline.runtime import ship_package, table


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, surah, reference, author): some authors have very long names, some none."""
    last = F.col("p_partkey") % 50 + F.col("p_size") % 3
    author = F.trim(F.repeat(F.concat("p_type", F.lit(" ")), F.col("p_size") % 11))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", publish.reference(F.col("p_size"), F.col("p_partkey") % 50, last).alias("reference"), author.alias("author"))


def published_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    extras = pairing.seeded_order(F.array(*map(F.lit, publish.TITLE_TAGS)), F.concat_ws("|", "reference", "author"))
    rows = _passages(spark, sf_dir).withColumn("extras", extras)
    titled = publish.fitted_title(F.concat(F.lit("Surah "), "p_name", F.lit(" "), "reference"), F.col("author"), F.col("extras"))
    return rows.select("p_partkey", titled.alias("t")).select("p_partkey", "t.title", "t.truncated")


def published_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags under a limit that some parts' lists pass."""
    rows = _passages(spark, sf_dir)
    tags = F.array(F.lit("quran"), F.lit("holy quran"), F.lower(F.concat(F.lit("surah "), "p_name")), F.lower("p_name"), F.col("reference"), F.lower("author"), F.lit("islam"), F.lower("p_brand"), F.lit("shorts"))
    return rows.select("p_partkey", publish.kept_tags(tags, 110).alias("t")).select("p_partkey", F.array_join("t.tags", ", ").alias("tags"), "t.truncated")


def published_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a passage: its lines are the captions, a part shown twice stands once."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    block = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("key"), F.repeat(F.concat(F.coalesce("p_name", F.lit("")), F.lit(" ")), F.col("l_quantity").cast("int") % 4).alias("text"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    blocks = F.transform("blocks", lambda b: F.struct(b["key"].alias("key"), F.trim(b["text"]).alias("text")))
    made = publish.description(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")), blocks, F.lit("Text: public tables."), 120)
    return orders.select("l_orderkey", made.alias("d")).select("l_orderkey", "d.description", "d.truncated")


def name_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.concat_ws("/", "p_name", "p_brand", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", publish.fnv36(seed, pairing.FNV_START, pairing.FNV_PRIME).alias("digest"))


def page_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's text as one tag: letters and digits, accents dropped."""
    ship_package(spark)
    return table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", hashtag("text").alias("tag"))


def ordered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five words of each benchmark item, every fourth word misheard, found in the item in order."""
    ship_package(spark)
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), words.alias("words"))
    lines = rows.select("key", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size("words") - 5) / 5), F.lit(0)).cast("int"))).alias("nth"))
    wanted = F.transform(F.slice("words", F.col("nth") * 5 + 1, 5), lambda w, i: F.when((i + F.col("nth")) % 4 == 3, F.lit("?")).otherwise(w))
    return matching.ordered_windows(lines.select("key", "nth", wanted.alias("wanted"), "words"))


QUERIES = {f.__name__: f for f in (published_titles, published_tags, published_descriptions, name_digests, page_hashtags, ordered_windows)}

_P = """p AS (SELECT p_partkey, p_name, p_brand, p_size || ':' || (p_partkey % 50) || CASE WHEN p_size % 3 > 0 THEN '-' || (p_partkey % 50 + p_size % 3) ELSE '' END AS ref, trim(repeat(p_type || ' ', p_size % 11)) AS author FROM part)"""
ORACLES = {
    "published_titles": f"""WITH {_P}, h AS (SELECT *, list_reduce([ord(u) FOR u IN string_split(ref || '|' || author, '')]::BIGINT[], lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM p),
      x AS (SELECT *, CASE WHEN ((h * 1664525 + 1013904223) & 4294967295) % 2 = 0 THEN ['#BeautifulRecitation', '#Quran'] ELSE ['#Quran', '#BeautifulRecitation'] END AS e, 'Surah ' || p_name || ' ' || ref AS s, CASE WHEN author <> '' THEN ' | ' || author ELSE '' END AS a FROM h),
      w AS (SELECT p_partkey, [s || a || ' #Shorts ' || e[1] || ' ' || e[2], s || a || ' #Shorts ' || e[1], s || a || ' #Shorts', s || ' #Shorts'] AS w FROM x), c AS (SELECT p_partkey, w, coalesce(list_filter(w, lambda t: length(t) <= 100)[1], w[4]) AS t FROM w)
      SELECT p_partkey, CASE WHEN length(t) <= 100 THEN t ELSE rtrim(left(t, 99)) || '…' END AS title, t <> w[1] AS truncated FROM c""",
    "published_tags": f"""WITH RECURSIVE {_P}, t AS (SELECT p_partkey, list_filter(['quran', 'holy quran', lower('surah ' || p_name), lower(p_name), ref, lower(author), 'islam', lower(p_brand), 'shorts'], lambda x: x <> '') AS t FROM p),
      g AS (SELECT p_partkey, t, 0 AS k, 0::BIGINT AS used, []::VARCHAR[] AS kept, false AS cut FROM t UNION ALL SELECT p_partkey, t, k + 1, CASE WHEN used + length(t[k + 1]) + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END <= 110 THEN used + length(t[k + 1]) + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END ELSE used END,
        CASE WHEN used + length(t[k + 1]) + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END <= 110 THEN list_append(kept, t[k + 1]) ELSE kept END, cut OR used + length(t[k + 1]) + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END > 110 FROM g WHERE k < len(t)) SELECT p_partkey, array_to_string(kept, ', ') AS tags, cut AS truncated FROM g WHERE k = len(t)""",
    "published_descriptions": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, trim(repeat(coalesce(p_name, '') || ' ', l_quantity::INT % 4)) AS x, repeat(coalesce(p_name, '') || ' ', l_quantity::INT % 4) AS raw FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
      f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, raw) AS k FROM l), b AS (SELECT l_orderkey, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, raw) FILTER (k = 1 AND x <> ''), '') AS body FROM f GROUP BY l_orderkey),
      r AS (SELECT l_orderkey, body, 'Order ' || l_orderkey AS head, 120 - length('Order ' || l_orderkey) - 20 - 4 AS room FROM b), c AS (SELECT *, CASE WHEN length(body) > room THEN rtrim(left(body, room - 1), ' ' || chr(10)) || '…' ELSE body END AS fit FROM r)
      SELECT l_orderkey, head || chr(10) || chr(10) || CASE WHEN fit <> '' THEN fit || chr(10) || chr(10) ELSE '' END || 'Text: public tables.' AS description, length(body) > room AS truncated FROM c""",
    "name_digests": """WITH h AS (SELECT p_partkey, list_reduce([ord(u) FOR u IN string_split(p_name || '/' || p_brand || '/' || p_partkey, '')]::BIGINT[], lambda h, u: (xor(h, u) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM part)
      SELECT p_partkey, array_to_string([substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** k)::BIGINT) % 36 + 1)::INT, 1) FOR k IN [5, 4, 3, 2, 1, 0]], '') AS digest FROM h""",
    "page_hashtags": "SELECT item_id, regexp_replace(strip_accents(text), '[^A-Za-z0-9]', '', 'g') AS tag FROM benchmark WHERE text IS NOT NULL",
}
