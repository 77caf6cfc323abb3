"""Benchmark decontamination over a distributed positional inverted index, DataFrame functions only.

The index holds postings (term, document, position) of the corpus, for the terms that are looked up. Terms of the
benchmark are counted over the whole corpus; each window of 13 words of an item is looked up by its two rarest terms.
Windows that overlap mostly share both terms and their distance, so these pairs are intersected once: the
postings of the rarer term, moved by the distance, are joined to those of the other one. What is left proposes where
windows start, and only the documents of these proposals are read again, to compare the phrases word by
word. The same postings answer proximity: both terms within so many words of one another, in any order.

Null and empty texts have no words, match nothing and are not contaminated; null item texts are
no items. Rows of equal id and text get equal results; equal windows of several items hit for each
of them; with an empty benchmark nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.word_rows import BROADCAST_TERMS, keyed, lower_ascii, only_terms, words
from strandline.runtime import materialize

WINDOW = 13
#: Words between two terms that still stand near one another.
NEAR = WINDOW - 1


def _few(df: DataFrame) -> DataFrame:
    """A written frame, sent to every executor where its counted rows allow that."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def windows(items: DataFrame, item_key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item, phrase): all windows of all items; an item of fewer words is one window."""
    w = items.select(F.col(item_key).alias("item"), F.transform(words(F.col(text)), lower_ascii).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    phrases = w.select("item", F.explode(starts).alias("start"), "w").select("item", F.slice("w", F.col("start"), F.lit(size)).alias("phrase")).distinct()
    return phrases.withColumn("window", F.xxhash64(F.concat_ws(" ", "phrase")))


def postings(documents: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, body, pos): where the terms (one column, `term`, written before) stand in the whole corpus."""
    folded = materialize(terms.select(F.lower("term").alias("low")).distinct(), "benchmark-folded")
    each = keyed(documents, key, text).select("doc", "body", F.posexplode("words").alias("pos", "word")).withColumn("low", F.lower("word"))
    found = only_terms(each, folded).select(lower_ascii(F.col("word")).alias("term"), "doc", "body", "pos")
    return found.join(_few(terms), "term", "left_semi")


def term_counts(documents: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, n): how often each benchmark term occurs in the whole corpus, 0 included."""
    terms = materialize(phrases.select(F.explode("phrase").alias("term")).distinct(), "benchmark-terms")
    counted = postings(documents, terms, key, text).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rarest_terms(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, phrase, term, at, second, distance): each window's two rarest terms, the offset of the first and how far on the second stands.

    Of equally rare terms the smaller one, then the earlier one. A window of one word has no second term.
    """
    each = phrases.select("window", "phrase").distinct().select("window", "phrase", F.posexplode("phrase").alias("at", "term"))
    order = Window.partitionBy("window").orderBy("n", "term", "at")
    ranked = each.join(_few(counts), "term").withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    of = lambda rank, column: F.min(F.when(F.col("rank") == rank, F.col(column)))
    both = ranked.groupBy("window").agg(F.first("phrase").alias("phrase"), of(1, "term").alias("term"), of(1, "at").alias("at"), of(2, "term").alias("second"), (of(2, "at") - of(1, "at")).alias("distance"))
    return both


def intersected(posted: DataFrame, rarest: DataFrame) -> DataFrame:
    """(term, second, distance, doc, body, pos): places of the rarer term that have the second one at its distance.

    Each pair of terms and distance is intersected once, however many windows share it; windows of one word are the
    places of their term.
    """
    pairs = materialize(rarest.select("term", "second", "distance").distinct(), "benchmark-pairs")
    moved = posted.join(_few(pairs), "term").withColumn("there", F.col("pos") + F.coalesce("distance", F.lit(0)))
    alone = moved.where(F.col("second").isNull())
    others = posted.select(F.col("term").alias("second"), F.col("doc").alias("other_doc"), F.col("body").alias("body"), F.col("pos").alias("there"))
    # a null id is a document too; ids are told apart by the condition, texts by the key
    met = moved.where(F.col("second").isNotNull()).join(others, ["second", "body", "there"]).where(F.col("doc").eqNullSafe(F.col("other_doc")))
    columns = ["term", "second", "distance", "doc", "body", "pos"]
    return met.select(*columns).unionByName(alone.select(*columns))


def phrase_matches(documents: DataFrame, met: DataFrame, rarest: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, window, start, size): exact occurrences of windows, proposed by intersected postings.

    Windows of one or two words are decided by the postings; for longer ones the documents that have proposals are
    read again, and no others.
    """
    same = met["term"].eqNullSafe(rarest["term"]) & met["second"].eqNullSafe(rarest["second"]) & met["distance"].eqNullSafe(rarest["distance"])
    proposed = met.join(_few(rarest), same).select("doc", "body", "window", (F.col("pos") - F.col("at")).alias("start"), "phrase").where("start >= 0")
    proposed = materialize(proposed.distinct(), "benchmark-proposed")
    short = proposed.where(F.size("phrase") <= 2).select("doc", "body", "window", "start", F.size("phrase").alias("size"))
    long = proposed.where(F.size("phrase") > 2)
    asked = materialize(long.select(F.col("doc").alias("asked_doc"), F.col("body").alias("asked_body")).distinct(), "benchmark-asked")
    known = documents.select(F.col(key).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    again = known.join(_few(asked), (F.col("body") == F.col("asked_body")) & F.col("doc").eqNullSafe(F.col("asked_doc")), "left_semi").dropDuplicates(["doc", "body"])
    read = again.select(F.col("doc").alias("read_doc"), F.col("body").alias("read_body"), F.transform(words(F.col("text")), lower_ascii).alias("w"))
    compared = long.join(read, (F.col("body") == F.col("read_body")) & F.col("doc").eqNullSafe(F.col("read_doc")))
    exact = compared.where(F.slice("w", (F.col("start") + 1).cast("int"), F.size("phrase")) == F.col("phrase"))
    return exact.select("doc", "body", "window", "start", F.size("phrase").alias("size")).unionByName(short)


def proximity_matches(posted: DataFrame, rarest: DataFrame, within: int = NEAR) -> DataFrame:
    """(doc, body, term, second): pairs of terms that stand within so many words of one another somewhere in a document.

    Positions are dealt over cells as wide as the distance, so each place meets only its own and the two cells beside it. A
    window of one word is near wherever its term stands.
    """
    pairs = materialize(rarest.select("term", "second").distinct(), "benchmark-near-pairs")
    here = posted.join(_few(pairs), "term")
    cell = F.floor(F.col("pos") / (within + 1))
    asked = here.where(F.col("second").isNotNull()).select("term", "second", "doc", "body", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    others = posted.select(F.col("term").alias("second"), F.col("doc").alias("other_doc"), "body", F.col("pos").alias("there"), cell.alias("cell"))
    gap = F.abs(F.col("pos") - F.col("there"))
    met = asked.join(others, ["second", "body", "cell"]).where((gap > 0) & (gap <= within) & F.col("doc").eqNullSafe(F.col("other_doc")))
    return met.select("doc", "body", "term", "second").unionByName(here.where(F.col("second").isNull()).select("doc", "body", "term", "second")).distinct()


def _items(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, body, item), from rows that name a window."""
    return found.select("doc", "body", "window").distinct().join(_few(phrases.select("window", "item")), "window").select("doc", "body", "item").distinct()


def _covered(spans: Column) -> Column:
    """Words covered by spans in order, each adding what lies beyond the last end."""
    beyond = lambda a, s: F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))
    step = lambda a, s: F.struct((a["n"] + beyond(a, s)).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def verdicts(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, share: int = 20, near: bool = False) -> DataFrame:
    """doc_id, body, n_words, n_hit, n_items, items_sha256, contaminated of every row; id and body tell texts apart.

    With `near` also n_near: items of which a window's two rarest terms stand near one another.
    """
    phrases = materialize(windows(benchmark, size=size), "benchmark-windows")
    rarest = materialize(rarest_terms(phrases, materialize(term_counts(documents, phrases, key, text), "benchmark-counts")), "benchmark-rarest")
    terms = materialize(rarest.select("term").union(rarest.select("second")).where("term IS NOT NULL").distinct(), "benchmark-looked-up")
    posted = materialize(postings(documents, terms, key, text), "benchmark-postings")
    matches = materialize(phrase_matches(documents, intersected(posted, rarest), rarest, key, text), "benchmark-matches")
    spans = matches.groupBy("doc", "body").agg(F.array_sort(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size")).cast("int").alias("end")))).alias("spans"))
    names = _items(matches, phrases).groupBy("doc", "body").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"), F.countDistinct(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("n_items"))
    found = [spans.select("doc", "body", _covered(F.col("spans")).alias("n_hit")), names]
    if near:
        pairs = proximity_matches(posted, rarest)
        same = pairs["term"].eqNullSafe(rarest["term"]) & pairs["second"].eqNullSafe(rarest["second"])
        found.append(_items(pairs.join(_few(rarest), same).select("doc", "body", "window"), phrases).groupBy("doc", "body").agg(F.count("*").alias("n_near")))
    out = keyed(documents, key, text).select("doc", "body", F.size("words").cast("long").alias("n_words"))
    for frame in found:
        side = frame.withColumnsRenamed({"doc": "hit_doc", "body": "hit_body"})
        out = out.join(side, out["doc"].eqNullSafe(side["hit_doc"]) & (out["body"] == side["hit_body"]), "left").drop("hit_doc", "hit_body")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("doc").alias(key),
        "body",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if near else []),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row."""
    return verdicts(documents, benchmark, key, text, size, share, near=True).drop("body")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)
), hits AS (SELECT doc_id, item_id, s, p.size FROM places p JOIN wins USING (size, phrase)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d), counts AS (SELECT term, count(*) AS n FROM pos GROUP BY term),
terms AS (SELECT item_id, phrase, unnest(string_split(phrase, ' ')) AS term, generate_subscripts(string_split(phrase, ' '), 1) AS spot FROM wins),
ranked AS (SELECT terms.*, row_number() OVER (PARTITION BY item_id, phrase ORDER BY coalesce(n, 0), term, spot) AS k FROM terms LEFT JOIN counts USING (term)),
pairs AS (SELECT item_id, max(CASE WHEN k = 1 THEN term END) AS a, max(CASE WHEN k = 2 THEN term END) AS b FROM ranked WHERE k <= 2 GROUP BY item_id, phrase),
meets AS (SELECT DISTINCT x.doc_id, a, b FROM (SELECT DISTINCT a, b FROM pairs) JOIN pos x ON x.term = a LEFT JOIN pos y ON y.doc_id = x.doc_id AND y.term = b AND y.p <> x.p AND abs(y.p - x.p) <= 12 WHERE b IS NULL OR y.p IS NOT NULL),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM meets JOIN pairs ON pairs.a = meets.a AND pairs.b IS NOT DISTINCT FROM meets.b GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
