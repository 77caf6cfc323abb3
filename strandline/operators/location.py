"""Locating phrases in a corpus: n-gram candidate votes, capped, then compared by similarity ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _words(text: str):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(df: DataFrame, key: str, text: str) -> DataFrame:
    w = df.select(F.col(key).alias("id"), _words(text).alias("w"))
    beside = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("c"))
    return w.select("id", F.posexplode(beside).alias("pos", "g")).where(F.col("g.c").isNotNull()).select("id", "pos", F.xxhash64("g.a", "g.b", "g.c").alias("gram"))


def candidate_votes(phrases: DataFrame, corpus: DataFrame, phrase_key: str, corpus_key: str, cap: int | None = 40) -> DataFrame:
    """item, doc, start, votes: where each phrase may start, the best `cap` starts of each phrase, or all of them."""
    asked = _grams(phrases, phrase_key, "text").withColumnsRenamed({"id": "item", "pos": "at"})
    held = _grams(corpus, corpus_key, "text").withColumnRenamed("id", "doc")
    votes = held.join(asked, "gram").groupBy("item", "doc", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))
    if cap is None:
        return votes
    order = Window.partitionBy("item").orderBy(F.desc("votes"), "doc", "start")
    return votes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("place")


def located(phrases: DataFrame, corpus: DataFrame, phrase_key: str, corpus_key: str, least: float = 0.6, cap: int | None = 40) -> DataFrame:
    """item, doc, start, ratio: the best place of each phrase by similarity of words, at least `least`."""
    votes = candidate_votes(phrases, corpus, phrase_key, corpus_key, cap)
    asked = phrases.select(F.col(phrase_key).alias("item"), _words("text").alias("p"))
    held = corpus.select(F.col(corpus_key).alias("doc"), _words("text").alias("w"))
    window = F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), F.greatest(F.size("p"), F.lit(1)))
    pairs = votes.join(asked, "item").join(held, "doc").select("item", "doc", "start", "p", window.alias("w"))

    def ratio(parts):
        for rows in parts:
            values = [SequenceMatcher(None, list(p), list(w)).ratio() for p, w in zip(rows["p"], rows["w"], strict=True)]
            yield pd.DataFrame({"item": rows["item"], "doc": rows["doc"], "start": rows["start"], "ratio": values})

    scored = pairs.mapInPandas(ratio, "item long, doc long, start int, ratio double").where(F.col("ratio") >= least)
    order = Window.partitionBy("item").orderBy(F.desc("ratio"), "doc", "start")
    return scored.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
