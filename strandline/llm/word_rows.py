"""Words of whole texts as rows, with DataFrame functions only.

A word is a run of ASCII letters, digits and non-ASCII characters; A-Z count as a-z and other
letters keep their case. Rows are told apart by id and text together, so repeated ids are safe.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that every executor may hold: some 50 MB.
BROADCAST_TERMS = 500_000
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words as written; lower_ascii() brings them to their compared form."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def lower_ascii(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, body, words): the id, a hash that tells texts apart, and the words."""
    return df.select(F.col(key).alias("doc"), F.xxhash64(text).alias("body"), words(F.col(text)).alias("words"))


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, body, words, pos, low): a row for each word; low also folds other letters, for prefilters."""
    return keyed(df, key, text).select("doc", "body", "words", F.posexplode("words").alias("pos", "word")).select("doc", "body", "words", "pos", F.lower("word").alias("low"))


def only_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose `low` is among the terms (one column, `low`, written before).

    Counted terms up to the bound go to every executor; beyond it both sides are shuffled by term.
    """
    few = terms.count() <= BROADCAST_TERMS
    return rows.join(F.broadcast(terms) if few else terms, "low", "left_semi")
