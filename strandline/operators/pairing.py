"""Lining up lists inside a row, as column expressions: tokens with words, words with chunks, and seeded orders.

Lists are folded in the JVM; nothing here is a function of Python rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import fnv_hash

#: Words that one chunk covers at most.
MOST_JOINED = 7
#: Fixed values of the seeded order: a 32-bit FNV-1a hash starts a linear generator modulo 2^32.
FNV_START, FNV_PRIME, STEP_FACTOR, STEP_SUM, WORD = 0x811C9DC5, 0x01000193, 1664525, 1013904223, 0xFFFFFFFF


def _ends(items: Column) -> Column:
    """Where each text of a list ends in all of them written together."""
    return F.aggregate(items, F.array().cast("array<int>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + F.length(x))))


def paired_tokens(words: Column, tokens: Column) -> Column:
    """For each word the tokens that spell it, joined by blanks; null unless every word ends where a token ends.

    Both lists are laid out by their ends in the common text, so a token belongs to the word whose end is the
    first at or after its own. Empty texts spell nothing: a list that holds one gives null.
    """
    stops, cuts = _ends(words), _ends(tokens)
    numbered = F.arrays_zip(tokens.alias("token"), cuts.alias("stop"))

    def spelled(stop: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(stops, i - 1))
        own = F.filter(numbered, lambda t: (t["stop"] > start) & (t["stop"] <= stop))
        return F.array_join(F.transform(own, lambda t: t["token"]), " ")

    blank = lambda items: F.exists(items, lambda x: F.length(x) == 0)
    fits = (F.array_join(words, "") == F.array_join(tokens, "")) & (F.size(F.array_except(stops, cuts)) == 0) & ~blank(words) & ~blank(tokens)
    return F.when(fits, F.transform(stops, spelled))


def chunk_sizes(words: Column, chunks: Column, most: int = MOST_JOINED) -> Column:
    """How many words each chunk covers, one to `most`, so that all words are covered with the fewest edits in all.

    Chunks are folded one by one over the cheapest covers of every number of first words, each with its sizes. Of
    equally cheap covers the one whose last chunk is longest stays, then the one before it. Null where none fits.
    """
    state = "array<struct<cost:int,short:int,sizes:array<int>>>"
    count = F.size(words)
    start = F.transform(F.sequence(F.lit(0), count), lambda i: F.when(i == 0, F.struct(F.lit(0).alias("cost"), F.lit(0).alias("short"), F.array().cast("array<int>").alias("sizes")))).cast(state)

    def step(covers: Column, chunk: Column) -> Column:
        def extended(i: Column) -> Column:
            def by(k: Column) -> Column:
                before = F.get(covers, i - k)
                cost = before["cost"] + F.levenshtein(F.array_join(F.slice(words, i - k + 1, k), ""), chunk)
                return F.when(before.isNotNull(), F.struct(cost.alias("cost"), (-k).alias("short"), F.concat(before["sizes"], F.array(k)).alias("sizes")))

            return F.when(i > 0, F.array_min(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.greatest(i, F.lit(1)))), by)))

        return F.transform(F.sequence(F.lit(0), count), extended).cast(state)

    return F.get(F.aggregate(chunks, start, step), count)["sizes"]


def seeded_order(items: Column, seed: Column) -> Column:
    """The items shuffled by a seed: from the last place down each swaps with one that the generator names."""
    whole = F.lit(WORD).cast("long")
    begin = fnv_hash(seed, FNV_START, FNV_PRIME)
    size = F.size(items)

    def swap(now: Column, i: Column) -> Column:
        state = (now["state"] * STEP_FACTOR + STEP_SUM).bitwiseAND(whole)
        j = (state % (i + 1)).cast("int")
        swapped = F.transform(now["order"], lambda x, k: F.when(k == i, F.get(now["order"], j)).when(k == j, F.get(now["order"], i)).otherwise(x))
        return F.struct(state.alias("state"), swapped.alias("order"))

    done = F.aggregate(F.sequence(F.greatest(size - 1, F.lit(1)), F.lit(1), F.lit(-1)), F.struct(begin.alias("state"), items.alias("order")), swap)
    return F.when(size < 2, items).otherwise(done["order"])
