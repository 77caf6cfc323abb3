"""Finding what was heard in a reference text, as joins: shared words propose windows, bounds discard most, and
only the windows left are compared.

Similarity is that of `difflib.SequenceMatcher` (twice the matched length over both lengths); two small Arrow-batched
functions give it and its matching blocks, everything around them is a plan. Phrases are rows (id, passage,
heard, cursor), reference words are rows (passage, place, key, word), places count from 0 without gaps.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

BLOCKS = ArrayType(StructType([StructField("at", IntegerType()), StructField("size", IntegerType())]))
LONGEST, PENALTY = 22, 0.05


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two lists of words, 0 where either is empty."""
    return pd.Series([SequenceMatcher(None, list(x), list(y)).ratio() if len(x) and len(y) else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(BLOCKS)
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Stretches of the first text that the second one carries too, in order."""
    return pd.Series([[{"at": m.a, "size": m.size} for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size] for x, y in zip(a, b, strict=True)], dtype=object)


def _with_tails(words: DataFrame, longest: int) -> DataFrame:
    """words with `tail`, the last words up to each, `total` words of the passage, and `opens`, where the run of its key starts."""
    order = Window.partitionBy("passage").orderBy("place")
    changed = F.when(F.coalesce(F.lag("key").over(order) != F.col("key"), F.lit(True)), F.col("place"))
    marked = words.select("passage", "place", "word", changed.alias("changed"), F.collect_list("word").over(order.rowsBetween(1 - longest, 0)).alias("tail"), F.count("*").over(Window.partitionBy("passage")).alias("total"))
    return marked.withColumn("opens", F.last("changed", True).over(order)).drop("changed")


def window_bounds(phrases: DataFrame, words: DataFrame, longest: int = LONGEST, penalty: float = PENALTY) -> DataFrame:
    """id, start, stop, far, bound, window: every window of one key that starts at most `longest` words before a word
    that was heard and ends with it, and the most that its score can be.

    A window that ends with other words scores less than the same one without them, so none is missed that
    holds a word heard.
    """
    asked = phrases.where(F.size("heard") > 0).select("id", "passage", "cursor", F.size("heard").alias("n"), F.explode(F.array_distinct("heard")).alias("word"))
    hits = asked.join(_with_tails(words, longest), ["passage", "word"])
    near = Window.partitionBy("id").orderBy("place").rangeBetween(1 - longest, 0)
    starts = F.sequence(F.greatest(F.col("place") - (longest - 1), F.col("opens")), F.col("place"))
    each = hits.withColumn("hits", F.collect_list("place").over(near)).select("id", "cursor", "n", "total", "tail", "hits", F.col("place").alias("stop"), F.explode(starts).alias("start"))
    size = F.col("stop") - F.col("start") + 1
    far = F.lit(penalty) * F.least(F.abs(F.col("start") - F.col("cursor")), F.col("total")) / F.col("total")
    shared = F.least(F.col("n"), F.size(F.filter("hits", lambda p: p >= F.col("start"))))
    bound = F.lit(2.0) * shared / (F.col("n") + size) - far
    return each.select("id", "start", "stop", F.abs(F.col("start") - F.col("cursor")).alias("away"), far.alias("far"), bound.alias("bound"), F.slice("tail", -size, size).alias("window"))


def located_phrases(phrases: DataFrame, words: DataFrame, near: int | None = None, least: float = 0.0, longest: int = LONGEST) -> DataFrame:
    """id, start, stop and score of each phrase's best window: similarity less a little for the distance from the cursor.

    With `near` a window that starts so close to the cursor is taken if it has the least score; otherwise any. Of equal
    windows the first. Phrases that are empty, that share no word with their passage, or whose best window
    scores less are missing. A window is compared only if its bound reaches what the most promising one scores.
    """
    windows = window_bounds(phrases, words, longest).where(F.col("bound") >= least).withColumn("close", F.lit(False) if near is None else F.col("away") <= near)
    heard = phrases.select("id", "heard")
    promising = windows.groupBy("id", "close").agg(F.max_by(F.struct("window", "far"), F.struct("bound", -F.col("start"), -F.col("stop"))).alias("w"))
    reached = promising.join(heard, "id").select("id", "close", (similarity("heard", "w.window") - F.col("w.far")).alias("reached"))
    left = windows.join(reached, ["id", "close"]).where(F.col("bound") >= F.col("reached")).join(heard, "id")
    scored = left.select("id", "start", "stop", "close", (similarity("heard", "window") - F.col("far")).alias("score")).where(F.col("score") >= least)
    best = Window.partitionBy("id").orderBy(F.desc("close"), F.desc("score"), "start", "stop")
    # a close window of the least score goes before all others; closer ones below it are gone by now
    return scored.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("id", "start", "stop", "score")


def substring_match(rows: DataFrame) -> DataFrame:
    """Rows (id, target, heard) of two arrays: the stretch of `heard` with the fewest edits to the target.

    Columns start, stop (exclusive) and edits; the first stretch that ends first among equal ones.
    """

    def one(target: list, heard: list) -> tuple[int, int, int]:
        costs, begins = [0] * (len(heard) + 1), list(range(len(heard) + 1))
        for symbol in target:
            above, from_above = costs, begins
            costs, begins = [above[0] + 1], [from_above[0]]
            for j, other in enumerate(heard):
                steps = ((above[j] + (symbol != other), from_above[j]), (above[j + 1] + 1, from_above[j + 1]), (costs[j] + 1, begins[j]))
                cost, begin = min(steps, key=lambda s: (s[0], -s[1]))
                costs.append(cost)
                begins.append(begin)
        stop = min(range(len(costs)), key=lambda j: (costs[j], j))
        return begins[stop], stop, costs[stop]

    def run(parts):
        for part in parts:
            yield pd.DataFrame([(i, *one(list(t), list(h))) for i, t, h in zip(part["id"], part["target"], part["heard"], strict=True)], columns=["id", "start", "stop", "edits"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "target", "heard").mapInPandas(run, f"id {kind}, start int, stop int, edits int")


def heard_shares(rows: DataFrame) -> DataFrame:
    """Rows (id, words, readings): (id, reading, place, letters, share): the share of each word's letters that each
    reading carries, in order and across the borders of words, which are compared as they stand."""
    each = rows.select("id", "words", F.posexplode("readings").alias("reading", "said"))
    met = each.withColumn("blocks", matching_blocks(F.array_join("words", " "), F.col("said")))
    begins = F.aggregate("words", F.array(F.lit(0)), lambda done, w: F.concat(done, F.array(F.element_at(done, -1) + F.length(w) + 1)))
    placed = F.arrays_zip(F.col("words").alias("word"), F.slice(begins, 1, F.size("words")).alias("begin"))
    words = met.select("id", "reading", "blocks", F.posexplode(placed).alias("place", "w")).select("id", "reading", "place", "blocks", F.length("w.word").alias("letters"), "w.begin")
    inside = lambda b: F.greatest(F.least(F.col("begin") + F.col("letters"), b["at"] + b["size"]) - F.greatest("begin", b["at"]), F.lit(0))
    carried = F.aggregate("blocks", F.lit(0), lambda n, b: n + inside(b))
    return words.select("id", "reading", "place", "letters", (carried / F.greatest("letters", F.lit(1))).alias("share"))


def unheard_words(rows: DataFrame, least: float = 0.5, enough: float = 0.6) -> DataFrame:
    """Rows (id, words, readings): (id, place) of the words of which no reading carries the least share; none where
    no reading carries enough of all letters."""
    shares = heard_shares(rows)
    carried = shares.groupBy("id", "reading").agg((F.sum(F.col("share") * F.col("letters")) / F.greatest(F.sum("letters"), F.lit(1))).alias("all")).groupBy("id").agg(F.max("all").alias("all"))
    best = shares.groupBy("id", "place").agg(F.max("share").alias("share")).where(F.col("share") < least)
    return best.join(carried.where(F.col("all") >= enough), "id").select("id", "place")


def agreements(windows: DataFrame, key: str, tokens: int = 2, letters: int = 4) -> DataFrame:
    """(key, agreement): the mean similarity of what was decoded in each window to the words placed there, over
    windows (key, decoded, placed) that hold enough to judge by; keys without such windows are missing."""
    judged = windows.where((F.size("decoded") >= tokens) & (F.length(F.array_join("decoded", "")) >= letters))
    return judged.select(key, similarity("decoded", "placed").alias("ratio")).groupBy(key).agg(F.round(F.avg("ratio"), 4).alias("agreement"))


def ordered_windows(lines: DataFrame, least: float = 0.6) -> DataFrame:
    """Lines (key, nth, wanted, words) of a passage with the window of their own length that agrees best word by
    word: (key, nth, start, stop). Of equal ones the nearest to where the line before left off."""
    from strandline.operators.folds import ordered_fold

    def begin(_):
        cursor = [0]

        def step(row):
            key, nth, wanted, words = row
            wanted, words = list(wanted), list(words)
            best = None
            for start in range(len(words) - len(wanted) + 1 if wanted else 0):
                rank = (sum(a == b for a, b in zip(wanted, words[start : start + len(wanted)], strict=True)) / len(wanted), -abs(start - cursor[0]))
                if best is None or rank > best[0]:
                    best = (rank, start)
            if best is not None and best[0][0] >= least:
                cursor[0] = best[1] + len(wanted)
                yield key, nth, best[1], cursor[0] - 1

        return step, lambda: iter(())

    kind, number = lines.schema["key"].dataType.simpleString(), lines.schema["nth"].dataType.simpleString()
    return ordered_fold(lines.select("key", "nth", "wanted", "words"), ["key"], ["nth"], begin, f"key {kind}, nth {number}, start int, stop int")
