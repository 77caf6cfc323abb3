"""Published word times of a verse, cleaned to what was recited, with every step back that hangs together.

Words are rows of keys (one verse of one recording): word (from 1), start, end and heard (added from another
listening). Sorting and the rules between neighbours are windows; a stretch that goes back is judged as a whole
and then kept, put in order or given to the word before it, so rows already placed may still change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in milliseconds: less than any word takes, and the least mean distance of words said again.
UNSAID, RUSHED = 50, 100


def _order(keys: Sequence[str], *by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*(by or ("n",)))


def heard_near(words: DataFrame, restarts: DataFrame | None, keys: Sequence[str], near: int) -> DataFrame:
    """words with `back`: a restart (keys, at) was heard within `near` of the word's start; null where no one listened."""
    if restarts is None:
        return words.withColumn("back", F.lit(None).cast("boolean"))
    cell = 2 * near + 1
    spread = restarts.select(*keys, "at", F.explode(F.sequence(F.floor((F.col("at") - near) / cell), F.floor((F.col("at") + near) / cell))).alias("cell"))
    met = words.withColumn("cell", F.floor(F.col("start") / cell)).alias("w").join(spread.alias("r"), [*keys, "cell"], "left")
    close = F.coalesce(F.abs(F.col("at") - F.col("start")) <= near, F.lit(False))
    return met.groupBy(*(f"w.{c}" for c in words.columns)).agg(F.max(close).alias("back"))


def listed_words(words: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with n, their order in time: from the first word of the verse to the last time its last word is listed.

    sizes gives (keys, words of the verse). What has no time or no such word goes. Word 1 opens the verse only where
    it comes before the last listing of the last word.
    """
    fine = words.join(sizes.select(*keys, F.col("size").alias("of")), list(keys)).where(F.col("word").between(1, F.col("of")) & (F.col("end") > F.col("start")))
    numbered = fine.withColumn("n", F.row_number().over(_order(keys, "start", "end", "word")))
    whole = Window.partitionBy(*keys)
    first, last = F.min(F.when(F.col("word") == 1, F.col("n"))).over(whole), F.max(F.when(F.col("word") == F.col("of"), F.col("n"))).over(whole)
    edges = numbered.withColumns({"first": first, "last": last})
    opens = F.when(F.col("last").isNull() | (F.col("first") <= F.col("last")), F.coalesce("first", F.lit(1))).otherwise(1)
    cut = edges.withColumn("opens", F.when(F.col("first").isNull(), 1).otherwise(opens))
    closes = F.when(F.col("last") >= F.col("opens"), F.col("last"))
    return cut.where((F.col("n") >= F.col("opens")) & (closes.isNull() | (F.col("n") <= closes))).drop("of", "first", "last", "opens")


def merged_repeats(listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listings of one word in a row made one, unless each is a repeat that was heard; too short ones give way to the next."""
    order = _order(keys)
    island = F.count_if(F.coalesce(F.lag("word").over(order) != F.col("word"), F.lit(True))).over(order)
    part = F.struct("n", "start", "end", "heard", "back")
    runs = listed.withColumn("island", island).groupBy(*keys, "island", "word").agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def step(kept: Column, now: Column) -> Column:
        last = F.element_at(kept, -1)
        rest = F.slice(kept, 1, F.size(kept) - 1)
        unsaid = ~last["heard"] & (last["end"] - last["start"] < UNSAID)
        longer = last.withField("end", F.greatest(last["end"], now["end"]))
        repeat = now["heard"] | F.coalesce(now["back"], F.lit(False))
        return F.when(unsaid, F.concat(rest, F.array(now))).when(repeat, F.concat(kept, F.array(now))).otherwise(F.concat(rest, F.array(longer)))

    folded = F.aggregate(F.slice("parts", 2, F.size("parts")), F.slice("parts", 1, 1), step)
    return runs.select(*keys, "word", F.explode(folded).alias("p")).select(*keys, "word", "p.*")


def _without_strays(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A verse that opens on words other than its first and goes back at once begins where that ends, at the first one's time."""
    order = _order(keys)
    onward = (F.lead("word").over(order) > F.col("word")) | F.lead("word").over(order).isNull() | (F.col("word") == 1)
    opening = words.withColumns({"onward": onward, "first_start": F.first("start").over(order)})
    opening = opening.withColumn("settled", F.count_if("onward").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    left = opening.where(F.col("onward") | (F.coalesce("settled", F.lit(0)) > 0))
    first = F.row_number().over(order) == 1
    return left.withColumn("start", F.when(first, F.col("first_start")).otherwise(F.col("start"))).drop("onward", "settled", "first_start")


def _given(rows: DataFrame, keys: Sequence[str], gone: Column, until: Column) -> DataFrame:
    """Rows that stay, each with an end no earlier than `until` of the gone rows right behind it."""
    owner = F.count_if(~gone).over(_order(keys))
    taken = rows.withColumns({"owner": owner, "gone": gone, "until": F.when(gone, until)})
    reach = F.max("until").over(Window.partitionBy(*keys, "owner"))
    return taken.withColumn("end", F.greatest("end", F.coalesce(reach, F.col("end")))).where(~F.col("gone")).drop("owner", "gone", "until")


def _runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with `run`: within a stretch that goes back, words that read on by one each."""
    order = _order([*keys, "stretch"])
    return rows.withColumn("run", F.count_if(F.coalesce(F.lag("word").over(order) + 1 != F.col("word"), F.lit(True))).over(order))


def sound_restarts(words: DataFrame, keys: Sequence[str], listened: bool) -> DataFrame:
    """(keys, word, start, end) in the order recited.

    A stretch goes back from where a word is not beyond all before it to where one is. Runs in it that no one
    could have said so fast go. The rest stays if every run has two words or more; is put in order if it names
    each word from where it went back to where the reading had got once; and stays as it is if someone heard it. With
    `listened` a restart must have been heard where it begins. Time of what goes is the word's before it.
    """
    order = _order(keys)
    placed = _without_strays(words, keys)
    furthest = F.max("word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.withColumn("reached", furthest).withColumn("goes_back", F.coalesce(F.col("word") <= F.col("reached"), F.lit(False)))
    marked = _runs(marked.withColumn("stretch", F.when(F.col("goes_back"), F.count_if(~F.col("goes_back")).over(order)).otherwise(-F.col("n"))), keys)
    run = Window.partitionBy(*keys, "stretch", "run")
    many = F.count("*").over(run)
    hurried = F.col("goes_back") & (many >= 2) & ((F.max("start").over(run) - F.min("start").over(run)) / F.greatest(many - 1, F.lit(1)) < RUSHED)
    ends = F.last("end").over(_order([*keys, "stretch", "run"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    calm = _runs(_given(marked.withColumns({"hurried": hurried, "ends": ends}), keys, F.col("hurried"), F.col("ends")).drop("hurried", "ends", "run"), keys)

    sizes = calm.where("goes_back").groupBy(*keys, "stretch", "run").agg(F.count("*").alias("size"))
    short = sizes.groupBy(*keys, "stretch").agg(F.min("size").alias("shortest"))
    judged = calm.where("goes_back").groupBy(*keys, "stretch").agg(
        F.min_by("back", "n").alias("begun"), F.count("*").alias("size"), F.countDistinct("word").alias("distinct"), F.min("word").alias("low"), F.max("word").alias("high"), F.max("reached").alias("got"),
        F.min("heard").alias("all_heard"), F.max_by("end", "n").alias("last_end"),
    ).join(short, [*keys, "stretch"])
    once = (F.col("distinct") == F.col("size")) & (F.col("high") - F.col("low") + 1 == F.col("size")) & (F.col("size") >= 2) & (F.col("high") == F.col("got"))
    forward = F.col("shortest") >= 2
    agreed = F.coalesce("begun", F.lit(False)) if listened else F.lit(True)
    sound = agreed & (forward | once | F.lit(listened) | F.col("all_heard"))
    verdict = judged.select(*keys, "stretch", sound.alias("sound"), (once & ~forward).alias("sorts"), "low", "last_end")
    met = calm.join(verdict, [*keys, "stretch"], "left")
    kept = _given(met, keys, F.coalesce(~F.col("sound"), F.lit(False)), F.col("last_end"))
    nth = F.row_number().over(_order([*keys, "stretch"]))
    word = F.when(F.coalesce("sorts", F.lit(False)), F.col("low") + nth - 1).otherwise(F.col("word"))
    return kept.withColumn("word", word.cast(words.schema["word"].dataType)).select(*keys, "word", "start", "end", "n")


def recited_words(words: DataFrame, sizes: DataFrame, keys: Sequence[str], restarts: DataFrame | None = None, near: int = 1000) -> DataFrame:
    """(keys, place, word, start, end): the words of each verse in the order they were recited, repeats included."""
    listed = listed_words(heard_near(words, restarts, keys, near), sizes, keys)
    kept = sound_restarts(merged_repeats(listed, keys), keys, restarts is not None)
    return kept.select(*keys, (F.row_number().over(_order(keys)) - 1).alias("place"), "word", "start", "end")
