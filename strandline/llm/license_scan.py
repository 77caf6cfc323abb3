"""License scan by diagonal voting, DataFrame functions only.

Every rolling 3-word gram of every text is hashed and joined to the positions of the same grams in a
fixed set of license notices. A match votes for the diagonal (document position less template
position). Diagonals of one template at most `DRIFT` apart are merged, which allows for inserted or
dropped words, and a merged span is kept where enough of the template's grams stand in it and it
is not much longer than the template; the grams are compared by their words, not by hash alone.

Beside them the base phrases are counted wherever their words stand in a row. Null and empty
texts have no words, places or labels; their score is 0. Rows of equal id and text get equal
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.word_rows import keyed, lower_ascii

GRAM, DRIFT, LEAST_COVER, LONGEST = 3, 4, 0.6, 1.6

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Usual notices of public licenses, as words, and their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
]


def template_positions(spark: SparkSession) -> DataFrame:
    """(template, label, size, place, gram, hash): every gram of every notice; as many rows as the notices have words."""
    rows = []
    for template, (label, text) in enumerate(NOTICES):
        w = text.split()
        rows += [(template, label, len(w) - GRAM + 1, place, " ".join(w[place : place + GRAM])) for place in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(rows, "template int, label string, size int, place int, gram string").withColumn("hash", F.xxhash64("gram"))


def _starters() -> list[str]:
    """Words with which a gram of a notice or a base phrase can begin."""
    grams = [w[i] for _, t in NOTICES for w in [t.split()] for i in range(len(w) - GRAM + 1)]
    return sorted({*grams, *(p.split()[0] for p in BASE)})


def grams(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, body, pos, gram, pair): rolling grams whose first word can begin a notice or a phrase."""
    # three arrays side by side keep a row small: no row carries the words of its whole document
    w = F.col("words")
    beside = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))).alias("c"))
    rows = keyed(documents, key, text).select("doc", "body", F.posexplode(beside).alias("pos", "g")).where(F.lower("g.a").isin(_starters()))
    x, y, z = (lower_ascii(F.col("g").getField(name)) for name in "abc")
    return rows.select("doc", "body", "pos", F.concat_ws(" ", x, y, z).alias("gram"), F.concat_ws(" ", x, y).alias("pair"))


def base_places(rolled: DataFrame) -> DataFrame:
    """(doc, body, pos, label): places of the base phrases."""
    label = F.coalesce(*(F.when(F.col("pair" if len(phrase.split()) == 2 else "gram") == phrase, label) for phrase, label in BASE.items()))
    return rolled.select("doc", "body", "pos", label.alias("label")).where(F.col("label").isNotNull()).distinct()


def voted_spans(rolled: DataFrame) -> DataFrame:
    """(doc, body, label, start, end, cover): verified spans of notices, in words."""
    templates = template_positions(rolled.sparkSession)
    known = F.xxhash64("gram").isin([r[0] for r in templates.select("hash").distinct().collect()])
    hits = (
        rolled.where(known).withColumn("hash", F.xxhash64("gram")).join(F.broadcast(templates.withColumnRenamed("gram", "wanted")), "hash")
        .where(F.col("gram") == F.col("wanted")).withColumn("diagonal", F.col("pos") - F.col("place"))
    )
    votes = hits.groupBy("doc", "body", "template", "diagonal").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.collect_set("place").alias("places"), F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("end"), F.min("place").alias("first")
    )
    along = Window.partitionBy("doc", "body", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT) | F.lag("diagonal").over(along).isNull()
    runs = votes.withColumn("run", F.sum(apart.cast("int")).over(along))
    merged = runs.groupBy("doc", "body", "template", "run").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_sort(F.collect_list(F.struct("start", "first"))).alias("pieces"),
    )
    # pieces that stand later in the text stand later in the notice
    firsts = F.transform("pieces", lambda p: p["first"])
    in_order = F.array_sort(firsts) == firsts
    fits = (F.col("end") - F.col("start") <= LONGEST * (F.col("size") + GRAM - 1)) & in_order
    # a diagonal that verifies by itself counts, whatever stands beside it: close copies make one long run
    spans = merged.where(fits).select("doc", "body", "label", "start", "end", "places", "size").unionByName(votes.select("doc", "body", "label", "start", "end", "places", "size"))
    cover = F.size("places") / F.col("size")
    return spans.where(cover >= LEAST_COVER).select("doc", "body", "label", "start", "end", cover.alias("cover")).distinct()


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    The score is the best cover of a notice, and at least 0.5 where a base phrase stands.
    """
    rolled = grams(documents, key, text)
    none = F.lit(None)
    found = base_places(rolled).select("doc", "body", "pos", "label", F.lit(True).alias("base"), none.cast("double").alias("cover")).unionByName(
        voted_spans(rolled).select("doc", "body", none.cast("int").alias("pos"), "label", F.lit(False).alias("base"), "cover")
    )
    each = found.groupBy("doc", "body").agg(
        F.count_if("base").alias("n_base"),
        F.min("pos").alias("first_word"),
        F.max("pos").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.greatest(F.coalesce(F.max("cover"), F.lit(0.0)), F.when(F.bool_or("base"), 0.5).otherwise(0.0)).alias("score"),
    ).withColumnsRenamed({"doc": "hit_doc", "body": "hit_body"})
    rows = keyed(documents, key, text).select("doc", "body", F.size("words").cast("long").alias("n_words"))
    return rows.join(each, rows["doc"].eqNullSafe(each["hit_doc"]) & (rows["body"] == each["hit_body"]), "left").select(
        F.col("doc").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort("base_labels")).alias("base_labels"),
        F.concat_ws(",", F.array_sort("labels")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
