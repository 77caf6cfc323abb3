"""Hashes of texts as seeds: against a plain loop, worked out once for each row."""

import re

from pyspark.sql import functions as F

from strandline.functions import publish
from strandline.functions.text import fnv_hash
from strandline.operators import pairing
from strandline.plans import publish_queries

START, PRIME = pairing.FNV_START, pairing.FNV_PRIME


def plain(text):
    h, units = START, text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * PRIME) % 2**32
    return h


def test_fnv_hash_is_of_utf16_units(spark):
    texts = ["", "a", "12:3|a b", "\u00e9\u0633\uffff", "x\U0001f600y\U0010ffff", "\x00\n", "long " * 400]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1)
    assert [r.h for r in rows.select(fnv_hash(F.col("t"), START, PRIME).alias("h")).collect()] == [*map(plain, texts), None]
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    last = lambda n: "".join(digits[n // 36**k % 36] for k in range(5, -1, -1))
    assert [r.h for r in rows.where("t IS NOT NULL").select(publish.fnv36(F.col("t"), START, PRIME).alias("h")).collect()] == [last(plain(t)) for t in texts]


def test_published_titles_hash_each_seed_once(spark, tmp_path):
    part = [(i, f"part {i}", "b", "t" * (i % 60), i % 50) for i in range(40)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = publish_queries.published_titles(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(str(PRIME), plan)) <= 3  # one step for a character of one unit, two for one of two
    assert found.count() == 40
