"""One statement for Spark and for the DuckDB oracle: a few marked functions differ in spelling."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.runtime import table

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()
#: US(x): microseconds since 1970 of a timestamp; IDIV(a, b): integer quotient; HAS(s, p): regular expression found.
_SPARK = {"US": r"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', \1)", "IDIV": r"floor((\1) / (\2))", "HAS": r"regexp_like(\1, \2)"}
_DUCK = {"US": r"epoch_us(\1)", "IDIV": r"CAST(floor((\1) / (\2)) AS BIGINT)", "HAS": r"regexp_matches(\1, \2)"}


def _spell(text: str, words: dict[str, str]) -> str:
    for name, form in words.items():
        pattern = rf"\b{name}\(([^(),]+)\)" if name == "US" else rf"\b{name}\(([^,]+), ('[^']*'|[^,()]+)\)"
        text = re.sub(pattern, form, text)
    return text


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable from a statement over the tables by name."""
    statement = _spell(text, _SPARK).replace(", 'g')", ")")  # Spark replaces every match by itself
    used = [t for t in TABLES if re.search(rf"\b{t}\b", statement)]
    named = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", statement)
    return lambda spark, sf_dir: spark.sql(named, **{t: table(spark, sf_dir, t) for t in used})


def duck_sql(text: str) -> str:
    return _spell(text, _DUCK)
