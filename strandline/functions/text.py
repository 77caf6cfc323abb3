"""Text rules that Spark has no function for, as Arrow-batched functions of a column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def hashtag(text: pd.Series) -> pd.Series:
    """ASCII letters and digits, accents dropped."""

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if c.isascii() and c.isalnum())

    return text.map(one)


@F.pandas_udf(StringType())
def digest36(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-16 code units, the last six base-36 digits."""

    def one(t):
        if t is None:
            return None
        units, h = t.encode("utf-16-le"), 0x811C9DC5
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        out = ""
        while h:
            h, digit = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
        return (out or "0").rjust(6, "0")[-6:]

    return text.map(one)


def fnv_hash(text: Column, begin: int, prime: int) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 units, in one pass over its characters."""
    whole = F.lit(0xFFFFFFFF).cast("long")
    mixed = lambda h, unit: (h.bitwiseXOR(unit.cast("long")) * prime).bitwiseAND(whole)

    def step(h: Column, point: Column) -> Column:
        beyond = point - 0x10000
        return F.when(point < 0x10000, mixed(h, point)).otherwise(mixed(mixed(h, F.shiftright(beyond, 10) + 0xD800), beyond.bitwiseAND(0x3FF) + 0xDC00))

    points = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.when(F.length(text) == 0, F.lit(begin).cast("long")).otherwise(F.aggregate(points, F.lit(begin).cast("long"), step))
