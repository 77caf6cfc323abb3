"""Fill-in-the-middle transformation: a numpy kernel over the UTF-8 buffers of a whole batch.

A unit is a run of non-blank characters with the blanks before it, or the blanks that end a text. The
kernel marks blank bytes by a table of byte classes, finds the ends of units from adjacent bytes, counts
them by a running sum that starts anew with each text, and selects the cuts of all rows with one binary
search. The three parts of every row are then slices of the same buffer, which Arrow joins with the
sentinels. Blanks and sentinels are ASCII, so bytes of longer characters never look like one.

Null and empty texts have no units, are plain and give an empty output. A text that contains a sentinel
stays plain, so an output is read back without doubt. Choices depend on the seed and the id alone: rows of
one id and different texts share their numbers, a null id counts as empty. Rows are independent: repeated
rows, ties and an empty table need nothing special, and further columns pass through `transform` untouched
unless they have the name of one that it adds, which is then replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text_blocks import blocks
from strandline.runtime import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord("P"), ord("S"), ord("M")]] = True


def unit_ends(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each byte ends a unit; `ends` holds the offsets of the texts in `data`."""
    blank = _BLANK[data]
    last = np.zeros(len(data), bool)
    last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    before_blank = np.zeros(len(data), bool)
    before_blank[:-1] = blank[1:]
    return last | (~blank & before_blank)


def has_sentinel(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text contains a sentinel, which never spans two texts."""
    if len(data) < 3:
        return np.zeros(len(ends) - 1, bool)
    at = np.flatnonzero((data[:-2] == ord("<")) & _LETTER[data[1:-1]] & (data[2:] == ord(">")))
    row = np.searchsorted(ends, at, side="right") - 1
    found = np.zeros(len(ends) - 1, bool)
    found[row[at + 2 < ends[row + 1]]] = True
    return found


def cuts(data: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, low, high): units of each text and the byte offsets where its prefix and its middle end.

    `first` and `second` are reduced modulo n + 1; the smaller counts the units of the prefix.
    """
    places = np.flatnonzero(unit_ends(data, ends)) + 1
    before = np.searchsorted(places, ends, side="right")  # units up to each text's start: the count restarts there
    n = np.diff(before)
    a, b = first % (n + 1), second % (n + 1)
    stops = np.concatenate([[0], places])
    low, high = (np.where(k > 0, stops[before[:-1] + k], ends[:-1]) for k in (np.minimum(a, b), np.maximum(a, b)))
    return n, low, high


def rearranged(data: np.ndarray, ends: np.ndarray, h: list[np.ndarray], rate: int, spm_rate: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts of a block."""
    n, low, high = cuts(data, ends, h[0], h[1])
    offsets = np.empty(3 * len(n) + 1, np.int64)
    offsets[0::3], offsets[1::3], offsets[2::3] = ends, low, high
    parts = pa.Array.from_buffers(pa.large_string(), 3 * len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    prefix, middle, suffix = (parts.take(pa.array(np.arange(i, 3 * len(n), 3))) for i in range(3))
    plain = (ends[1:] == ends[:-1]) | has_sentinel(data, ends) | (h[2] % 100 >= rate)
    spm = ~plain & (h[3] % 100 < spm_rate)
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")))
    joined = lambda *pieces: pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in pieces), pa.scalar("", pa.large_string()))
    whole = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])
    output = pc.if_else(pa.array(plain), whole, pc.if_else(pa.array(spm), joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    chars = [pa.array(pc.utf8_length(part).to_numpy(zero_copy_only=False), pa.int64(), mask=plain) for part in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output.cast(pa.large_string())]


def numbers(seed: int, key: str) -> list[Column]:
    """Four unsigned numbers of each row, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """df with n, form, prefix_chars, middle_chars and output; rates are percentages. One narrow pass."""
    ship_package(df.sparkSession)
    added = [part.split()[0] for part in ADDED.split(", ")]
    kept = df.drop(*added)
    where = kept.columns.index(text)
    width = len(kept.columns)
    asked = kept.select(*(F.col(f"`{c}`") for c in kept.columns), *numbers(seed, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches, where):
            h = [rows.column(width + i).to_numpy(zero_copy_only=False) for i in range(4)]
            done = rearranged(data, ends, h, rate, spm_rate)
            yield pa.RecordBatch.from_arrays([*rows.columns[:width], *done[:-1], done[-1].cast(pa.string())], names=[*rows.schema.names[:width], *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return asked.mapInArrow(run, f"{kinds}, {ADDED}")


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: sentinels occur in it once each, where the form puts them."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of df: id, n, form, lengths, and digests of the output and of the text rebuilt from it."""
    done = transform(df.select(key, text), key, text, **how)
    return done.select(
        key, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d
), c AS (
  SELECT doc_id, text, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(w[1 : a], '') AS pre, array_to_string(w[a + 1 : b], '') AS mid, array_to_string(w[b + 1 : n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
