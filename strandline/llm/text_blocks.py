"""Arrow batches of (key, text) as byte arrays in bounded blocks, for numpy work inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries do so by themselves
        return


def blocks(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets): whole rows, about `most` bytes of text at a time.

    Null texts are empty; one text longer than `most` is a block by itself.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to
    give_back()


def code_points(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's code points, and the offsets of its texts counted in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, ends
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[ends]


def held_out(column):
    """The rows kept for testing: crc32 of the id as text, modulo 4, is 2."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4 == 2


def sample_share(*columns):
    """A number from 0 to 1 for each row, by a hash of the columns."""
    from pyspark.sql import functions as F

    return F.xxhash64(*columns, F.lit(17)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def distinct_rows(df, *columns):
    """About how many different rows there are, from a sketch of fixed size; copies of a row count once."""
    from pyspark.sql import functions as F

    return df.agg(F.approx_count_distinct(F.xxhash64(*columns), 0.02)).first()[0]


#: Groups of a sample whose shares every executor may hold: some 10 MB.
BROADCAST_GROUPS = 100_000


def bounded_sample(df, by: str, key: str, text: str, rows: int):
    """About `rows` different rows for each value of `by`, chosen by a hash of key and text; smaller groups stay whole.

    The share of a group follows from the number of its different rows, so a row that fills the table, or
    its group, neither fills the sample nor starves it. Shares are a table of one row for each group, joined to the
    rows; no group is gathered anywhere. Rows whose `by` is null are left out.
    """
    from pyspark.sql import functions as F

    from strandline.runtime import materialize

    many = F.approx_count_distinct(F.xxhash64(F.col(key), F.col(text)), 0.02)
    shares = materialize(df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group_of")).agg((F.lit(float(rows)) / many).alias("group_share")), "sample-shares")
    few = shares.count() <= BROADCAST_GROUPS
    met = df.join(F.broadcast(shares) if few else shares, F.col(by) == F.col("group_of"))
    return met.where(sample_share(F.col(key), F.col(text)) < F.col("group_share")).select(*df.columns).dropDuplicates([by, key, text])
