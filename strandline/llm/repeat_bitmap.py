"""Which 64-bit hashes repeat, counted over all documents and kept in a bitmap of fixed size.

A set bit may be shared by hashes that do not repeat, so a mark is a hint that costs time when
wrong; a hash that repeats is always marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text_blocks import give_back

#: 2^CELL_BITS bits are 8 MB, whatever the input.
CELL_BITS = 26
#: Hashes that a task holds before it packs and sends them.
HELD = 1 << 19
#: Bytes of text whose hashes meet in one bucket, about.
BUCKET_BYTES = 1 << 25
#: Spark gives frames whose size it does not know one beyond this; their rows are counted, at so many bytes each.
UNKNOWN, ROW_BYTES = 1 << 60, 1 << 12
Hashes = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is marked as repeating."""
    cell = (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    return ((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def bucket_bits(frame: DataFrame) -> int:
    """Buckets grow with the input, so that one bucket's hashes always fit a task."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = frame.count() * ROW_BYTES
    return min(20, max(8, (size // BUCKET_BYTES).bit_length()))


def repeat_bitmap(frame: DataFrame, hashes_of: Hashes, most: int) -> np.ndarray:
    """The one bitmap of repeat_bitmaps."""
    return repeat_bitmaps(frame, hashes_of, [most])[0]


def repeat_bitmaps(frame: DataFrame, hashes_of: Hashes, limits: list[int]) -> list[np.ndarray]:
    """For each limit a bit for each of 2^CELL_BITS hash prefixes: whether a hash there occurs more often.

    `hashes_of` gives the hashes of a task's batches. Tasks add up
    their own counts and send them packed by bucket, so a frequent hash costs no more than a rare
    one, and a bucket holds an even share of all hashes. The result has a fixed size.
    """
    bits, most = bucket_bits(frame), max(limits)
    width = 1 << (CELL_BITS - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for hashes in hashes_of(batches):
            held.append(hashes)
            size += len(hashes)
            if size > HELD:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)
            held.clear()
        give_back()

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits - 32), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        cuts = np.r_[starts, len(bucket)].tolist()
        low, many = keys.astype(np.uint32), np.minimum(counts, most + 1).astype(np.uint8)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts], pa.int32()), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([many[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["bucket", "keys", "counts"],
        )

    def mark(key: tuple, group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in group.column("keys")])
        counts = np.concatenate([np.frombuffer(c.as_py(), np.uint8) for c in group.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        cell, total = keys[starts] >> np.uint32(32 - (CELL_BITS - bits)), np.add.reduceat(counts, starts, dtype=np.int64)
        cells = np.zeros((len(limits), width), bool)
        for i, limit in enumerate(limits):
            cells[i, cell[total > limit]] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(cells, 1).tobytes()], pa.binary())})

    sent = frame.mapInArrow(send, "bucket int, keys binary, counts binary")
    out = np.zeros((len(limits), 1 << bits, width // 8), np.uint8)
    for row in sent.groupBy("bucket").applyInArrow(mark, "bucket int, bits binary").where(F.col("bits").isNotNull()).collect():  # 8 MB a limit
        out[:, row["bucket"]] = np.frombuffer(row["bits"], np.uint8).reshape(len(limits), -1)
    return [bitmap.ravel() for bitmap in out]
