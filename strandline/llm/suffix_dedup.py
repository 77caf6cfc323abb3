"""Removal of repeated passages: every byte covered by a 200-byte string that also starts elsewhere.

1. Anchors: of every 161 neighbouring 40-byte grams of a text the one of the smallest hash. Equal
   200-byte strings hold the same anchor at the same place, so each repeat is seen at an anchor.
   Gram hashes come from prefix polynomial hashes. A 200-byte string around an anchor holds the 80
   bytes left or right of it as well, so only anchors are kept whose gram with one of these sides
   repeats (a bitmap of fixed size, counted over all documents).
2. An anchor whose whole surroundings repeat is covered as far as they reach; this settles
   the inside of every copied passage with one aggregation, however many copies there are.
3. The others lie near the edge of a passage. One for each different surroundings is kept, and the
   suffixes right and the reversed prefixes left of the anchors are sorted: a mergesort in which a
   comparison finds the common extension by binary search on prefix hashes. The order and the
   extensions are then verified byte by byte. Two anchors share a string that starts t bytes left
   exactly when they are in one run of both orders, of extensions of t and of 200 - t bytes.
   Where more anchors share a gram than one task should sort, the gram is lengthened by half of
   what is free on one side and on the other, and each longer gram is a group of its own.
4. The covered stretches go back to their texts.

Matches never cross texts; overlapping occurrences within a text count. Null texts are empty: no
bytes, the digest of nothing. Equal rows count as occurrences of each other (rows are told apart by a 64-bit hash of id and text). Null ids are ids like
any other. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.jaccard_join import _mix, _powers
from strandline.llm.repeat_bitmap import marked, repeat_bitmap
from strandline.llm.text_blocks import blocks
from strandline.runtime import discard, materialize, ship_package

LENGTH, GRAM = 200, 40
LEFT = LENGTH - GRAM  # how far left of an anchor a string that holds it can start
SIDE = LEFT // 2
#: Anchors of one gram beyond this number are split by longer grams before they are sorted.
HOT = 5_000
_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sliding(values: np.ndarray, size: int, pick: np.ufunc, fill) -> np.ndarray:
    """pick over every `size` neighbouring values: block-wise running values from both sides."""
    n = len(values)
    blocks_ = -(-n // size)
    padded = np.full(blocks_ * size, fill, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks_, size)
    ahead = pick.accumulate(grid, 1).ravel()
    back = pick.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = n - size + 1
    return pick(back[:count], ahead[size - 1 : size - 1 + count])


def _hashes(data: np.ndarray) -> np.ndarray:
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return sums


def _span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    return _mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


class Anchors:
    """The anchors of a block of texts: place in the block, text, reach to both sides and hashes.

    `h` is the hash of the gram; `sides` those of the gram with the SIDE bytes left and right of
    it, as far as the text has them. Every 200-byte string around a gram holds one of the two, so
    an anchor neither of whose sides repeats lies in no repeated string.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.ends, self.sums = ends, _hashes(data)
        self.place = self._places(data) if len(data) >= LENGTH else np.zeros(0, np.int64)
        self._reach()

    def _places(self, data: np.ndarray) -> np.ndarray:
        sums, ends = self.sums, self.ends
        _, inverse = _powers(len(sums))
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1]) | np.uint64(1)
        least = _sliding(grams, LEFT + 1, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))  # for each start of a string
        whole = np.ones(len(least), bool)
        for seam in ends[1:-1].tolist():  # strings over a seam are none
            whole[max(0, seam - LENGTH + 1) : seam] = False
        least[~whole] = 0
        around = np.zeros(len(least) + 2 * LEFT, np.uint64)
        around[LEFT : LEFT + len(least)] = least
        return np.flatnonzero(_sliding(around, LEFT + 1, np.maximum, np.uint64(0))[: len(grams)] == grams)

    def _reach(self) -> None:
        self.owner = np.searchsorted(self.ends, self.place, side="right") - 1
        self.pos = self.place - self.ends[self.owner]
        self.left = np.minimum(self.pos, LEFT)
        self.right = np.minimum(self.ends[self.owner + 1] - self.place, LENGTH)
        # chosen hashes are small ones: mixed again, they spread over all buckets and cells
        self.h = _mix(_span_hash(self.sums, self.place, self.place + GRAM) + np.uint64(7))

    def sides(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which anchors have that side, hash of gram and side) for left and right."""
        out = []
        for has, before, after in ((self.left >= SIDE, SIDE, 0), (self.right >= GRAM + SIDE, 0, SIDE)):
            at = self.place[has]
            out.append((has, _mix(_span_hash(self.sums, at - before, at + GRAM + after) + np.uint64(before))))
        return out

    def keep(self, chosen: np.ndarray) -> None:
        self.place = self.place[chosen]
        self._reach()

    def surroundings(self) -> np.ndarray:
        return _mix(_span_hash(self.sums, self.place - self.left, self.place + self.right) + self.left.astype(np.uint64) * np.uint64(1009) + self.right.astype(np.uint64))

    def sites(self, bodies: np.ndarray) -> np.ndarray:
        """A hash of row and place, which tells the anchors of all texts apart."""
        return _mix(bodies[self.owner].view(np.uint64) + self.pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _side_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for _, data, ends in blocks(batches):
        yield np.concatenate([h for _, h in Anchors(data, ends).sides()])


def _anchor_rows(texts: DataFrame, bitmap: np.ndarray, contexts: bool) -> DataFrame:
    """Rows of the marked anchors: h, c (hash of the surroundings), site, k, body, pos, left, right[, context].

    Without contexts the bitmap marks sides; with them, the sites of single anchors.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    kind = texts.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches):
            found, bodies = Anchors(data, ends), rows.column(2).to_numpy()
            if contexts:
                found.keep(marked(shared.value, found.sites(bodies)))
            else:
                repeats = np.zeros(len(found.place), bool)
                for has, side in found.sides():
                    repeats[has] |= marked(shared.value, side)
                found.keep(repeats)
            take = pa.array(found.owner)
            columns = [pa.array(x.view(np.int64)) for x in (found.h, found.surroundings(), found.sites(bodies))]
            columns += [rows.column(0).take(take), rows.column(2).take(take), *[pa.array(x.astype(np.int32)) for x in (found.pos, found.left, found.right)]]
            names = ["h", "c", "site", "k", "body", "pos", "left", "right"]
            if contexts:
                cuts = zip((found.place - found.left).tolist(), (found.place + found.right).tolist(), strict=True)
                columns.append(pa.array([data[a:b].tobytes() for a, b in cuts], pa.binary()))
                names.append("context")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = f"h long, c long, site long, k {kind}, body long, pos int, left int, right int"
    return texts.select("k", "t", "body").mapInArrow(run, shape + ", context binary" * contexts)


class SuffixOrder:
    """A sorted order of byte rows with the common extension of each neighbour, verified."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes
        width = rows.shape[1]
        power, _ = _powers(width + 1)
        self.prefix = np.zeros((len(rows), width + 1), np.uint64)
        np.cumsum((_VALUE[rows] + (np.arange(width) < sizes[:, None]) * np.uint64(0x51ED27)) * power[:width], axis=1, out=self.prefix[:, 1:])
        self.order = self._sorted()
        x, y = self.order[:-1], self.order[1:]
        self.common = np.minimum(self.extension(x, y), np.minimum(sizes[x], sizes[y]))
        if not self._verified():  # a hash collision: sort by the bytes themselves
            self.order = np.lexsort((sizes, np.ascontiguousarray(rows).view(f"V{width}").ravel().argsort().argsort()))
            x, y = self.order[:-1], self.order[1:]
            unlike = rows[x] != rows[y]
            self.common = np.minimum(np.where(unlike.any(1), unlike.argmax(1), width), np.minimum(sizes[x], sizes[y]))

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extensions of pairs of rows, by binary search on the prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.rows.shape[1])
        while len(x) and (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix[x, middle] == self.prefix[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _before(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row x sorts before row y; equal rows as `ties` says."""
        at = self.extension(x, y)
        inside = np.minimum(at, self.rows.shape[1] - 1)
        # past its end a row is smaller than any byte
        a = np.where(inside < self.sizes[x], self.rows[x, inside].astype(np.int16), -1)
        b = np.where(inside < self.sizes[y], self.rows[y, inside].astype(np.int16), -1)
        return np.where(at >= self.rows.shape[1], ties, (a < b) | ((a == b) & ties))

    def _sorted(self) -> np.ndarray:
        """Bottom-up mergesort; all merges of a round at once, each row finding its rank in the other run."""
        n, order, size = len(self.rows), np.arange(len(self.rows)), 1
        while size < n:
            place = np.arange(n)
            run = place // size
            first = (run % 2) == 0
            begin = np.minimum((run ^ 1) * size, n)
            low, high = begin.copy(), np.minimum(begin + size, n)
            while (low < high).any():
                open_ = np.flatnonzero(low < high)
                middle = (low[open_] + high[open_]) // 2
                # rows of the second run come after equal rows of the first
                other_first = self._before(order[middle], order[open_], False)
                equal_first = ~first[open_] & self._before(order[middle], order[open_], True)
                smaller = other_first | equal_first
                low[open_] = np.where(smaller, middle + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], middle)
            rank = (run // 2) * 2 * size + (place - run * size) + (low - begin)
            merged = np.empty(n, np.int64)
            merged[rank] = order
            order, size = merged, 2 * size
        return order

    def _verified(self) -> bool:
        """Neighbours agree on their common extension and are in order at the next byte."""
        x, y = self.order[:-1], self.order[1:]
        column = np.arange(self.rows.shape[1])
        for at in range(0, len(x), 4096):
            a, b, common = x[at : at + 4096], y[at : at + 4096], self.common[at : at + 4096]
            if ((self.rows[a] != self.rows[b]) & (column < common[:, None])).any():
                return False
            inside = np.minimum(common, self.rows.shape[1] - 1)
            after_a = np.where(common < self.sizes[a], self.rows[a, inside].astype(np.int16), -1)
            after_b = np.where(common < self.sizes[b], self.rows[b, inside].astype(np.int16), -1)
            if ((after_a > after_b) | ((after_a == after_b) & (after_a >= 0) & (common < self.rows.shape[1]))).any():
                return False
        return True

    def runs(self, least: int) -> np.ndarray:
        """For each row the number of its run of neighbours that share at least so many bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.r_[0, np.cumsum(self.common < least)]
        return out


def covered(contexts: list[bytes], left: np.ndarray, right: np.ndarray, gram: np.ndarray, free: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor how far left and right of it repeated strings reach; 0, 0 where none holds it.

    Only anchors of one gram (of LENGTH - free bytes) are compared: of two grams, one text may hold
    both at such a distance that one and the same string would meet itself.
    """
    n = len(contexts)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(left + right) - (left + right)
    rights, lefts = np.zeros((n, LENGTH), np.uint8), np.zeros((n, max(free, 1)), np.uint8)
    column = np.arange(LENGTH)
    inside = column < right[:, None]
    rights[inside] = flat[(begin + left)[:, None].repeat(LENGTH, 1)[inside] + np.broadcast_to(column, inside.shape)[inside]]
    column = np.arange(lefts.shape[1])
    inside = column < left[:, None]
    lefts[inside] = flat[(begin + left - 1)[:, None].repeat(lefts.shape[1], 1)[inside] - np.broadcast_to(column, inside.shape)[inside]]
    forward, backward = SuffixOrder(rights, right), SuffixOrder(lefts, left)
    reach_left, reach_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    _, gram = np.unique(gram, return_inverse=True)
    for t in range(free + 1):
        able = np.flatnonzero((left >= t) & (right >= LENGTH - t))
        if len(able) < 2:
            continue
        both = (backward.runs(t)[able] * n + forward.runs(LENGTH - t)[able]) * n + gram[able]
        _, group, counts = np.unique(both, return_inverse=True, return_counts=True)
        hit = able[counts[group] > 1]
        reach_left[hit] = t
        reach_right[hit] = np.maximum(reach_right[hit], LENGTH - t)
    return reach_left, reach_right


def _edge_spans(edges: DataFrame, groups: int, free: int) -> DataFrame:
    """(k, body, from, to): what repeats around anchors of different surroundings; equal h meet in one group."""
    kind = edges.schema["k"].dataType.simpleString()

    def solve(group: pa.Table) -> pa.Table:
        left, right = group.column("left").to_numpy().astype(np.int64), group.column("right").to_numpy().astype(np.int64)
        a, b = covered(group.column("context").to_pylist(), left, right, group.column("h").to_numpy(), free) if len(group) else (left, right)
        keep = np.flatnonzero(b > 0)
        pos, take = group.column("pos").to_numpy().astype(np.int64), pa.array(keep)
        return pa.table({"k": group.column("k").take(take), "body": group.column("body").take(take), "from": pa.array(pos[keep] - a[keep]), "to": pa.array(pos[keep] + b[keep])})

    dealt = edges.select("h", "k", "body", "pos", "left", "right", "context", F.pmod(F.xxhash64("h"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInArrow(solve, f"k {kind}, body long, from long, to long")


def _narrowed(edges: DataFrame, free: int) -> tuple[DataFrame, int]:
    """The anchors with their grams lengthened, once to the left and once to the right, and the free bytes left.

    A repeated string around a gram reaches half of the free bytes to one of the two sides, so it
    holds one of the longer grams.
    """
    less = free // 2
    more, gram = free - less, LENGTH - free

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, pos = (batch.column(n).to_numpy().astype(np.int64) for n in ("left", "right", "pos"))
            contexts, h = batch.column("context").to_pylist(), batch.column("h").to_numpy().view(np.uint64)
            data = np.frombuffer(b"".join(contexts), np.uint8)
            at = np.cumsum(left + right) - right  # places of the grams
            sums = _hashes(data)
            for has, before in ((left >= more, more), (right >= gram + more, 0)):
                rows = np.flatnonzero(has)
                start = at[rows] - before
                new_left, new_right = np.minimum(left[rows] - before, less), np.minimum(right[rows] + before, gram + more + less)
                key = _mix(_span_hash(sums, start, start + gram + more) + h[rows] + np.uint64(before))
                c = _mix(_span_hash(sums, start - new_left, start + new_right) + new_left.astype(np.uint64) * np.uint64(1009) + new_right.astype(np.uint64))
                take = pa.array(rows)
                cuts = zip((start - new_left).tolist(), (start + new_right).tolist(), strict=True)
                columns = [pa.array(key.view(np.int64)), pa.array(c.view(np.int64)), *[batch.column(n).take(take) for n in ("site", "k", "body")]]
                columns += [pa.array(x.astype(np.int32)) for x in (pos[rows] - before, new_left, new_right)] + [pa.array([data[a:b].tobytes() for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c", "site", "k", "body", "pos", "left", "right", "context"])

    columns = ["h", "c", "site", "k", "body", "pos", "left", "right", "context"]
    return edges.select(*columns).mapInArrow(run, edges.select(*columns).schema), less


def _settled(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """What the rows (h, c, site, ..) settle by aggregation: (k, body, from, to) of surroundings that
    repeat, and the classes (h, c, site, size) that are left, one site for each different surroundings."""
    classes = materialize(rows.groupBy("h", "c").agg(F.count("*").alias("m"), F.min("site").alias("site")), label)
    full = rows.join(classes.where("m > 1").select("h", "c"), ["h", "c"]).select("k", "body", (F.col("pos") - F.col("left")).cast("long").alias("from"), (F.col("pos") + F.col("right")).cast("long").alias("to"))
    sizes = classes.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    return full, classes.select("h", "c", "site").join(sizes, "h")


def repeated_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(k, body, from, to): stretches of bytes to remove, which may overlap; texts has k, t and body."""
    bitmap = repeat_bitmap(texts.select("k", "t"), _side_hashes, 1)
    rows = materialize(_anchor_rows(texts, bitmap, False), "suffix-anchors")
    full, left = _settled(rows, "suffix-classes")
    spans = [materialize(full, "suffix-spans")]
    left = materialize(left, "suffix-left")
    discard(rows)
    single = repeat_bitmap(left.select("site"), _site_hashes, 0)
    around = _anchor_rows(texts, single, True)
    names = left.select(F.col("h").alias("lh"), F.col("c").alias("lc"), F.col("site").alias("ls"), "size")
    # keys h and c alone, so that repeated rows meet in the same task and drop out without another shuffle
    itself = (around["h"] == names["lh"]) & (around["c"] == names["lc"]) & (F.col("site").bitwiseXOR(F.col("ls")) == 0)
    edges = materialize(around.join(names, itself).select(*around.columns, "size").dropDuplicates(["h", "c"]), "suffix-edges")
    free = LEFT
    while True:
        count, largest = edges.agg(F.count(F.when(F.col("size") <= hot, 1)), F.max("size")).first()
        if count:
            spans.append(materialize(_edge_spans(edges.where(F.col("size") <= hot), max(16, -(-count // 4_000)), free), "suffix-spans"))
        if (largest or 0) <= hot:
            break
        # groups beyond the limit are split by longer grams, until they fit or nothing is left to compare
        narrowed, free = _narrowed(edges.where(F.col("size") > hot), free)
        narrow = materialize(narrowed, "suffix-narrow")
        full, left = _settled(narrow, "suffix-classes")
        spans.append(materialize(full, "suffix-spans"))
        names = left.select(F.col("h").alias("lh"), F.col("c").alias("lc"), F.col("site").alias("ls"), "size")
        itself = (narrow["h"] == names["lh"]) & (narrow["c"] == names["lc"]) & (F.col("site").bitwiseXOR(F.col("ls")) == 0)
        edges = materialize(narrow.join(names, itself).select(*narrow.columns, "size").dropDuplicates(["h", "c"]), "suffix-edges")
    return reduce(DataFrame.unionByName, spans)


def _site_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column(0).to_numpy().view(np.uint64)


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and the kept bytes, if asked for)."""
    ship_package(documents.sparkSession)
    texts = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("body", F.xxhash64("k", "t"))
    spans = repeated_spans(texts, hot).groupBy("k", "body").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    spans = spans.select(F.col("k").alias("sk"), F.col("body").alias("sb"), F.col("spans.from").alias("begins"), F.col("spans.to").alias("stops"))
    joined = texts.join(spans, texts["k"].eqNullSafe(spans["sk"]) & (texts["body"] == spans["sb"]), "left").select("k", "t", "begins", "stops")
    kind = documents.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in blocks(batches):
            removed, count, digests, kept = [], [], [], []
            for i, (begins, stops) in enumerate(zip(rows.column("begins").to_pylist(), rows.column("stops").to_pylist(), strict=True)):
                own = data[ends[i] : ends[i + 1]]
                gone = np.zeros(len(own) + 1, np.int32)
                if begins:
                    np.add.at(gone, begins, 1)
                    np.add.at(gone, stops, -1)
                mask = np.cumsum(gone[:-1]) > 0
                left = own[~mask].tobytes()
                removed.append(int(mask.sum()))
                count.append(int(np.sum(mask[1:] & ~mask[:-1])) + int(len(mask) > 0 and mask[0]))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = joined.mapInArrow(cut, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("k", key)
    return out if keep_text else out.drop("kept")
