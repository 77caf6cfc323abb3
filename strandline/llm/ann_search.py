"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` hash tables projects a vector on `hashes` Gaussian directions and floors the
result in steps of `width`. All rows are indexed. A query visits its own bucket and the buckets
next to it in the order of their estimated success, `probes` for each table. Candidates from all
tables are merged and ranked by their exact distance.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than the commonest in the table. Of rows with equal vectors only the `k + 1` smallest ids can be
among the nearest, so only they are indexed; this keeps a vector that a third of the rows share
from filling a bucket. A bucket of more than `bucket_rows` rows is dealt over several groups, each of
which sees the query. A query that finds fewer than k candidates is searched exactly, in blocks.
Rows of the query's own id are no candidates; repeated rows count once. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import materialize, ship_package

QUERY_BLOCK = 1000


class PStableTables:
    """Directions and offsets of all tables, from a seed."""

    def __init__(self, dimension: int, tables: int, hashes: int, width: float, probes: int, seed: int = 3):
        random = np.random.default_rng(seed)
        self.tables, self.hashes, self.width, self.probes = tables, hashes, width, probes
        self.directions = random.normal(size=(dimension, tables * hashes))
        self.offsets = random.uniform(0, width, tables * hashes)
        self.mixers = random.integers(1, 1 << 62, hashes).astype(np.int64) | 1
        order = _probe_order(hashes, probes)
        self.sets = np.zeros((len(order), 2 * hashes), np.float32)
        for i, chosen in enumerate(order):
            self.sets[i, list(chosen)] = 1

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates (row, table, hash), and the place inside each cell from 0 to 1."""
        scaled = ((vectors @ self.directions + self.offsets) / self.width).reshape(len(vectors), self.tables, self.hashes)
        whole = np.floor(scaled)
        return whole.astype(np.int64), scaled - whole

    def codes(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mixers).sum(-1)

    def probed(self, vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For each vector and table the codes of its probes, likeliest first.

        The 2 x hashes steps to a neighbouring cell are sorted by the squared distance to its wall;
        the sets of steps are tried in the order of their expected total.
        """
        cells, inside = self.cells(vectors)
        axes, signs = np.tile(np.arange(self.hashes), 2), np.repeat([-1, 1], self.hashes)
        rows = np.arange(2 * self.hashes)
        for row in range(len(vectors)):
            for table in range(self.tables):
                x = inside[row, table]
                ranked = np.argsort(np.concatenate([x, 1 - x]), kind="stable")
                step = np.zeros((2 * self.hashes, self.hashes), np.float32)
                step[rows, axes[ranked]] = signs[ranked]
                possible = (self.sets @ np.abs(step)).max(1) <= 1  # not both walls of one axis
                steps = (self.sets[possible][: self.probes] @ step).astype(np.int64)
                yield row, table, self.codes(cells[row, table] + steps)


def _probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks of steps by their expected cost, from the expected wall distances of each rank."""
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < 2 * probes:  # a set that takes both walls of an axis is skipped later
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - c in chosen for c in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(vec_id, v): rows whose vectors can take part: those of the given length, else of the commonest one."""
    v = F.col("v")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & fine)
    if size is None:
        sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        size = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("v") == size)


def hashes_for(vectors: int) -> int:
    """8 hashes up to 110,000 vectors, and one more for each factor of 11.

    The nearest of many vectors are nearer, so more hashes find them still; with the number fixed, a query would see
    the same share of ever more vectors.
    """
    return 8 + max(0, math.floor(math.log(max(vectors, 1) / 10_000, 11)))


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = 8, hashes: int | None = None, width: float = 2.0, probes: int = 200, bucket_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row; hashes by the number of vectors, if not given."""
    spark = df.sparkSession
    ship_package(spark)
    rows = usable(df, key, vector)
    dimension = rows.select(F.size("v")).first()
    asked = usable(queries, key, vector, dimension[0] if dimension else 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    same = Window.partitionBy("v").orderBy("vec_id")
    base = materialize(rows.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).select("vec_id", "v"), "nearest-base")
    first = asked.select(F.size("q")).first()
    if first is None:
        return spark.createDataFrame([], f"query_id {df.schema[key].dataType.simpleString()}, rank int, vec_id {df.schema[key].dataType.simpleString()}, score double")
    count = base.count()
    hashes = hashes or hashes_for(count)
    shared = spark.sparkContext.broadcast(PStableTables(first[0], tables, hashes, width, probes))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cells, _ = shared.value.cells(_matrix(part.column(1)))
                codes = shared.value.codes(cells)
                take = pa.array(np.repeat(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(codes.ravel()), part.column(0).take(take), part.column(1).take(take)], names=["t", "code", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                found = list(shared.value.probed(_matrix(part.column(1))))
                sizes = [len(c) for _, _, c in found]
                take = pa.array(np.repeat([r for r, _, _ in found], sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([t for _, t, _ in found], sizes), pa.int32()), pa.array(np.concatenate([c for _, _, c in found])), part.column(0).take(take), part.column(1).take(take)], names=["t", "code", "id", "v"])

    kind, item = df.schema[key].dataType.simpleString(), df.schema[vector].dataType.simpleString()
    shape = f"t int, code long, id {kind}, v {item}"
    filed = base.mapInArrow(index, shape)
    hot = filed.groupBy("t", "code").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("t", "code", F.ceil(F.col("n") / bucket_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    filed = filed.join(hot, ["t", "code"], "left").select("t", "code", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), "id", "v", F.lit(False).alias("asks"))
    probes_of = asked.mapInArrow(probe, shape).join(hot, ["t", "code"], "left").select("t", "code", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "id", "v", F.lit(True).alias("asks"))
    groups = max(16, -(-count * tables // 20_000))
    dealt = filed.unionByName(probes_of).withColumn("group", F.pmod(F.xxhash64("t", "code", "salt"), F.lit(groups)))

    def rank(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        code, table = group.column("code").to_numpy(), group.column("t").to_numpy()
        with np.errstate(over="ignore"):
            cell = code * np.int64(31) + table * np.int64(0x5851F42D4C957F2D)
        held = np.flatnonzero(~asks)
        held = held[np.argsort(cell[held], kind="stable")]
        ask = np.flatnonzero(asks)
        low, high = np.searchsorted(cell[held], cell[ask], "left"), np.searchsorted(cell[held], cell[ask], "right")
        ids, vectors = group.column("id").to_numpy(), _matrix(group.column("v")) if len(group) else np.zeros((0, 1))
        best: dict = {}
        order = np.argsort(ids[ask], kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(ids[ask][order])) + 1) if len(order) else []:
            places = np.concatenate([held[low[i] : high[i]] for i in mine]) if len(mine) else held[:0]
            places = places[ids[places] != ids[ask[mine[0]]]]
            if len(places):
                names, at = np.unique(ids[places], return_index=True)
                gaps = np.sqrt(((vectors[places[at]] - vectors[ask[mine[0]]]) ** 2).sum(1))
                top = np.lexsort((names, gaps))[:k]
                best[ids[ask[mine[0]]]] = (names[top], gaps[top])
        return pa.table({
            "query_id": pa.array(np.repeat(list(best), [len(n) for n, _ in best.values()]) if best else [], group.schema.field("id").type),
            "vec_id": pa.array(np.concatenate([n for n, _ in best.values()]) if best else [], group.schema.field("id").type),
            "score": pa.array(np.concatenate([g for _, g in best.values()]) if best else [], pa.float64()),
        })

    result = f"query_id {kind}, vec_id {kind}, score double"
    found = materialize(_top(dealt.groupBy("group").applyInArrow(rank, result).distinct(), k), "nearest-found")
    short = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "query_id", "left_anti")
    return _top(found.join(short.select("query_id"), "query_id", "left_anti").select("query_id", "vec_id", "score").unionByName(_exact(base, short, k, kind)), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(base: DataFrame, short: DataFrame, k: int, kind: str) -> DataFrame:
    """The k nearest of every row of `short` among all of base: blocks of queries against all rows."""
    spark = base.sparkSession
    asked = short.count()
    parts = [spark.createDataFrame([], f"query_id {kind}, vec_id {kind}, score double")]
    blocks = -(-asked // QUERY_BLOCK)
    for block in range(blocks):
        rows = short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, data = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                out = []
                for i, v in zip(ids, vectors, strict=True):
                    gaps = np.sqrt(((data - v) ** 2).sum(1))
                    gaps[names == i] = np.inf
                    top = np.lexsort((names, gaps))[:k]
                    out += [(i, n, g) for n, g in zip(names[top].tolist(), gaps[top].tolist(), strict=True) if g < np.inf]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], batch.schema.field(0).type), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])

        if rows:
            parts.append(_top(base.mapInArrow(scan, f"query_id {kind}, vec_id {kind}, score double"), k).drop("rank"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
