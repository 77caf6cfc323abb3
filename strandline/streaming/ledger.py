"""A change log kept as the latest state of each resource, by buckets and with a ledger.

State lies in data/version=N/bucket=B; the ledger, one small file for each batch, says which version of each bucket
holds. A batch writes only the buckets its resources fall in, then its ledger file, whose rename is the commit. A
batch that is retried after its commit does nothing, before it writes the same again; readers see one whole version.
Versions that neither the last ledger nor the one before names are deleted, so a reader of the last one is never cut off.

Rows of a log are (resource_id, type, sequence, further columns); of one resource the entry of the largest sequence
holds, and one that is not newer than what is held changes nothing. Null resources are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELETE = "DELETE"


class _Files:
    """The few file operations the ledger needs, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(folder))] if self.fs.exists(self._path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """The file appears whole, by a rename, or not at all."""
        draft = self._path(f"{name}.draft")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(draft, self._path(name)):
            raise RuntimeError(f"could not commit {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _ledgers(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names("ledger") if n.endswith(".json"))


def held_versions(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """(last committed batch, -1 without one; the version of each bucket)."""
    files = _Files(spark, path)
    done = _ledgers(files)
    if not done:
        return -1, {}
    return done[-1], {int(b): v for b, v in json.loads(files.read(f"ledger/{done[-1]:012}.json")).items()}


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    places = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The state as of the last committed batch; deleted resources stay as such, so late entries do not revive them."""
    return _read(spark, path, held_versions(spark, path)[1], schema)


def latest(log: DataFrame) -> DataFrame:
    """The entry of the largest sequence of each resource; of several the one that is largest in all columns."""
    fields = ["sequence", *(c for c in log.columns if c not in ("resource_id", "sequence"))]
    last = log.where("resource_id IS NOT NULL").groupBy("resource_id").agg(F.max(F.struct(*fields)).alias("entry"))
    return last.select("resource_id", "entry.*").select(*log.columns)


def planned_actions(changes: DataFrame, state: DataFrame) -> DataFrame:
    """(resource_id, action) of a batch: remove what is no longer listed, fetch what is new or newer, skip the rest.

    A resource that is not held needs no removal, and one that was removed comes back only by a newer entry.
    """
    held = state.select("resource_id", F.col("type").alias("held_type"), F.col("sequence").alias("held"))
    met = latest(changes).join(held, "resource_id", "left")
    newer = F.col("held").isNull() | (F.col("sequence") > F.col("held"))
    gone = F.col("held_type").isNull() | (F.col("held_type") == DELETE)
    action = F.when(~newer, "skip").when(F.col("type") != DELETE, "fetch").when(gone, "skip").otherwise("remove")
    return met.select("resource_id", action.alias("action"))


def batch_writer(path: str, buckets: int = 64, act: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. `act` is given the planned actions of a batch before its state is committed.

    It must bear being called again for the same batch, for a batch may fail after it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done, versions = held_versions(spark, path)
        if number <= done:
            return
        changes = latest(batch).persist()
        try:
            placed = changes.withColumn("bucket", F.pmod(F.xxhash64("resource_id"), F.lit(buckets)).cast("int"))
            touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())  # `buckets` numbers at most
            state = _read(spark, path, {b: versions[b] for b in touched if b in versions}, batch.schema)
            if act is not None:
                act(planned_actions(changes, state), number)
            merged = latest(state.unionByName(changes)).withColumn("bucket", F.pmod(F.xxhash64("resource_id"), F.lit(buckets)).cast("int"))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        finally:
            changes.unpersist()
        files = _Files(spark, path)
        files.commit(f"ledger/{number:012}.json", json.dumps(versions | dict.fromkeys(touched, number)))
        _expire(files)

    return apply


def _expire(files: _Files) -> None:
    kept = _ledgers(files)[-2:]
    named = {v for n in kept for v in json.loads(files.read(f"ledger/{n:012}.json")).values()}
    for name in files.names("data"):
        if int(name.split("=")[1]) not in named and int(name.split("=")[1]) < kept[-1]:
            files.delete(f"data/{name}")
    for n in _ledgers(files)[:-2]:
        files.delete(f"ledger/{n:012}.json")


def keep_state(log: DataFrame, path: str, checkpoint: str, buckets: int = 64, act: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keep the state of a streamed change log under `path`, as far as the log goes now."""
    return log.writeStream.foreachBatch(batch_writer(path, buckets, act)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
