"""Intermediate tables kept by what they were made from: a changed setting of a late stage reruns only that stage.

The name of a table is the digest of its stage, its parameters and its inputs; an input is another kept table, or a
folder of files with their names, sizes and times. A table counts once Spark's writer has committed it. Older
versions of a stage are deleted beyond the `keep` newest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

COMMITTED = "_SUCCESS"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a file or a folder of files looks like from outside: names, sizes and times of change."""
    at, fs = _fs(spark, path)
    seen, left = [], [at]
    while left:
        for status in fs.listStatus(left.pop()):
            if status.isDirectory():
                left.append(status.getPath())
            else:
                seen.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()


class KeptTables:
    """Tables under one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def table(self, stage: str, parameters: Mapping[str, object], inputs: Sequence[str], make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """(the table, its digest, to be named as an input of later stages); `make` is called only where no such table is kept."""
        digest = hashlib.sha256(json.dumps([stage, sorted(parameters.items()), list(inputs)], default=str).encode()).hexdigest()
        path = f"{self.folder}/{stage}/{digest}"
        at, fs = _fs(self.spark, f"{path}/{COMMITTED}")
        if not fs.exists(at):
            make().write.mode("overwrite").parquet(path)
            self._expire(stage)
        return self.spark.read.parquet(path), digest

    def _expire(self, stage: str) -> None:
        at, fs = _fs(self.spark, f"{self.folder}/{stage}")
        old = sorted(fs.listStatus(at), key=lambda s: s.getModificationTime(), reverse=True)[self.keep :]
        for status in old:
            fs.delete(status.getPath(), True)
