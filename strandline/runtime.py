"""Session helpers shared by every operator: table access, scratch space and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
#: Tasks of a written stage for each core of the cluster, at most.
WAVES = 4
#: Rows of an Arrow batch, where the session does not say otherwise: whole texts are long rows, and a
#: batch stands in the JVM and in the Python worker of every task at once.
BATCH_ROWS, _BATCH_SETTING, _BATCH_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a dataset folder; any path that Spark can read works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for their Python workers."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    if getattr(context, "_strandline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="strandline-")
    target = os.path.join(folder, "strandline_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(target)
    context._strandline_shipped = True


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared place the cluster names in spark.checkpoint.dir.

    Where the setting is absent a temporary folder becomes the setting in a local session; on a
    cluster executors could not see such a folder, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, keys: Sequence[str], times: int = 1) -> DataFrame:
    """The rows dealt by their keys into as many partitions as the session's shuffles have, or a multiple, all kept.

    Adaptive execution merges partitions by their compressed bytes; short sorted rows take twenty times as many in
    memory, and a task would hold more of them the larger the input is. Rows that may already be dealt by these keys
    need a multiple: the same number again would be no new shuffle and leave them merged.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame, label: str, waves: int = WAVES) -> DataFrame:
    """Cut the lineage by writing to the shared folder and reading back.

    The files outlive any executor, so a lost executor costs only the tasks it ran. The last stage
    runs in so many waves of tasks at most: each task takes several partitions one after the other,
    which needs no more memory and leaves files of a useful size instead of one for each partition.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.coalesce(spark.sparkContext.defaultParallelism * waves).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing still to be computed reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
