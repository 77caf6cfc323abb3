"""Streams: a change log kept as latest state, windowed peaks, sessions and a keyed rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.intervals import micros


def reduce_mutations(log: DataFrame) -> DataFrame:
    """resource_id, type, sequence: the last entry of each resource."""
    last = log.groupBy("resource_id").agg(F.max_by("type", "sequence").alias("type"), F.max("sequence").alias("sequence"))
    return last.select("resource_id", "type", "sequence")


def feed_entry(pages: DataFrame, since: str | None) -> DataFrame:
    """The pages (token, next_token, number, snapshot, entries) that a reader who holds `since` has still to read.

    Without a token, or with one that the feed no longer knows, reading starts with the snapshot; with
    one it goes on behind the page that gave it.
    """
    known = pages.where(F.col("next_token") == F.lit(since)).agg(F.max("number").alias("_after"))
    return pages.crossJoin(F.broadcast(known)).where(F.when(F.col("_after").isNull(), F.lit(True)).otherwise((F.col("number") > F.col("_after")) & ~F.col("snapshot"))).drop("_after")


def read_feed(pages: DataFrame, since: str | None) -> tuple[DataFrame, str | None]:
    """(entries of the pages to read, with their sequence over all pages; the token to hold afterwards)."""
    due = feed_entry(pages, since)
    entries = due.select("number", F.posexplode("entries").alias("nth", "entry")).select((F.col("number") * 1_000_000 + F.col("nth")).alias("sequence"), "entry.resource_id", "entry.type")
    last = due.agg(F.max_by("next_token", "number").alias("token")).first()["token"]
    return entries, last if last is not None else since


def sync_changes(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of a change log under `path`: each micro-batch is one version, so a retry writes the same."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changes = reduce_mutations(batch)
        if number:
            changes = reduce_mutations(spark.read.parquet(f"{path}/version={number - 1}").unionByName(changes))
        changes.write.mode("overwrite").parquet(f"{path}/version={number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_peaks(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Largest value of each user and window; late rows are taken until the watermark passes."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy("user_id", F.window("at", width)).agg(F.max(F.abs("value")).alias("peak"), F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "peak", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def rate_limiter(events: DataFrame, limit: int = 3, window: int = 6 * 3_600_000_000) -> DataFrame:
    """The sliding-window limiter over a stream: the admitted times of each user are its state, at most `limit`."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        admitted = []
        for t in rows["t"].tolist():
            recent = [r for r in recent if t - r < window]
            admitted.append(len(recent) < limit)
            if admitted[-1]:
                recent.append(t)
        state.update((recent,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "admitted": admitted})

    timed = events.select("user_id", "event_id", micros("ts").alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
