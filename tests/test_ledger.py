"""The bucketed state with its ledger, and the tables kept by content."""

import os
import random

from pyspark.sql import functions as F

from strandline.sources.cache import KeptTables, fingerprint
from strandline.streaming import ledger

SHAPE = "resource_id string, type string, sequence long"


def batches(rng, n):
    return [[(f"r{rng.randrange(25)}", rng.choice(["CREATE", "UPDATE", "DELETE"]), rng.randrange(60)) for _ in range(rng.randrange(0, 12))] for _ in range(n)]


def test_state_equals_a_plain_fold(spark, tmp_path):
    path, state = str(tmp_path / "state"), {}
    seen = []
    write = ledger.batch_writer(path, 8, lambda actions, n: seen.append((n, sorted(map(tuple, actions.collect())))))
    for n, rows in enumerate(batches(random.Random(1), 8)):
        batch = spark.createDataFrame([*rows, (None, "CREATE", 99)], SHAPE)
        write(batch, n)
        write(batch, n)  # a retry after the commit does nothing
        last = {r: max((s, t) for x, t, s in rows if x == r) for r, _, _ in rows}
        want = []
        for r, (s, t) in last.items():
            held = state.get(r)
            newer = held is None or s > held[0]
            want.append((r, "skip" if not newer else "fetch" if t != "DELETE" else "remove" if held and held[1] != "DELETE" else "skip"))
        assert seen[-1] == (n, sorted(want)) and len(seen) == n + 1
        for r, entry in last.items():
            state[r] = max(state.get(r, entry), entry)
        got = {r.resource_id: (r.sequence, r.type) for r in ledger.current(spark, path, batch.schema).collect()}
        assert got == state
    done, versions = ledger.held_versions(spark, path)
    assert done == 7 and len(set(versions.values())) > 1  # buckets that a batch did not touch stay as they were
    assert len([n for n in os.listdir(tmp_path / "state/ledger") if n.endswith(".json")]) == 2


def test_a_batch_that_fails_before_its_commit_is_done_again(spark, tmp_path):
    path = str(tmp_path / "state")
    ledger.batch_writer(path, 4)(spark.createDataFrame([("a", "CREATE", 1)], SHAPE), 0)

    def fail(actions, n):
        raise RuntimeError("no upstream")

    rows = spark.createDataFrame([("a", "DELETE", 2), ("b", "CREATE", 3)], SHAPE)
    try:
        ledger.batch_writer(path, 4, fail)(rows, 1)
        raise AssertionError("must fail")
    except RuntimeError:
        pass
    assert [tuple(r) for r in ledger.current(spark, path, rows.schema).collect()] == [("a", "CREATE", 1)]
    ledger.batch_writer(path, 4)(rows, 1)
    assert sorted(map(tuple, ledger.current(spark, path, rows.schema).collect())) == [("a", "DELETE", 2), ("b", "CREATE", 3)]


def test_stream(spark, tmp_path):
    source = tmp_path / "log"
    for n in range(3):
        spark.createDataFrame([(f"r{i}", "CREATE", 10 * n + i) for i in range(n, n + 4)], SHAPE).coalesce(1).write.mode("append").parquet(str(source))
        ledger.keep_state(spark.readStream.schema(SHAPE).parquet(str(source)), str(tmp_path / "state"), str(tmp_path / "checkpoint"), 4).awaitTermination()
    got = {r.resource_id: r.sequence for r in ledger.current(spark, str(tmp_path / "state"), spark.createDataFrame([], SHAPE).schema).collect()}
    assert got == {"r0": 0, "r1": 11, "r2": 22, "r3": 23, "r4": 24, "r5": 25}


def test_kept_tables_rerun_only_what_changed(spark, tmp_path):
    """A late setting reruns the late stage, an input that changed reruns both; versions are bounded."""
    source, made = str(tmp_path / "in"), []
    spark.range(50).write.parquet(source)
    kept = KeptTables(spark, str(tmp_path / "kept"), keep=2)

    def run(scale):
        def first():
            made.append("aligned")
            return spark.read.parquet(source).withColumn("v", F.col("id") % 7)

        aligned, digest = kept.table("aligned", {}, [fingerprint(spark, source)], first)

        def second():
            made.append("grouped")
            return aligned.groupBy((F.col("v") * scale).alias("g")).agg(F.count("*").alias("n"))

        return kept.table("grouped", {"scale": scale}, [digest], second)[0]

    assert run(1).count() == 7 and made == ["aligned", "grouped"]
    assert run(1).count() == 7 and len(made) == 2
    assert run(2).agg(F.max("g")).first()[0] == 12 and made[2:] == ["grouped"]
    run(3)
    assert len(os.listdir(tmp_path / "kept/grouped")) == 2
    spark.range(10).write.mode("append").parquet(source)
    assert run(3).agg(F.sum("n")).first()[0] == 60 and made[-2:] == ["aligned", "grouped"]
