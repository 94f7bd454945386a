"""The job queue: every line of the claim table, streams against batches, repeated batches, and order."""

import random

import pytest
from pyspark.sql import functions as F

from weftspark.operators.folds import ordered_fold
from weftspark.streaming.job_queue import Policy, batch_decisions, ledger_sink, stream_decisions

EVENT = "queue string, seq long, at_ms long, job string, kind string, until_ms long, retry boolean"
POLICY = Policy(attempts=2, leases=2, lease_ms=100, job_ms=1000)


def answers(spark, steps, policy=POLICY):
    rows = [("q", i, at, job, kind, until, retry) for i, (at, job, kind, until, retry) in enumerate(steps)]
    got = batch_decisions(spark.createDataFrame(rows, EVENT), policy).collect()
    return [(r.answer, r.attempts) for r in sorted(got, key=lambda r: r.seq)]


def test_each_line_of_the_claim_table(spark):
    ask = lambda at, job, kind, until=None, retry=None: (at, job, kind, until, retry)
    assert answers(spark, [
        ask(0, "a", "claim"),  # 0: missing
        ask(1, "a", "publish"), ask(2, "a", "publish"),
        ask(1001, "a", "claim"), ask(1002, "a", "claim"),  # 1: expired, as often as it is asked for
        ask(1003, "a", "publish"), ask(1004, "a", "cache", 1200), ask(1005, "a", "claim"),  # 2: completed
        ask(1200, "a", "claim"),  # 4: lapsed
        ask(1201, "a", "publish"), ask(1202, "a", "claim"), ask(1203, "a", "claim"),  # 8 and 5: claimed, busy
        ask(1302, "a", "claim"), ask(1402, "a", "claim"),  # the lease ran out: claimed, then 6: exhausted
        ask(1403, "b", "publish"), ask(1403, "c", "publish"), ask(1403, "d", "publish"),
        ask(1404, "b", "claim"), ask(1404, "c", "claim"), ask(1404, "d", "claim"),  # 7: busy
        ask(1405, "b", "fail", None, True), ask(1406, "d", "claim"),  # back in the queue, its lease is free
        ask(1407, "d", "fail", None, False), ask(1407, "d", "claim"), ask(1408, "b", "claim"), ask(1409, "b", "fail", None, True),  # 3: failed; no attempt is left
        ask(1410, "c", "finish"), ask(1411, "c", "cache", 1500), ask(1412, "c", "finish"), ask(1413, "x", "finish"), ask(1414, "c", "guess"),
    ]) == [
        ("missing", 0), ("queued", 0), ("queued", 0), ("expired", 0), ("expired", 0), ("queued", 0), ("cached", 0), ("completed", 0), ("lapsed", 0), ("queued", 0), ("claimed", 1), ("busy", 1), ("claimed", 2), ("exhausted", 2),
        ("queued", 0), ("queued", 0), ("queued", 0), ("claimed", 1), ("claimed", 1), ("busy", 0), ("queued", 1), ("claimed", 1), ("failed", 1), ("failed", 1), ("claimed", 2), ("failed", 2), ("unavailable", 1), ("cached", 1), ("completed", 1), ("missing", 0), ("unknown", 1),
    ]


def random_events(n, seed):
    rng = random.Random(seed)
    return [(f"q{rng.randrange(3)}", i, 7 * i, f"j{rng.randrange(5)}", rng.choice(("publish", "claim", "claim", "cache", "finish", "fail")), 7 * i + rng.randrange(200), rng.random() < 0.7) for i in range(n)]


def test_a_stream_answers_as_a_batch(spark, tmp_path):
    provider, empty = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Else a run over what is available goes on with batches that only look at times to live.
    spark.conf.set(empty, "false")
    rows, policy = random_events(90, 4), POLICY._replace(lease_ms=400)
    try:
        for part in range(3):
            spark.createDataFrame(rows[part * 30 : part * 30 + 30], EVENT).coalesce(1).write.json(str(tmp_path / "in" / str(part)))
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        run = stream_decisions(stream, policy).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(150)
        got = sorted(map(tuple, spark.table("answers").collect()))
    finally:
        spark.conf.set(provider, old)
        spark.conf.unset(empty)
    assert got == sorted(map(tuple, batch_decisions(spark.createDataFrame(rows, EVENT), policy).collect()))
    assert {"claimed", "busy", "completed", "unavailable"} <= {r[4] for r in got}


def test_a_batch_that_comes_again_changes_nothing(spark):
    held = []
    sink = ledger_sink(lambda: held[-1] if held else None, held.append, "k", "v")
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v long, x string")
    sink(frame((1, 1, "a"), (2, 1, "b")), 0)
    sink(frame((1, 2, "c"), (3, 1, "d")), 1)
    assert len(held) == 2
    sink(frame((1, 9, "changed on the way")), 1)
    sink(frame((1, 9, "changed on the way")), 0)
    assert len(held) == 2
    sink(frame((2, 0, "old")), 2)
    assert sorted(tuple(r)[:3] for r in held[-1].collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_folds_carry_state_over_arrow_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spark.range(500).select((F.col("id") % 3).alias("k"), (F.lit(500) - F.col("id")).alias("at"))

        def step(state, row):
            state[0] += row.at
            return row.k, row.at, state[0]

        got = ordered_fold(rows, "k", ["at"], lambda _: [0], step, "k long, at long, total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        total = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.at):
            total += r.at
            assert r.total == total
