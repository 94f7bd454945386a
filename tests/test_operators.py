"""Operators against small hand-made cases and independent folds."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weftspark.operators import graphs, jobs, limiter, scoring, series
from weftspark.sources.html import parse_elements
from weftspark.streaming.admission import latest_by_key, stream_admission


def finding(spark, rows):
    return spark.createDataFrame(rows, "package string, id string, category string, severity string, confidence string, most double, work_group string, passed boolean")


def test_scoring_advisory_keeps_points_and_has_no_impact(spark):
    rules = spark.createDataFrame([("a", "foundation", "warning", "high", 10.0, None), ("b", "interaction", "warning", "high", 10.0, None), ("c", "states", "warning", "low", 10.0, None)], "id string, category string, severity string, confidence string, most double, work_group string")
    results = spark.createDataFrame([("p", "a", True), ("p", "b", False), ("p", "c", False)], "package string, id string, passed boolean")
    found = scoring.findings(results, rules)
    assert {r["id"]: r["status"] for r in found.collect()} == {"a": "pass", "b": "fail", "c": "advisory"}
    total = scoring.total_scores(scoring.category_scores(found, "package"), "package").first()
    assert (total["score"], total["grade"]) == (50, "F")


def test_nothing_applies_gives_null(spark):
    rules = spark.createDataFrame([("a", "foundation", "warning", "high", 10.0, None)], "id string, category string, severity string, confidence string, most double, work_group string")
    results = spark.createDataFrame([("p", "a", None)], "package string, id string, passed boolean")
    total = scoring.total_scores(scoring.category_scores(scoring.findings(results, rules), "package"), "package").first()
    assert total["score"] is None and total["grade"] is None


def days(spark, values):
    start = dt.date(2026, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(i), v) for i, v in enumerate(values)], "day date, n long")


def test_trailing_zeros(spark):
    kept = lambda values: [r["n"] for r in series.trim_trailing_zeros(days(spark, values), "n").orderBy("day").collect()]
    assert kept([1194, 1611, 0, 0]) == [1194, 1611]
    assert kept([1194, 0, 1611]) == [1194, 0, 1611]
    assert kept([0, 0]) == [0, 0]


def test_nearest_point_ties_go_back(spark):
    day = lambda k: dt.date(2026, 1, 1) + dt.timedelta(k)
    rng = np.random.default_rng(3)
    points = sorted({int(x) for x in rng.integers(0, 400, 25)})
    probes = [int(x) for x in rng.integers(-20, 430, 80)]
    got = series.nearest_point(spark.createDataFrame([(i, day(p)) for i, p in enumerate(probes)], "probe long, day date"), spark.createDataFrame([(day(p),) for p in points], "day date"))
    for r in got.collect():
        p = probes[r["probe"]]
        assert r["nearest"] == day(min(points, key=lambda q: (abs(q - p), q))), p


def test_decimation_keeps_ends_and_repeats_the_last_row():
    frame = pd.DataFrame({"series": "s", "at": range(200), "value": np.sin(np.arange(200.0))})
    out = series.decimate_points(frame, 10)
    assert len(out) == 10 and out["at"].iloc[0] == 0 and out["at"].iloc[-1] == 199
    assert out["at"].iloc[1] >= 25 and out["at"].iloc[-2] == 199
    assert len(series.decimate_points(frame, 2)) == 200


def requests(spark, rows):
    return spark.createDataFrame(rows, "seq long, ts_ms long, client string, repository string")


def test_limiter_denied_batch_consumes_nothing(spark):
    rows = [(i, 1000, "c", f"r{i}") for i in range(10)] + [(10, 1000, "c", "new")] + [(11 + i, 1000, f"d{i}", "new") for i in range(10)] + [(30, 600_000, "c", "x"), (31, 600_001, "c", "y")]
    out = {r["seq"]: r for r in limiter.replay(requests(spark, rows).withColumn("component", F.lit(0)), limiter.DEFAULT_RULES, "component").collect()}
    assert all(out[i]["allowed"] for i in range(10)) and not out[10]["allowed"]
    assert (out[10]["retry_at_ms"] - 1000 + 999) // 1000 == 600
    assert all(out[11 + i]["allowed"] for i in range(10))
    assert not out[30]["allowed"] and out[31]["allowed"]


def test_limiter_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(t), f"c{rng.integers(3)}", "r") for i, t in enumerate(np.sort(rng.integers(0, 3_000_000, 120)))]
    rules = (limiter.LimitRule("client-burst", "client", 5, 600_000),)
    whole = requests(spark, rows)
    want = {r["seq"]: r["allowed"] for r in limiter.replay(whole, rules, "client").collect()}
    for k in range(3):
        requests(spark, rows[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_admission(stream, rules).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["seq"]: r["allowed"] for r in spark.table("admitted").collect()} == want


def test_claim_table_lines(spark):
    ts = lambda d: dt.datetime(2026, 1, d)
    rows = [(1, ts(1), False, "queued", None, 0), (2, ts(20), True, "queued", None, 0), (3, ts(20), False, "failed", None, 0), (4, ts(20), False, "completed", None, 0), (5, ts(20), False, "running", ts(15), 1), (6, ts(20), False, "queued", None, 3), (7, ts(20), False, "queued", None, 0)]
    frame = spark.createDataFrame(rows, "job_id long, expires timestamp, hit boolean, state string, lease timestamp, attempts int")
    got = lambda cap: {r["job_id"]: r["decision"] for r in jobs.claims(frame, 3, cap, "2026-01-10 00:00:00").collect()}
    assert got(2) == {1: "expired", 2: "completed", 3: "terminal", 4: "terminal", 5: "busy", 6: "exhausted", 7: "claimed"}
    assert got(1)[7] == "busy"


def test_reach_and_prefix(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["hops"]) for r in graphs.reach(edges, roots, 5).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    paths, owners = spark.createDataFrame([("a/b/c.ts",), ("x/y.ts",)], "path string"), spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {(r["path"], r["owner"]) for r in graphs.longest_prefix(paths, owners).collect()} == {("a/b/c.ts", "a/b"), ("x/y.ts", None)}


def test_upsert_keeps_latest(spark):
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 2, "c")], "k int, v int, x string")
    once = latest_by_key(old, new, "k", "v")
    assert {tuple(r) for r in latest_by_key(once, new, "k", "v").distinct().collect()} == {(1, 2, "c"), (2, 1, "b")}


def test_elements_close_unclosed_children():
    rows = parse_elements('<nav><a href="/x"><b>one</a></nav><p>two<br><button><a>in</a></button>')
    tags = {e[1]: e for e in rows}
    assert tags["p"][3] == [] and tags["br"][2] == 1
    inner = rows[-1]
    assert inner[1] == "a" and [rows[i][1] for i in inner[3]] == ["p", "button"]


def test_nearest_point_orders_days_not_probes(spark):
    from datetime import date, timedelta

    from weftspark.operators.series import nearest_point

    start, dates = date(2023, 12, 20), (0, 9, 14, 15, 40, 100)
    points = spark.createDataFrame([(start + timedelta(d),) for d in dates], "day date")
    asked = [start + timedelta(d) for d in range(-40, 160)]
    probes = spark.createDataFrame([*enumerate(asked), (999, None)], "probe long, day date")
    want = {i: min((start + timedelta(d) for d in dates), key=lambda p: (abs((p - a).days), p)) for i, a in enumerate(asked)}
    got = {r.probe: r.nearest for r in nearest_point(probes, points).collect()}
    got.pop(999, None)
    assert got == want
    # 60,000 probes of one month: a frame read again for every row would take minutes.
    import time

    many = spark.range(60_000).select(F.col("id").alias("probe"), F.lit(start).alias("day"))
    began = time.time()
    assert nearest_point(many, spark.createDataFrame([(start + timedelta(1),)], "day date")).groupBy("nearest").count().collect()[0]["count"] == 60_000
    assert time.time() - began < 20


def test_fold_of_blocks_equals_the_fold_of_rows(spark):
    from weftspark.operators.folds import _blocks, ordered_fold, ordered_fold_of_blocks

    rows = spark.range(30_000).selectExpr("id as seq", "id * 7919 % 1000 as at", "case when id % 10 = 0 then id % 30 else 5 end as shard", "cast(id % 13 as string) as name")
    step = lambda held, r: (held.append(r.seq % 97) or r.seq, (sum(held[-5:]) * 31 + len(held)) % 1009, r.name)
    told = [fold(rows, "shard", ["at", "seq"], lambda _: [], step, "seq long, state long, name string") for fold in (ordered_fold, ordered_fold_of_blocks)]
    plain, packed = (sorted(map(tuple, t.collect())) for t in told)
    assert plain == packed and len(packed) == 30_000
    # The task that folds a shard orders far fewer rows than the shard has.
    assert _blocks(rows, "shard", ["at", "seq"]).count() < 300
    empty = ordered_fold_of_blocks(rows.where("seq < 0"), "shard", ["at", "seq"], lambda _: [], step, "seq long, state long, name string")
    assert empty.count() == 0


def test_large_shards_of_the_limiter_are_packed(spark):
    from weftspark.plans.registry import queries

    plan = queries()["q25_limiter_atomic_multi_rule"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" in plan and "MapInArrow" in plan
