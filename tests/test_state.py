"""What streams and runs keep: numbers that wait, moments, sketches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pactlake.operators import drift, moments
from pactlake.session import remove
from pactlake.streaming import enforce

KIND = "k string, n long, ts timestamp"


def feed(spark, src, i, rows):
    spark.createDataFrame(rows, "k string, n long, ts string").select("k", "n", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(f"{src}/p={i}")


def gaps(spark, at, out, late="10 minutes", idle=None):
    stream = spark.readStream.schema(KIND + ", p int").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = enforce.sequence_gaps(stream, "k", "n", "ts", late, idle).writeStream.format("parquet").outputMode("append")
    q = q.option("path", f"{at}/{out}").option("checkpointLocation", f"{at}/{out}-c").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.schema("k string, expected long, found long").parquet(f"{at}/{out}").collect())


BATCHES = [
    [("a", 2, "2024-01-01 00:01:00"), ("a", 1, "2024-01-01 00:00:00"), ("a", 4, "2024-01-01 00:03:00"), ("b", 7, "2024-01-01 00:00:00")],
    [("a", 3, "2024-01-01 00:02:00"), ("a", 6, "2024-01-01 00:05:00"), ("b", 9, "2024-01-01 00:02:00"), (None, 1, "2024-01-01 00:02:00")],
    [("c", 1, "2024-01-01 01:00:00"), ("a", 5, "2024-01-01 00:04:00"), ("c", 3, None)],
    # 8 is later than the watermark; a repeat is a break
    [("b", 8, "2024-01-01 00:02:00"), ("c", 2, "2024-01-01 02:00:00"), ("c", 2, "2024-01-01 02:00:00"), ("a", None, "2024-01-01 02:00:00")],
    [("z", 2, "2024-01-03 03:00:00")], [("c", 9, "2024-01-03 03:00:00"), ("z", 3, "2024-01-04 03:00:00")]
]


def test_late_numbers_close_their_gap(spark, tmp_path):
    """Six batches out of order; runs start from the checkpoint of the one before."""
    seen = []
    for i, rows in enumerate(BATCHES):
        feed(spark, tmp_path / "in", i, rows)
        if i:
            seen.append(gaps(spark, tmp_path, "out", idle="1 day"))
    assert seen[0] == [] and seen[1] == [("b", 8, 9)]
    assert seen[-1] == [("b", 8, 9), ("c", 3, 2)]  # c's state is gone, so 9 is its first number


def test_runs_from_a_checkpoint_are_one_run(spark, tmp_path):
    """Without batches of no data, whose number depends on restarts, rows are filtered by the watermark of the batch before: 8 and 9 come in time."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for i, rows in enumerate([*BATCHES, [("b", 12, "2024-01-05 00:00:00")], [("z", 9, "2024-01-09 00:00:00")], [("z", 10, "2024-01-10 00:00:00")]]):
            feed(spark, tmp_path / "in", i, rows)
            if i % 3 == 2:
                pieces = gaps(spark, tmp_path, "pieces")
        assert pieces == gaps(spark, tmp_path, "whole") == [("b", 10, 12), ("c", 3, 2), ("c", 3, 9)]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_moments_join(spark):
    rng = random.Random(1)
    rows = [(i % 7, 1e9 + rng.gauss(0, 1), f"{i}" if i % 3 else "x") for i in range(5000)] + [(0, float("nan"), None), (1, None, "inf")]
    df = spark.createDataFrame(rows, "part int, v double, s string").repartition(5)
    metrics = {"v": F.col("v"), "s": "s"}
    whole = {r.column: r for r in moments.moments(df, metrics).collect()}
    parts = moments.moments(df, metrics, ["part"])
    joined = {r.column: r for r in moments.merged(parts).collect()}
    v = [x for _, x, _ in rows if x is not None and x == x]
    assert joined["v"].n == len(v) and (joined["v"].min, joined["v"].max) == (min(v), max(v))
    for c in "vs":
        assert joined[c].n == whole[c].n
        assert joined[c].mean == pytest.approx(whole[c].mean, rel=1e-12)
        assert joined[c].m2 == pytest.approx(whole[c].m2, rel=1e-9)
    assert joined["v"].m2 / len(v) == pytest.approx(statistics.pvariance(v), rel=1e-6)
    base = {r.column: r for r in moments.baselines(parts, least=1).collect()}
    assert base["v"]["std"] == pytest.approx(statistics.pstdev(v), rel=1e-6)
    assert moments.baselines(parts, least=10**6).count() == 0
    # one part's moments are themselves
    assert moments.merged(parts.limit(0)).count() == 0


def test_baselines_learn_from_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "moments")
    rows = [[("a", 10 * b + i, f"2024-01-0{b + 1} 00:00:00") for i in range(10)] for b in range(6)]
    def run(upto):
        for i, r in enumerate(rows[:upto]):
            if not (src / f"p={i}").exists():
                feed(spark, src, i, r)
        stream = spark.readStream.schema(KIND + ", p int").option("maxFilesPerTrigger", 1).parquet(str(src))
        q = enforce.baseline_updates(stream, {"n": F.col("n")}, out, str(tmp_path / "c"), apart=2).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        return moments.Store(spark, out)

    for upto in (2, 6):
        store, seen = run(upto), [n for r in rows[:upto] for _, n, _ in r]
        got = store.baselines().first()
        assert (got.n, got["mean"], got["min"], got["max"]) == (len(seen), statistics.fmean(seen), min(seen), max(seen))
        assert got["std"] == pytest.approx(statistics.pstdev(seen), rel=1e-12)
    upto, apart = store._held()
    assert upto >= 0 and len(apart) == 2  # the others are folded
    # a replayed batch changes nothing, whether it is apart or folded in
    replay = moments.moments(spark.createDataFrame(rows[5], "k string, n long, ts string"), {"n": F.col("n")})
    store.put(apart[-1], replay)
    store.put(upto, replay)
    assert store.baselines().first() == got
    # a batch against those before it
    before = store.baselines(before=apart[-1])
    current = spark.createDataFrame([("n", 500.0, 1.0, 10)], "column string, mean double, std double, n long")
    assert before.first().n == 50 and drift.drift(current, before).first().status == "FAIL"
    # a folder without _SUCCESS isn't read
    remove(spark, f"{out}/batch={apart[-1]}/_SUCCESS")
    assert store.baselines().first().n == 50
