"""Samples of windows, and state in versions."""

import random

from pyspark.sql import functions as F

from pactlake.operators import rolling
from pactlake.sources import versions

KIND = "id long, v double, ts timestamp"


def rows_of(spark, rows, parts):
    return spark.createDataFrame(rows, "id long, v double, at string").select("id", "v", F.to_timestamp("at").alias("ts")).repartition(parts)


def test_samples_are_the_same_however_they_are_made(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.random(), f"2024-01-{1 + i % 6:02d} {i % 24:02d}:00:00") for i in range(3000)]
    rows += [(7, 5.0, "2024-01-02 01:00:00"), (7, 4.0, "2024-01-02 01:00:00"), (None, 1.0, "2024-01-02 01:00:00"), (9, 1.0, None)]
    out = lambda s: sorted(tuple(r) for r in s.rows().select("window", "id", "v").collect())
    one = rolling.Sample(spark, str(tmp_path / "one"), "id", k=20, keep=4)
    one.take(rows_of(spark, rows, 1), "ts")
    many = rolling.Sample(spark, str(tmp_path / "many"), "id", k=20, keep=4)
    for part in (rows[2000:], rows[:900], rows[900:2000], rows[:900]):  # late, and again
        many.take(rows_of(spark, part, 7), "ts")
    assert out(one) == out(many) and len(out(one)) == 80
    windows = sorted({w for w, *_ in out(one)})
    assert len(windows) == 4 and windows[-1] - windows[0] == 3
    hashes = {r.id: r.h for r in spark.range(3000).select("id", F.xxhash64("id").alias("h")).collect()}
    mine = [i for i in range(3000) if i % 6 == 5]
    assert sorted(i for w, i, _ in out(one) if w == windows[-1]) == sorted(sorted(mine, key=hashes.get)[:20])
    assert sorted({r.window for r in many.rows(2).collect()}) == windows[-2:]
    assert versions.versions(spark, str(tmp_path / "many")) == [2, 3]


def test_a_hot_key_counts_once(spark):
    rows = spark.createDataFrame([(1, float(i % 3)) for i in range(500)] + [(i, 0.5) for i in range(2, 9)], "id long, v double").repartition(5)
    got = sorted(tuple(r) for r in rolling.bottom_k(rows, "id", 8).collect())
    assert got == [(1, 0.0), *[(i, 0.5) for i in range(2, 9)]]
    assert rolling.bottom_k(rows.limit(0), "id", 8).count() == 0


def test_readers_have_the_old_state_until_the_new_is_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    assert versions.newest(spark, path) is None
    for n in range(3):
        assert versions.write(spark.range(n + 1), path) == n
    old = versions.newest(spark, path)
    versions.write(old.where("id > 0"), path)  # made from what it replaces
    assert old.count() == 3 and versions.newest(spark, path).count() == 2
    (tmp_path / "s" / "version=3" / "_SUCCESS").unlink()
    assert versions.newest(spark, path).count() == 3
