"""Order within hot groups, and many unique keys in two scans."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from pactlake.operators import ordered, report
from pactlake.plans import validate as v


def hot(spark, n=20_000):
    """Nine rows in ten are one key's; some have no key."""
    k = F.when(F.rand(1) < 0.9, "hot").when(F.rand(5) < 0.01, None).otherwise(F.concat(F.lit("g"), F.floor(F.rand(2) * 50)))
    rows = spark.range(n).select(k.alias("k"), F.floor(F.rand(3) * 1000).alias("o"), "id", F.when(F.rand(4) >= 0.1, F.col("id")).alias("v"))
    return spark.createDataFrame(rows.collect(), rows.schema).repartition(5)


def diff(a, b):
    cols = sorted(b.columns)
    a, b = a.select(cols), b.select(cols)
    return a.count(), b.count(), a.exceptAll(b).count(), b.exceptAll(a).count()


def test_hot_groups_are_spread(spark):
    rows = hot(spark)
    w = Window.partitionBy("k").orderBy("o", "id")
    for limit in (10, 10**9):  # ranged, and by a plain window
        got = ordered.with_previous(rows, ["k"], ["o", "id"], "v", hot=limit)
        assert diff(got, rows.withColumn("prev", F.lag("v").over(w))) == (20_000, 20_000, 0, 0)
        got = ordered.with_number(rows, ["k"], ["o", "id"], hot=limit)
        assert diff(got, rows.withColumn("sequence_number", F.row_number().over(w).cast("long"))) == (20_000, 20_000, 0, 0)
    sizes = sorted(r["count"] for r in ordered.ranged(rows, ["k"], ["o", "id"]).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert ordered.with_number(rows.limit(0), ["k"], ["o", "id"]).count() == 0


def test_sequences_of_a_hot_group(spark, monkeypatch):
    rows = hot(spark, 4000)
    clause = {"kind": "sequence", "name": "s", "column": "o", "by": ["k"]}
    run = lambda: [tuple(r) for r in v.validate(rows, {"id": "a-1", "rules": [clause]}).collect()]
    breaks = lambda: sorted(tuple(r) for r in report.monotonic_violations(rows, "k", "o", "id").select("id", "prev").collect())
    plain = run(), breaks()
    monkeypatch.setattr(ordered, "HOT", 5)
    assert (run(), breaks()) == plain


def test_many_unique_keys_in_two_scans(spark, tmp_path):
    rows = [(1, "a", 0.0, None), (1, "b", -0.0, 1), (2, "b", 1.0, 1), (3, "c", float("nan"), 2), (3, "c", float("nan"), None), (None, "d", None, 3)]
    spark.createDataFrame(rows, "i int, s string, f double, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    contract = {
        "id": "t-1", "schema": {c: {"unique": True} for c in ("i", "s", "f", "n")},
        "rules": [{"kind": "unique", "name": "pair", "column": "i,s", "keys": ["i", "s"]}],
        "quality": {"checks": ["duplicate_count(n) = 0", "row_count >= 6", "max(i) <= 2"]}
    }
    out = v.validate(df, contract)
    got = {r.check_id: r for r in out.collect()}
    failing = {k: r.records_failing for k, r in got.items() if ".unique" in k or "pair" in k or "duplicate" in k}
    assert failing == {"t.i.unique": 4, "t.s.unique": 4, "t.f.unique": 4, "t.n.unique": 2, "t.pair": 2, "t.quality.n.duplicate_count": 2}
    assert got["t.pair"].sample_failing == ["3|c"] and sorted(got["t.i.unique"].sample_failing) == ["1", "3"]
    assert got["t.quality.max"] if "t.quality.max" in got else got["t.quality.i.max"].status == "FAIL"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= 5  # rows and lines, their samples, two for keys (sums and samples read the same exchange)
    one = v.duplicate_keys(df, [["i"], ["s"]])._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", one)) == 2


def test_keys_that_only_look_alike_are_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("1:a", "a"), ("1", ":aa")], "p string, q string")
    assert v.duplicate_keys(df, [["p", "q"]]).count() == 0
