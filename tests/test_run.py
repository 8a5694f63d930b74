"""Runs after one another: baselines, drift, breaker, gate, report."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from pactlake.plans.run import run
from pactlake.sources import versions

CONTRACT = {"id": "shop-orders", "schema": {"id": {"required": True, "unique": True}}, "quality": {"checks": ["row_count >= 1"]}}


def test_runs_end_to_end(spark, tmp_path):
    start, folder = datetime(2024, 1, 1, tzinfo=timezone.utc), str(tmp_path)
    data = lambda shift: spark.range(40).select("id", (F.col("id") % 5 + shift).alias("x"))
    go = lambda k, shift, mode="ENFORCE": run(data(shift), CONTRACT, folder, start + timedelta(minutes=k), mode, {"x": F.col("x")})
    first = go(0, 0)
    assert (first.action, first.mode, first.tripped) == ("PASS", "ENFORCE", [])
    assert {r.check_id for r in first.results.collect()} == {"shop.id.required", "shop.id.unique", "shop.quality.row_count"}  # a first metric says nothing
    second = go(1, 100)
    drifted = second.results.where("check_type = 'drift'").first()
    assert (drifted.check_id, drifted.status, drifted.severity) == ("shop.x.drift.mean", "FAIL", "HIGH") and second.action == "BLOCK"
    assert go(2, 100).action == "BLOCK"
    third = go(3, 100)
    assert (third.action, third.mode, third.tripped) == ("PASS", "WARN", ["shop.x.drift.mean"])  # the third within an hour
    again = go(3, 100)  # the same run once more isn't a fourth failure
    assert again.tripped == third.tripped and spark.read.parquet(f"{folder}/failures").count() == 3
    assert go(90, 100).mode == "ENFORCE" and go(91, 0).action == "PASS"
    doc = json.loads(spark.read.text(third.report).first()[0])
    assert (doc["contract_id"], doc["pipeline_action"], doc["mode"], doc["failed"]) == ("shop-orders", "PASS", "WARN", 1)
    assert spark.read.json(f"{folder}/modes").first().circuit_breaker_check_ids == ["shop.x.drift.mean"]
    assert versions.newest(spark, f"{folder}/baselines/shop-orders").first()["mean"] == 2.0  # the first run's, whatever came later
    assert run(data(0).limit(0), CONTRACT, folder, start + timedelta(days=1)).action == "PASS"
