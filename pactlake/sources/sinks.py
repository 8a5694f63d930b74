"""Where results go: reports, append-only logs, quarantine, state tables, contract and test files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def report(results: DataFrame, path: str, **header: str) -> None:
    """One JSON document: header, counts, and the array of results."""
    c = lambda s: F.count_if(F.col("status") == s)
    doc = results.agg(
        F.count(F.lit(1)).alias("total_checks"), c("PASS").alias("passed"), c("FAIL").alias("failed"),
        c("WARN").alias("warned"), c("ERROR").alias("errored"),
        F.collect_list(F.struct(*results.columns)).alias("results")
    )
    doc.select(*[F.lit(v).alias(k) for k, v in header.items()], "*").coalesce(1).write.mode("overwrite").json(path)


#: Keys of the strict report, in order; fixed names.
STRICT_KEYS = (
    "report_id", "contract_id", "snapshot_id", "run_timestamp", "total_checks", "passed", "failed", "warned", "errored",
    "results"
)


def with_pipeline(report_: dict[str, Any], mode: str, action: str) -> dict[str, Any]:
    """The decision of the gate right after the id; the other keys as they were."""
    mode = (mode or "AUDIT").upper()
    return {"report_id": report_.get("report_id"), "pipeline_action": action, "mode": mode} | {
        k: v for k, v in report_.items() if k not in ("report_id", "pipeline_action", "mode")
    }


def strict_report(report_: dict[str, Any], note: bool = False) -> dict[str, Any]:
    """Only the keys of the strict form, in order, and the note of an injected violation if it is asked for."""
    out = {k: report_[k] for k in STRICT_KEYS if k in report_}
    return out | {"injection_note": True} if note and report_.get("injection_note") else out


def append_mode_transition(spark: SparkSession, path: str, requested: str, effective: str, check_ids: list[str], at: str) -> None:
    """One line in the log of modes, where a circuit breaker changed one."""
    row = [(at, requested, effective, check_ids)]
    spark.createDataFrame(
        row,
        "run_timestamp string, runner_mode_requested string, runner_mode_effective string, circuit_breaker_check_ids array<string>"
    ).write.mode("append").json(path)


def json_document(spark: SparkSession, document: dict[str, Any], path: str) -> None:
    """A document of some kilobytes as one JSON file, in any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_centroid(drifted: DataFrame, path: str, at: Column, label: str = "default") -> None:
    """A run's centroid in the archive, a table of vectors by time."""
    drifted.where("centroid is not null").select(
        F.lit(label).alias("label"), at.alias("taken_at"), "n", "centroid"
    ).write.mode("append").parquet(path)


def latest_centroid(spark: SparkSession, path: str, label: str = "default") -> list[float] | None:
    """The newest vector of the archive; None without one."""
    found = load_state(spark, path, "label string, taken_at timestamp, n long, centroid array<double>")
    row = found.where(F.col("label") == label).agg(F.max_by("centroid", "taken_at").alias("c")).first()
    return None if row is None or row.c is None else list(row.c)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table: its newest version, or a plain table; an empty one where there is none yet."""
    found = versions.newest(spark, path, schema)
    if found is not None:
        return found
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def quarantine(bad: DataFrame, path: str, run_id: str) -> None:
    """Rows of a run; writing the run again replaces them, so it is idempotent."""
    bad.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def state(table: DataFrame, path: str) -> None:
    """A keyed state table and when it was written, as a new version: readers have the old one until it is whole."""
    versions.write(table.drop("written_at").withColumn("written_at", F.current_timestamp()), path)


def dbt_tests(contract: dict[str, Any]) -> dict[str, Any]:
    """dbt column tests from a contract's own clauses."""
    cols = []
    for name, spec in (contract.get("schema") or {}).items():
        tests: list[Any] = [t for t, on in (("not_null", spec.get("required")), ("unique", spec.get("unique"))) if on]
        if spec.get("enum"):
            tests.append({"accepted_values": {"values": list(spec["enum"])}})
        for r in contract.get("rules") or []:
            if r.get("kind") == "reference" and r.get("column") == name:
                tests.append({"relationships": {"to": r.get("to"), "field": r.get("key")}})
        cols.append({"name": name, **({"tests": tests} if tests else {})})
    return {"version": 2, "models": [{"name": contract["id"].replace("-", "_"), "columns": cols}]}


def to_yaml(data: dict[str, Any]) -> str:
    import yaml

    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


def write_yaml(spark: SparkSession, data: dict[str, Any], path: str) -> None:
    """A contract as YAML, keys in their order, in any store that Spark writes to."""
    spark.createDataFrame([(to_yaml(data).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
