"""One call from data and contract to report, log and gate."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import RESULT, prefix_of
from ..operators import drift, history
from ..operators import report as roll_up
from ..session import cut
from ..sources import control, sinks
from .validate import validate

BASELINE = "column string, mean double, std double, n long, established_at timestamp"
FAILURE = "contract_id string, check_id string, status string, severity string, records_failing long, at timestamp"


@dataclass(frozen=True)
class Run:
    """What a run decided: the gate's action, the mode it took, the checks whose breaker is open, and where the report lies."""

    results: DataFrame
    action: str
    mode: str
    tripped: list[str]
    report: str


def run(
    df: DataFrame, contract: dict, folder: str, at: datetime | None = None, mode: str = "ENFORCE",
    metrics: dict[str, Column] | None = None, least: int = 10, reset: bool = False
) -> Run:
    """Validate, compare with baselines, log failures, ask the circuit breaker, gate, report.

    ``folder`` holds what runs leave to one another: baselines in versions (a metric's first run with enough values sets its
    baseline, and says nothing), failures by contract, changes of mode, reports by name. Results are
    computed once and stored; what reaches the driver is the decision and the ids of checks whose breaker is open.
    A repeated run of the same time replaces its failures and its report.
    """
    spark, cid = df.sparkSession, contract["id"]
    at = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
    when = F.timestamp_micros(F.lit(int(at.timestamp() * 1_000_000)))
    results = validate(df, contract)
    known = f"{folder}/baselines/{cid}"
    if metrics or drift.EXTRACTORS.get(cid):
        found = drift.column_stats(df, metrics) if metrics else drift.contract_stats(df, cid)
        current = cut(found.select("column", "mean", "std", "n"))
        base = sinks.load_state(spark, known, BASELINE)
        results = results.unionByName(drift.as_results(drift.drift(current, base, least), prefix_of(cid)))
        sinks.state(history.next_baselines(current, base, when, least, reset), known)
    results = cut(results.select(RESULT.fieldNames()))
    failed = results.where(F.col("status").isin("FAIL", "WARN")).select(
        F.lit(cid).alias("contract_id"), "check_id", "status", "severity", "records_failing", when.alias("at")
    )
    log = f"{folder}/failures/of={re.sub('[^A-Za-z0-9]+', '_', cid)}"
    failed.write.mode("overwrite").parquet(f"{log}/run={at:%Y%m%dT%H%M%S%fZ}")
    logged = spark.read.schema(FAILURE).parquet(log).where(F.col("contract_id") == cid)
    open_ = roll_up.circuit_breaker(logged.where(F.col("status") == "FAIL"), "check_id", "at").where(F.col("tripped") & (F.col("at") == when))
    tripped = sorted(r.check_id for r in open_.select("check_id").distinct().collect())  # at most a contract's checks
    taken = "WARN" if tripped and mode not in ("AUDIT", "WARN") else mode
    if taken != mode:
        sinks.append_mode_transition(spark, f"{folder}/modes", mode, taken, tripped, at.isoformat())
    action = roll_up.gate(results, taken).first().pipeline_action
    path = f"{folder}/reports/{control.report_name(cid, at)}"
    sinks.report(results, path, contract_id=cid, run_timestamp=at.isoformat(), pipeline_action=action, mode=taken)
    return Run(results, action, taken, tripped, path)
