"""Drift of statistics, rates and embeddings against stored baselines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_number
from ..session import bounded_batches


def column_stats(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """column, mean, std (population), n of every metric in one pass."""
    aggs = [
        F.struct(
            F.lit(k).alias("column"), F.avg(v.try_cast("double")).alias("mean"),
            F.stddev_pop(v.try_cast("double")).alias("std"), F.count(v.try_cast("double")).alias("n")
        ).alias(f"s{i}") for i,
        (k, v) in enumerate(metrics.items())
    ]
    return df.agg(*aggs).select(F.explode(F.array(*[f"s{i}" for i in range(len(metrics))])).alias("r")).select("r.*")


#: Metrics of contracts by id: name -> Column. Others are registered by the caller.
EXTRACTORS: dict[str, dict[str, Column | str]] = {}


def register_extractors(contract_id: str, **metrics: Column | str) -> None:
    """Metrics (columns or SQL) whose drift is watched for a contract."""
    EXTRACTORS.setdefault(contract_id, {}).update(metrics)


def contract_stats(df: DataFrame, contract_id: str) -> DataFrame:
    """Statistics of a contract's registered metrics; of all numeric columns, with least and greatest, if it has none."""
    found = EXTRACTORS.get(contract_id)
    if found:
        return column_stats(df, {k: F.expr(v) if isinstance(v, str) else v for k, v in sorted(found.items())})
    return every_column_stats(df)


def every_column_stats(df: DataFrame) -> DataFrame:
    """column, mean, std, n, min, max of every numeric column in one pass (an extension)."""
    names = [c for c, k in df.dtypes if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal")]
    v = lambda c: F.col(c).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.avg(v(c)).alias("mean"), F.stddev_pop(v(c)).alias("std"), F.count(v(c)).alias("n"),
            F.min(v(c)).alias("min"), F.max(v(c)).alias("max"),
        ).alias(f"s{i}") for i, c in enumerate(names)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, mean double, std double, n long, min double, max double")
    return df.agg(*rows).select(F.explode(F.array(*[f"s{i}" for i in range(len(rows))])).alias("r")).select("r.*")


def z_verdict(z: Column) -> Column:
    return F.when(z > 3, "FAIL").when(z > 2, "WARN").otherwise("PASS")


def drift(current: DataFrame, baseline: DataFrame, least: int = 10) -> DataFrame:
    """Full outer join by column: z = |difference of means| / baseline deviation, FAIL above 3, WARN above 2.

    Columns seen for the first time become baselines (from ``least`` values on).
    """
    b = baseline.select("column", F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    j = current.join(b, "column", "full_outer")
    z = F.abs(F.col("mean") - F.col("base_mean")) / F.greatest(F.col("base_std"), F.lit(1e-9))
    verdict = F.when(F.col("mean").isNull(), "MISSING").when(
        F.col("base_mean").isNull(), F.when(F.col("n") >= least, "BASELINE_SET").otherwise("WARN")
    ).otherwise(z_verdict(z))
    return j.withColumn("z", z).withColumn("status", verdict)


def as_results(drifted: DataFrame, prefix: str) -> DataFrame:
    """Check results of a drift: nothing for columns seen for the first time, HIGH for failures, MEDIUM for warnings."""
    fails, warns = F.col("status") == "FAIL", F.col("status") == "WARN"
    new = F.col("base_mean").isNull()
    shown = F.concat(
        F.lit("current_mean="), short_number(F.col("mean"), 6), F.lit(", baseline_mean="),
        short_number(F.col("base_mean"), 6), F.format_string(", z=%.3f_std", "z")
    )
    expected = F.when(new, "enough values for a baseline").otherwise("within 3 std of baseline mean (FAIL beyond); WARN beyond 2 std")
    message = F.when(fails, "The mean moved by more than three deviations.").when(
        warns & ~new, "The mean moved by more than two deviations."
    ).when(warns, "Too few values for a baseline.").otherwise("")
    return drifted.where(F.col("status").isin("PASS", "WARN", "FAIL")).select(
        F.concat(
            F.lit(f"{prefix}."), "column", F.lit(".drift.mean")
        ).alias("check_id"), F.col("column").alias("column_name"), F.lit("drift").alias("check_type"), "status",
        F.when(
            new, F.format_string("n=%d", "n")
        ).otherwise(shown).alias("actual_value"), expected.alias("expected"), F.when(fails, "HIGH").when(warns, "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(fails | warns, F.col("n")).otherwise(0).cast("long").alias("records_failing"), F.array().cast("array<string>").alias("sample_failing"), message.alias("message"),
    )


#: Runs kept in a rate's history.
HISTORY = 24


def output_rate(df: DataFrame, field: str, allowed: list[str] | None, state: dict | None, at: str) -> tuple[dict, dict]:
    """(result, next state) of a run. state: baseline_rate, metric_field, allowed, rate_history.

    The first run, and one whose metric is another field, sets the baseline. Without
    an allow-list the first run's values are frozen as one; they are the kinds of a
    field, and more than KINDS of them are an error.
    """
    fresh = not state or state.get("metric_field") != field
    if allowed is None:
        allowed = None if fresh else state.get("allowed")
    if allowed is None:
        seen = df.select(F.col(field).cast("string").alias("v")).where("v is not null").distinct().limit(KINDS + 1).collect()
        if len(seen) > KINDS:
            raise ValueError(f"{field} has more than {KINDS} values: it has no allow-list")
        allowed = sorted(r.v for r in seen)
    base = None if fresh else state["baseline_rate"]
    r = violation_rate(df, field, allowed, base).first()
    history = [] if fresh else list(state.get("rate_history") or [])
    history = [*history, {"at": at, "rate": r.rate, "total": r.total}][-HISTORY:]
    out = {
        "metric_field": field, "total_outputs": r.total, "violations": r.violations, "violation_rate": r.rate,
        "baseline_rate": r.rate if base is None else base, "trend": r.trend,
        "status": "BASELINE_SET" if fresh and r.status == "PASS" else r.status
    }
    return out, {"baseline_rate": out["baseline_rate"], "metric_field": field, "allowed": allowed, "rate_history": history}


#: Most values of an allow-list.
KINDS = 10_000


def violation_rate(
    df: DataFrame, field: str, allowed: list[str], baseline: float | None = None, by: list[str] | None = None,
    warn: float = 0.05, rising: float = 1.5, falling: float = 0.5
) -> DataFrame:
    """Share of values outside the allowed ones (null is outside), its trend against a baseline, and a warning."""
    bad = F.count_if(~F.coalesce(F.col(field).isin(allowed), F.lit(False)))
    n = F.count(F.lit(1))
    out = (df.groupBy(*by) if by else df.groupBy()).agg(n.alias("total"), bad.alias("violations"))
    out = out.withColumn("rate", F.col("violations") / F.greatest(F.col("total"), F.lit(1)))
    base = F.lit(baseline) if baseline is not None else F.col("rate")
    trend = F.when(F.col("rate") > base * rising, "rising").when(F.col("rate") < base * falling, "falling").otherwise("stable")
    return out.withColumn("trend", trend).withColumn(
        "status", F.when((F.col("trend") == "rising") | (F.col("rate") > warn), "WARN").otherwise("PASS")
    )


def centroid(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """Mean vectors; positions are averaged apart, then put in order."""
    keys = by or []
    e = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-12)


#: Bytes of a text that are counted at once: counting makes eight bytes of each.
PIECE = 1 << 16


def byte_histogram(df: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """The local embedding as rows: (key, byte, share) of a text's UTF-8 bytes, or of its first ``most``, to length 1.

    Bytes are counted in Arrow batches, 256 counts a text: no row is made of a byte and nothing is shuffled. Each row is a text of its own.
    A batch is bounded in bytes and rows, and its texts are read piece by piece where they lie in it, so a worker's memory is that of a
    batch, or of the longest text, and doesn't depend on the table.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def counts(texts: pa.Array) -> pa.Array:
        col = texts.cast(pa.large_binary())
        _, at, data = col.buffers()
        at = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        n = np.zeros((len(col), 256), np.int32)
        for i in range(len(col)):
            for k in range(at[i], at[i + 1], PIECE):
                n[i] += np.bincount(data[k : min(k + PIECE, at[i + 1])], minlength=256)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, 256, dtype=np.int32)), pa.array(n.reshape(-1)))

    whole = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = counts(whole if most is None else F.substring(whole, 1, most))
    norm = F.sqrt(F.aggregate("n", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) + 1e-9
    e = df.select(key, n.alias("n")).select(key, norm.alias("norm"), F.posexplode("n").alias("byte", "n")).where("n > 0")
    return e.select(key, "byte", (F.col("n") / F.col("norm")).alias("share"))
