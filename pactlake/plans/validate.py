"""Running clauses: one aggregation for all row clauses and quality lines, two scans for all unique keys, a plan each for the rest.

k row clauses cost one scan, not k. A second scan finds samples of failing rows,
the first few for each clause by row order; the ranking is limited within each
partition before its shuffle, so a clause that every row fails costs no more.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import RESULT, SAMPLES, Clause, prefix_of
from ..operators.ordered import with_previous
from .clauses import compile_contract, with_rules

ORD = "__ord"


def with_order(df: DataFrame) -> DataFrame:
    return df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())


def _none() -> Column:
    return F.array().cast("array<string>")


def _result(
    clause: Clause, failing: Column, applied: Column, actual: Column | None = None, samples: Column | None = None,
    message: Column | None = None
) -> Column:
    """A result row. Whatever passes is LOW; warnings and errors are WARNING, so that they don't block."""
    failed = failing > 0
    none = ~failed & (applied == 0)
    status = F.when(failed, clause.on_fail).otherwise(F.when(none, F.lit(clause.empty)).otherwise("PASS"))
    count = F.concat(F.lit(f"{clause.said[0]}="), failing.cast("string"))
    said = message if message is not None else F.replace(F.lit(clause.message), F.lit("{n}"), failing.cast("string"))
    on_pass = F.lit(clause.params.get("always", ""))
    if clause.empty == "WARN":
        ok = F.when(none, "no values").otherwise(clause.said[1])
        on_pass = F.when(none, "No values were found, so the check was not applied.").otherwise(on_pass)
    else:
        ok = F.lit(clause.said[1])
    expected = F.when(failed, str(clause.expected)).otherwise(str(clause.expected_ok or clause.expected))
    return F.struct(
        F.lit(clause.check_id).alias("check_id"), F.lit(clause.column).alias("column_name"), F.lit(clause.check_type).alias("check_type"), status.alias("status"),
        F.when(failed, actual if actual is not None else count).otherwise(ok).alias("actual_value"), expected.alias("expected"),
        F.when(failed, clause.severity).when(none & F.lit(clause.empty == "WARN"), "WARNING").otherwise("LOW").alias("severity"),
        failing.cast("long").alias("records_failing"), (
            samples if samples is not None else _none()
        ).alias("sample_failing"), F.when(failed, said).otherwise(on_pass).alias("message"),
    )


def row_results(df: DataFrame, clauses: list[Clause], samples: bool = True, lines: list[Clause] | None = None) -> DataFrame:
    """Results of row clauses, and of quality lines (``lines``) over the same one aggregation."""
    aggs, lines = [], lines or []
    for i, c in enumerate(clauses):
        p = c.params
        aggs.append(p.get("failing", F.count_if(F.coalesce(c.bad, F.lit(False)))).alias(f"f{i}"))
        aggs.append((F.count_if(c.applies) if c.applies is not None else F.count(F.lit(1))).alias(f"n{i}"))
        aggs += [p[k].alias(f"{k}{i}") for k in ("actual", "message") if isinstance(p.get(k), Column)]
    aggs += _line_aggs(lines)
    one = df.agg(*aggs)
    made = lambda k, i, c: F.col(f"{k}{i}") if isinstance(c.params.get(k), Column) else None
    plain = lambda i, c: F.lit(c.params["message"]) if isinstance(c.params.get("message"), str) else made("message", i, c)
    rows = [
        _result(c, F.coalesce(F.col(f"f{i}"), F.lit(0)), F.col(f"n{i}"), made("actual", i, c), message=plain(i, c)) for i,
        c in enumerate(clauses)
    ] + _line_rows(lines)
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("status <> 'NONE'")
    if not samples or not clauses:
        return out
    kinds = dict(df.select(*[c.sample.alias(f"s{i}") for i, c in enumerate(clauses)]).dtypes)
    listed = [c.sample if kinds[f"s{i}"].startswith("array") else F.array(c.sample) for i, c in enumerate(clauses)]
    hits = F.array(
        *[
            F.when(
                F.coalesce(c.bad, F.lit(False)),
                F.struct(F.lit(c.check_id).alias("check_id"), s.cast("array<string>").alias("s"))
            ) for c,
            s in zip(clauses, listed, strict=True)
        ]
    )
    found = with_order(df).select(ORD, F.explode(F.array_compact(hits)).alias("h")).select(ORD, "h.check_id", "h.s")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("check_id").orderBy(ORD))).where(F.col("k") <= SAMPLES)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])
    first = first.groupBy("check_id").agg(F.slice(F.array_compact(F.flatten(lists)), 1, SAMPLES).alias("found"))
    return out.join(first, "check_id", "left").withColumn(
        "sample_failing", F.coalesce("found", "sample_failing")
    ).select(RESULT.fieldNames())


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n, first) of keys that several rows have; rows with a null in the key are left out.

    Counts are pre-aggregated, so a hot key is one row per task.
    """
    there = functools.reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return with_order(df).where(there).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias("first")).where("n > 1")


def _exact(df: DataFrame, keys: list[str]) -> Column:
    """A key as one text that only equal keys have; null where a part is null."""
    kinds, parts = dict(df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).dtypes), []
    for i, k in enumerate(keys):
        c, kind = F.col(k), kinds[f"k{i}"]
        if kind in ("float", "double"):
            text = (c + 0.0).cast("string")  # -0.0 is 0.0
        elif kind == "binary":
            text = F.hex(c)
        elif kind.startswith(("struct", "array", "map")):
            text = F.when(c.isNotNull(), F.to_json(F.struct(c)))
        else:
            text = c.cast("string")
        parts += [F.char_length(text).cast("string"), F.lit(":"), text]
    return F.concat(*parts)


def duplicate_keys(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """(clause, key, n, first, shown) of the keys that several rows have, for any number of keys in two scans.

    The first scan counts (clause, 64-bit hash), combined before the one shuffle; hashes met once are of keys
    met once. Only rows whose hash came twice go into the second count, on whole keys. Rows with a null in a key are left out.
    """
    exact = [_exact(df, k) for k in keys]
    hashes = F.array(*[
        F.when(e.isNotNull(), F.struct(F.lit(i).alias("clause"), F.xxhash64(e).alias("hash"))) for i, e in enumerate(exact)
    ])
    twice = df.select(F.explode(F.array_compact(hashes)).alias("h")).groupBy("h.clause", "h.hash").agg(
        F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("clause", "hash")
    whole = F.array(*[
        F.when(
            e.isNotNull(),
            F.struct(
                F.lit(i).alias("clause"), F.xxhash64(e).alias("hash"), e.alias("key"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in k]).alias("shown")
            )
        ) for i, (k, e) in enumerate(zip(keys, exact, strict=True))
    ])
    again = with_order(df).select(ORD, F.explode(F.array_compact(whole)).alias("h")).select(ORD, "h.*")
    # the side of hashes is as large as the repeated keys: Spark broadcasts it or shuffles both, as its size asks for
    return again.join(twice, ["clause", "hash"], "left_semi").groupBy("clause", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(ORD).alias("first"), F.min("shown").alias("shown")
    ).where("n > 1")


def unique_results(df: DataFrame, clauses: list[Clause]) -> DataFrame:
    """Rows in groups with equal keys, and each clause's first groups: all clauses in two scans."""
    found = duplicate_keys(df, [c.params["keys"] for c in clauses])
    # the ranking is limited within each task before it is shuffled
    totals = found.groupBy("clause").agg(F.sum("n").alias("f"))
    top = found.withColumn("k", F.row_number().over(Window.partitionBy("clause").orderBy("first", "shown"))).where(F.col("k") <= SAMPLES)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("k", "shown"))), lambda x: x["shown"])
    totals = totals.join(top.groupBy("clause").agg(shown.alias("samples")), "clause")
    every = df.sparkSession.range(len(clauses)).select(F.col("id").cast("int").alias("clause"))
    rows = every.join(totals, "clause", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    out = None
    for i, c in enumerate(clauses):
        actual = F.concat(F.lit(f"{c.said[0]}=['"), F.array_join("samples", "', '"), F.lit("']"))
        row = _result(c, F.col("f"), F.lit(1), actual, F.coalesce("samples", _none()))
        row = row.withField("message", F.lit(c.message)) if ".quality." in c.check_id else row
        out = F.when(F.col("clause") == i, row) if out is None else out.when(F.col("clause") == i, row)
    return rows.select(out.alias("r")).select("r.*")


def unique_result(df: DataFrame, clause: Clause) -> DataFrame:
    return unique_results(df, [clause])


def sequence_result(df: DataFrame, clause: Clause) -> DataFrame:
    """Within a group each value is the one before plus 1; uncastable values are left out."""
    p = clause.params
    by = [f"b{i}" for i in range(len(p["by"]))]
    rows = with_order(df).select(*[F.col(c).alias(b) for b, c in zip(by, p["by"], strict=True)], F.col(p["column"]).try_cast("bigint").alias("v"), ORD)
    steps = with_previous(rows.where("v is not null"), by, ["v", ORD], "v")
    broken = F.count_if(F.col("prev").isNotNull() & (F.col("v") != F.col("prev") + 1))
    return steps.agg(broken.alias("f"), F.count(F.lit(1)).alias("n")).select(
        _result(clause, F.col("f"), F.col("n")).alias("r")
    ).select("r.*")


def reference_result(df: DataFrame, clause: Clause) -> DataFrame:
    """Rows whose key isn't in another table; a null key matches a null key."""
    p = clause.params
    keys = p["table"].select(F.col(p["key"]).alias("__k")).distinct()
    orphans = df.join(keys, F.col(p["column"]).eqNullSafe(F.col("__k")), "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("f")).select(_result(clause, F.col("f"), F.lit(1)).alias("r")).select("r.*")


def _line_aggs(clauses: list[Clause]) -> list[Column]:
    return [c.params[k].alias(f"q_{k}{i}") for i, c in enumerate(clauses) for k in ("agg", "shown", "each")]


def _line_rows(clauses: list[Clause]) -> list[Column]:
    """Quality lines on aggregates; no value at all is an error."""
    rows = []
    for i, c in enumerate(clauses):
        a, limit = F.col(f"q_agg{i}"), F.lit(c.params["limit"])
        ok = {">=": a >= limit, "<=": a <= limit, ">": a > limit, "<": a < limit, "=": a == limit}[c.params["op"]]
        shown = F.concat(F.lit(f"{c.said[0]}="), F.col(f"q_shown{i}"))
        failing = F.when(ok, F.lit(0)).otherwise(F.greatest(F.col(f"q_each{i}").cast("long"), F.lit(1)))
        r = _result(c, failing, F.lit(1), shown).withField("actual_value", shown).withField("message", F.lit(c.message))
        none = r.withField("status", F.lit("ERROR")).withField("severity", F.lit("WARNING")).withField(
            "records_failing", F.lit(0).cast("long")
        )
        none = none.withField("actual_value", F.lit("no samples")).withField("message", F.lit(f"Cannot compute {c.message}: no values."))
        rows.append(F.when(a.isNull(), none).otherwise(r))
    return rows


def literal_results(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, RESULT)


def error_results(df: DataFrame, clauses: list[Clause]) -> DataFrame:
    """Checks that couldn't run: a warning each, which blocks nothing."""
    return literal_results(
        df,
        [
            (
                c.check_id, c.column, c.check_type, "ERROR", c.params.get("actual", "error"), c.expected, "WARNING", 0,
                [], c.message
            ) for c in clauses
        ]
    )


def run_clauses(df: DataFrame, clauses: list[Clause], samples: bool = True) -> DataFrame:
    parts = []
    by = lambda kind: [c for c in clauses if c.kind == kind]
    rows, lines = by("row"), by("aggregate")
    if rows or lines:
        parts.append(row_results(df, rows, samples, lines))
    if unique := by("unique"):
        parts.append(unique_results(df, unique))
    parts += [sequence_result(df, c) for c in by("sequence")] + [reference_result(df, c) for c in by("reference")]
    if errors := by("error"):
        parts.append(error_results(df, errors))
    if not parts:
        return df.sparkSession.createDataFrame([], RESULT)
    return functools.reduce(DataFrame.unionByName, parts)


def validate(df: DataFrame, contract: dict, samples: bool = True) -> DataFrame:
    """Check results of a contract.

    An empty input is one warning (found by a look at the first row), a
    placeholder contract one error, and a contract without clauses one pass.
    """
    prefix = prefix_of(contract["id"])
    if contract.get("placeholder"):
        return error_results(df, [Clause("contract.placeholder", "*", "config", "a real contract", kind="error")])
    if df.isEmpty():
        return literal_results(
            df,
            [(f"{prefix}.data.empty", "*", "volume", "WARN", "row_count=0", ">=1 record", "WARNING", 0, [], "No records in dataset.")]
        )
    df = with_rules(df, contract)
    clauses = compile_contract(contract, df)
    if not clauses:
        return literal_results(
            df,
            [
                (
                    f"{prefix}.generic.summary", "*", "structural", "PASS", "ok", "generic schema checks", "LOW", 0, [],
                    "No schema constraints beyond data presence."
                )
            ]
        )
    return run_clauses(df, clauses, samples)
