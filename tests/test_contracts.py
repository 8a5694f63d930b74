"""Whole contracts: known reports of known data, empty data, the quality language, isolation, attribution, state, migration."""

import datetime
import json
import uuid

import pytest
from pyspark.sql import functions as F

from pactlake.operators import ai, attribution, drift, history, lineage, migrate, profile, report
from pactlake.plans import assemble, drivers
from pactlake.plans.validate import unique_result, validate
from pactlake.plans.clauses import unique_clause
from pactlake.sources import sinks

RAW = "doc_id string, document_name string, confidence_score double, processing_time_ms long, notes string, timestamp string"


@pytest.fixture(scope="module")
def raw(spark):
    """58 raw extraction rows: two of a placeholder id without a time taken, one id 24 times, 32 others once."""
    ids = [f"{i:016x}" for i in range(3)] + ["doc123", "doc123"] + ["65d90f307eb456a9"] * 24 + [f"{i:016x}" for i in range(3, 32)]
    rows = [
        (
            d, f"{d}.pdf", 0.05 + 0.95 * (k % 20) / 19, 0 if d == "doc123" else 7000 + k, None if k else "a note",
            "2026-03-07T15:35:36Z"
        ) for k,
        d in enumerate(ids)
    ]
    return spark.createDataFrame(rows, RAW).coalesce(1)


def by_id(df):
    return {r.check_id: r for r in df.collect()}


def test_raw_rows_against_the_canonical_contract(raw):
    """The report that such rows are known to give: seventeen checks less drift, nine passed, six failed, two could not run."""
    got = by_id(drivers.extraction_results(raw, "week3-document-refinery-extractions"))
    first = [f"{i:016x}" for i in range(3)] + ["doc123", "doc123"]
    said = {k: (r.status, r.records_failing, r.actual_value, r.severity) for k, r in got.items()}
    assert said == {
        "week3.doc_id.required": ("PASS", 0, "missing_count=0", "LOW"),
        "week3.source_path.required": ("FAIL", 58, "missing_count=58", "CRITICAL"),
        "week3.processing_time_ms.required": ("PASS", 0, "missing_count=0", "LOW"),
        "week3.extracted_at.required": ("FAIL", 58, "missing_count=58", "CRITICAL"),
        "week3.processing_time_ms.type_match": ("PASS", 0, "int64", "LOW"),
        "week3.doc_id.format.uuid": ("FAIL", 58, "invalid_uuid_count=58", "CRITICAL"),
        "week3.extracted_at.format.date-time": ("PASS", 0, "all parseable", "LOW"),
        "week3.doc_id.unique": ("FAIL", 26, "duplicate_values=['doc123', '65d90f307eb456a9']", "CRITICAL"),
        "week3.source_hash.pattern": ("PASS", 0, "all match or null", "LOW"),
        "week3.processing_time_ms.minimum": ("FAIL", 2, "below_minimum_count=2", "CRITICAL"),
        "week3.extracted_facts.confidence.range": ("WARN", 0, "no values", "WARNING"),
        "week3.quality.doc_id.missing_count": ("PASS", 0, "missing_count=0", "LOW"),
        "week3.quality.doc_id.duplicate_count": ("FAIL", 26, "duplicate_values=['doc123', '65d90f307eb456a9']", "CRITICAL"),
        "week3.quality.primary_fact_confidence.min": ("ERROR", 0, "no samples", "WARNING"),
        "week3.quality.primary_fact_confidence.max": ("ERROR", 0, "no samples", "WARNING"),
        "week3.quality.row_count": ("PASS", 0, "row_count=58", "LOW"),
    }
    assert got["week3.source_path.required"].sample_failing == first and got["week3.doc_id.format.uuid"].sample_failing == first
    assert got["week3.source_path.required"].message == "Required field 'source_path' is null or absent on 58 record(s)."
    assert got["week3.doc_id.unique"].sample_failing == ["doc123", "65d90f307eb456a9"] and got[
        "week3.processing_time_ms.minimum"
    ].sample_failing == ["doc123", "doc123"]
    assert got["week3.doc_id.format.uuid"].expected == "^[0-9a-f-]{36}$" and got["week3.quality.row_count"].expected == ">= 1"


def test_migrated_rows_meet_it(raw):
    good, bad = migrate.extractions(raw, "space")
    assert good.count() == 56 and {r.reason for r in bad.collect()} == {"placeholder_doc_id"}
    r = good.where("extracted_facts[0].source_excerpt like '%note'").first()
    ns = {k: uuid.uuid5(uuid.NAMESPACE_URL, f"space/{k}") for k in ("doc_id", "fact_id")}
    assert r.doc_id == str(uuid.uuid5(ns["doc_id"], f"{0:016x}"))
    assert r.extracted_facts[0].fact_id == str(uuid.uuid5(ns["fact_id"], f"{0:016x}|2026-03-07T15:35:36Z|0.05"))
    assert r.extracted_facts[0].source_excerpt == "[legacy notes] a note" and r.token_count.input is None and r.entities == [] and r.source_hash is None
    got = by_id(drivers.extraction_results(good, "week3-x"))
    assert {k: r.records_failing for k, r in got.items() if r.status != "PASS"} == {
        "week3.doc_id.unique": 24, "week3.quality.doc_id.duplicate_count": 24
    }
    assert got["week3.extracted_facts.confidence.range"].actual_value == "all in [0.0,1.0]" and got[
        "week3.quality.primary_fact_confidence.min"
    ].actual_value == "min=0.05"
    assert len(got) == 16 and report.gate(drivers.extraction_results(good, "week3-x"), "WARN").first().pipeline_action == "BLOCK"
    assert migrate.refreshed_report(
        {"file": "f", "record_count": 1, "deviations": []}, raw
    ) == {"file": "f", "record_count": 58, "deviations": []}


def test_lineage_and_traces(spark):
    t = "taken int, snapshot_id string, git_commit string, nodes array<struct<node_id:string>>, edges array<struct<source:string,target:string,relationship:string>>"
    good = (2, "s", "A" * 40, [("a",), ("b",)], [("a", "b", "CONSUMES")])
    bad = (1, None, "x" * 30, [("a",), (None,)], [("a", "b", "ODD"), (None, "a", "READS"), ("z", "y", "READS")])
    got = by_id(drivers.lineage_results(spark.createDataFrame([good, bad], t), "taken", "week4"))
    assert {(k, r.status, r.actual_value, r.expected) for k, r in got.items()} == {
        ("week4.snapshot_id.required", "PASS", "present", "uuid"),
        ("week4.git_commit.format", "PASS", "40 hex", "40 hex"),
        ("week4.edges.endpoints", "PASS", "all resolve", "nodes")
    }
    got = by_id(drivers.lineage_results(spark.createDataFrame([bad], t), "taken", "week4"))
    edges = got["week4.edges.endpoints"]
    assert (
        edges.records_failing, edges.sample_failing, edges.actual_value
    ) == (3, ["a->b", "z->y"], "invalid_edges=3") and got["week4.git_commit.format"].actual_value == "x" * 20
    assert [
        r.check_id for r in drivers.lineage_results(spark.createDataFrame([], t), "taken", "week4").collect()
    ] == ["week4.snapshot.exists"]

    t = "id string, run_type string, start_time string, end_time string, total_tokens long, prompt_tokens long, completion_tokens long"
    one = spark.createDataFrame([("r", "chain", None, None, None, None, None)], t)
    got = by_id(drivers.trace_results(one, "langsmith-trace-record-migrated"))
    assert {(k, r.status, r.actual_value, r.expected) for k, r in got.items()} == {
        ("langsmith.run_type.enum", "PASS", "valid", "['chain', 'embedding', 'llm', 'retriever', 'tool']")
    }
    odd = spark.createDataFrame(
        [("p", None, "2", "1", 5, 2, 3), ("q", "llm", "2", "2", 5, 2, 2), ("r", "x", "1", "2", 1, 1, 1)], t
    ).coalesce(1)
    got = by_id(drivers.trace_results(odd, "langsmith-x"))
    assert {k: (r.status, r.records_failing) for k, r in got.items()} == {
        "langsmith.run_type.enum": ("FAIL", 2), "langsmith.timing.end_after_start": ("FAIL", 1),
        "langsmith.tokens.sum": ("FAIL", 1)
    }
    assert got["langsmith.run_type.enum"].sample_failing == ["p", "r"]


def test_events_are_migrated_to_their_contract(spark):
    deep = {
        "a": [{"b": {"fee_usd": " 2.5 ", "approved_at": "2024-01-01T00:00:00Z", "submitted_at": "2024-01-01T02:00:00+01:00"}}],
        "created_at": "2030-01-01T00:00:00Z", "session_id": "s9"
    }
    rows = [
        (
            f"docpkg-{i % 2}", "Opened", json.dumps(deep if i else {"application_id": "app", "x_usd": "no"}),
            f"2024-01-0{2 + i}T00:00:00+00:00"
        ) for i in range(4)
    ]
    good, bad = migrate.events(
        spark.createDataFrame(rows, "stream_id string, event_type string, payload string, recorded_at string"), "space",
        service="shop"
    )
    got = {r.recorded_at: r for r in good.withColumn("payload", F.to_json("payload")).collect()}
    r = got["2024-01-03T00:00:00Z"]
    assert json.loads(r.payload)["a"][0]["b"]["fee_usd"] == 2.5 and r.occurred_at == "2024-01-01T01:00:00Z" and r.aggregate_type == "DocumentPackage" and r.schema_version == "1.0"
    assert r.metadata.source_service == "shop" and r.metadata.causation_id is None and r.metadata.correlation_id == str(
        uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, "space/correlation_id"), "session:s9")
    )
    assert [x.reason for x in bad.collect()] == ["usd_coerce_failed:x_usd='no'"]
    assert {r.status for r in drivers.event_results(good, "week5-x").collect()} == {"PASS"}
    assert sorted(r.event_id for r in good.collect()) == sorted(
        r.event_id for r in migrate.events(
            spark.createDataFrame(rows[::-1], "stream_id string, event_type string, payload string, recorded_at string"),
            "space"
        )[0].collect()
    )


def test_empty_data_is_one_warning(spark):
    c = {"id": "c-1", "schema": {"doc_id": {"required": True, "unique": True}}, "quality": {"checks": ["row_count >= 1"]}}
    got = validate(spark.createDataFrame([], "doc_id string"), c).collect()
    assert [(r.check_id, r.status, r.severity, r.records_failing) for r in got] == [("c.data.empty", "WARN", "WARNING", 0)]
    assert [
        (r.check_id, r.status) for r in validate(spark.range(1), {"id": "c-1", "schema": {"id": {}}}).collect()
    ] == [("c.generic.summary", "PASS")]
    assert [
        (r.check_id, r.status, r.severity) for r in validate(spark.range(1), assemble.placeholder("c-1", "none yet")).collect()
    ] == [("contract.placeholder", "ERROR", "WARNING")]


@pytest.mark.parametrize(
    ("line", "status"),
    [
        ("min(x) >= 1e-06", "PASS"), ("min(x) >= 1E-04", "FAIL"), ("max(x) <= 2e+05", "PASS"), ("max(x) <= 2e+04", "FAIL"), ("min(x) >= -.5", "PASS"), ("avg(x) > 0", "PASS"), ("sum(x) = 0", "FAIL"), ("row_count >= 3", "PASS"),
        ("row_count >= 3.5", "FAIL"), ("missing_count(y) = 0", "FAIL"), ("missing_count(y) <= 1", "PASS"), ("missing_count(y) = 0.9", "FAIL"), ("duplicate_count(x) = 0", "PASS"), (
            "duplicate_count(x) = 1", "ERROR"
        ),
        (
            "row_count >= 1 and nonsense", "ERROR"
        ), ("median(x) < 3", "ERROR"), ("min(none) >= 1", "ERROR"), ("min(x) >= 1e", "ERROR"), ("min(s) >= 1", "ERROR"), ("", "ERROR"),
    ],
)
def test_quality_lines(spark, line, status):
    df = spark.createDataFrame([(1e-5, 1, "a"), (5.0, None, "b"), (1e5, 3, None)], "x double, y int, s string")
    r = validate(df, {"id": "q-1", "quality": {"checks": [line]}}).first()
    assert r.status == status and (r.severity == "WARNING") == (status == "ERROR")


def test_a_contract_of_data_holds_on_it(spark):
    df = spark.createDataFrame([(f"k{i}", (i + 1) * 1e-5, i * 3e7) for i in range(30)], "k string, small double, large double")
    c = assemble.contract(df, "own-1", "own", ranges=["small", "large"])
    assert any("e-05" in x for x in c["quality"]["checks"])
    assert {r.status for r in validate(df, c).collect()} == {"PASS"}


def test_errors_stay_with_their_clause(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n int")
    rules = [
        {"kind": "sequence", "name": "seq", "column": "gone", "by": ["g"]}, {
            "kind": "reference", "name": "ref", "column": "g", "table": spark.range(2), "key": "no_key"
        }, {"kind": "unique", "name": "uni", "keys": ["g", "gone"]},
        {"kind": "odd", "name": "kind"}, {"kind": "expression", "name": "expr", "holds": "n >"}, {
            "kind": "reference", "name": "fine", "column": "n", "table": spark.range(3), "key": "id"
        },
    ]
    schema = {
        "n": {"type": "integer"}, "g": {"type": "number"},
        "gone": {"type": "integer", "enum": [1], "unique": True, "format": "uuid", "minimum": 3}, "bad": {"pattern": 7}
    }
    got = by_id(validate(df, {"id": "e-1", "schema": schema, "rules": rules}))
    errors = {k for k, r in got.items() if r.status == "ERROR"}
    assert errors == {"e.seq", "e.ref", "e.uni", "e.kind", "e.expr", "e.gone.type_match", "e.gone.enum"}
    assert all(got[k].severity == "WARNING" for k in errors) and got["e.fine"].status == "PASS"
    assert got["e.n.type_match"].status == "PASS" and (got["e.g.type_match"].status, got["e.g.type_match"].records_failing) == ("FAIL", 2)
    assert report.gate(validate(df, {"id": "e-1", "rules": rules})).first().pipeline_action == "PASS"


def test_values_that_are_no_strings_break_patterns(spark):
    df = spark.createDataFrame([(12, "12"), (None, None)], "n int, s string")
    got = by_id(validate(df, {"id": "p-1", "schema": {"n": {"pattern": "[0-9]+"}, "s": {"pattern": "[0-9]+"}}}))
    assert (got["p.n.pattern"].records_failing, got["p.s.pattern"].records_failing) == (1, 0)


def test_one_shuffle_finds_duplicates(spark):
    df = spark.range(100).selectExpr("id % 60 as k", "id")
    out = unique_result(df, unique_clause("u.k.unique", "k", ["k"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.first().records_failing == 80 and out.first().sample_failing == ["0", "1", "2", "3", "4"]
    assert plan.count("hashpartitioning(k") <= 2


def test_attribution_is_of_each_check(spark):
    edges = spark.createDataFrame(
        [("a", "b", "WRITES"), ("b", "pipeline::c", "CONSUMES"), ("x", "y", "PRODUCES"), ("y", "x", "READS")],
        "source string, target string, relationship string"
    )
    fails = validate(
        spark.createDataFrame([(None, None)], "m string, n string"),
        {"id": "c-1", "schema": {"m": {"required": True}, "n": {"required": True}}}, False
    )
    reg = spark.createDataFrame(
        [("c-1", "s", [("m", "why")])],
        "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>"
    )
    t = datetime.datetime(2024, 1, 3)
    commits = spark.createDataFrame(
        [("a", "a.py", t, t), ("x", "x.py", t, t)], "node string, path string, committed timestamp, detected timestamp"
    )
    seeds = spark.createDataFrame([("c.m.required", "a"), ("c.n.required", "x")], "check_id string, node string")
    got = by_id(attribution.blame_summary(attribution.violations(fails, "c-1", reg, edges, seeds, commits, 3)))
    m, n = got["c.m.required"], got["c.n.required"]
    assert (
        m.transitive_nodes, m.direct_nodes, m.pipelines, m.contamination_depth
    ) == (["b", "pipeline::c"], ["b"], ["pipeline::c"], 2) and [b.path for b in m.blame_chain] == ["a.py"]
    assert (
        n.transitive_nodes, n.contamination_depth, n.registry_warning
    ) == (["y"], 1, "NO_SUBSCRIBERS_REGISTERED") and [b.path for b in n.blame_chain] == ["x.py"]
    assert m.blame_summary == "Most likely a.py (score 1.00)"
    some = attribution.seeds_with_fallback(fails, seeds.where("node = 'a'"), None, edges)
    assert sorted((r.check_id, r.node) for r in some.collect()) == [
        ("c.m.required", "a"), *[("c.n.required", x) for x in ("b", "pipeline::c", "x", "y")]
    ]


def test_reach_has_a_small_plan(spark):
    edges = spark.range(200).selectExpr("cast(id as string) source", "cast(id + 1 as string) target")
    seeds = spark.createDataFrame([("0",)], "node string")
    size = {d: len(lineage.reach(seeds, edges, d)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for d in (2, 4, 8)}
    assert size[8] - size[4] <= 4 * (size[4] - size[2]) // 2 + 2 and size[8] < 40
    assert lineage.reach(seeds, edges, 8).agg(F.max("hops")).first()[0] == 8


def test_exact_profiles_are_ranked(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=500).round(1)
    df = spark.createDataFrame(
        [(float(x), i % 7, "x" if i % 3 else None) for i, x in enumerate(v)], "a double, b int, c string"
    ).repartition(5)
    r = {x.column_name: x for x in profile.numeric_profile(df, ["a", "b", "c"], exact=True).collect()}
    assert drift.as_results(
        drift.drift(
            drift.column_stats(df, {"b": F.col("b")}),
            spark.createDataFrame([("b", 2.9, 1.0)], "column string, mean double, std double")
        ),
        "p"
    ).first().actual_value == "current_mean=2.988, baseline_mean=2.9, z=0.088_std"
    for q in (25, 50, 75, 95, 99):
        assert abs(r["a"][f"p{q}"] - np.percentile(v, q)) < 1e-9 and abs(r["b"][f"p{q}"] - np.percentile(np.arange(500) % 7, q)) < 1e-9
    assert r["c"].p50 is None and r["c"].n == 0
    s = {x.column_name: x.cardinality for x in profile.structural_profile(df, exact=True).collect()}
    assert s == {"a": len(set(v.tolist())), "b": 7, "c": 1}


def test_rates_keep_state(spark):
    ok = spark.createDataFrame([("click",)] * 90 + [("view",)] * 10, "event_type string")
    odd = ok.unionByName(spark.createDataFrame([("boom",)] * 25, "event_type string"))
    first, state = drift.output_rate(ok, "event_type", None, None, "t1")
    assert first["status"] == "BASELINE_SET" and state["allowed"] == ["click", "view"]
    second, state = drift.output_rate(odd, "event_type", None, state, "t2")
    assert second["trend"] == "rising" and second["status"] == "WARN" and second["violations"] == 25 and state["baseline_rate"] == 0.0 and len(state["rate_history"]) == 2
    _, state = drift.output_rate(odd.withColumnRenamed("event_type", "recommendation"), "recommendation", ["click"], state, "t3")
    assert state["metric_field"] == "recommendation" and len(state["rate_history"]) == 1
    for i in range(30):
        _, state = drift.output_rate(ok, "event_type", ["click"], state, str(i))
    assert len(state["rate_history"]) == 24


def test_embedding_check_end_to_end(spark, tmp_path):
    df = spark.createDataFrame(
        [(f"d{i}", f"name of {i}", [], ["A", "B"]) for i in range(20)],
        "doc_id string, document_name string, extracted_facts array<struct<text:string>>, strategy_sequence array<string>"
    )
    first = ai.embedding_check(df, None)
    assert (first.first().status, first.first().backend, len(first.first().centroid)) == ("BASELINE_SET", "local", 256)
    path = str(tmp_path / "centroids")
    assert sinks.latest_centroid(spark, path) is None
    sinks.append_centroid(first, path, F.lit("2024-01-01").cast("timestamp"))
    again = ai.embedding_check(df, sinks.latest_centroid(spark, path)).first()
    assert again.status == "PASS" and again.drift < 1e-6
    ai.PROVIDERS["flat"] = lambda d, text: d.select(F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    try:
        assert ai.embedding_check(df, [0.0, 1.0]).first().status == "FAIL" and ai.embedding_check(df, None, "local").first().backend == "local"
        with pytest.raises(KeyError):
            ai.vectors(df, "document_name", "none")
    finally:
        del ai.PROVIDERS["flat"]
    notes = ai.annotated(profile.structural_profile(df), lambda rows: {k: f"{k} is a {t}" for k, t in rows})
    assert {r.annotation for r in notes.where("column_name = 'doc_id'").collect()} == {"doc_id is a string"}


def test_prompts_with_unknown_keys(spark):
    rows = spark.createDataFrame(
        [("d1234567", "s", "p", None), ("d1234567", "s", "p", "x")],
        "doc_id string, source_path string, content_preview string, extra string"
    )
    good, bad = ai.validate_prompts(rows)
    assert good.count() == 1 and [r.error for r in bad.collect()] == ["unknown key extra"]


def test_reports_and_documents(spark, tmp_path, raw):
    r = drivers.extraction_results(raw, "week3-x")
    parts = report.sections(
        r, "week3-x", unregistered=2, schema={"requires_migration": True},
        ai={"requires_attention": True, "output_trend": "rising", "output_violation_rate": 0.01}
    )
    assert [p["key"] for p in parts] == [
        "action", "health", "snapshot", "issues", "follow_up"
    ] and parts[0]["content"].startswith("Stop") and "rising" in parts[4]["content"] and "subscription" in parts[4]["content"]
    assert report.sections(
        validate(spark.range(3), {"id": "c-1", "quality": {"checks": ["row_count >= 1"]}}), "c-1"
    )[3]["content"] == "No check failed."
    doc = {"report_id": "r", "contract_id": "c", "total_checks": 1, "results": [], "mode": "old", "injection_note": "x"}
    assert list(
        sinks.with_pipeline(doc, "warn", "BLOCK")
    )[:3] == ["report_id", "pipeline_action", "mode"] and sinks.with_pipeline(doc, "warn", "BLOCK")["mode"] == "WARN"
    assert sinks.strict_report(doc, note=True) == {
        "report_id": "r", "contract_id": "c", "total_checks": 1, "results": [], "injection_note": True
    }
    changes = spark.createDataFrame(
        [("a", "BREAKING", "type_change"), ("b", "COMPATIBLE", "add_nullable_field")],
        "path string, verdict string, taxonomy string"
    )
    hits = spark.createDataFrame(
        [("c", "a", "a", "s1", "why")],
        "contract_id string, check_id string, column_name string, subscriber_id string, reason string"
    )
    evolution, impact = report.evolution_documents(changes, hits, "c", "old.yaml", "new.yaml", "20240101T000000Z", "s1")
    assert evolution["migration_impact_file"] == "migration_impact_c_20240101T000000Z.json" and impact["per_consumer"]["a"]["consumers"] == ["s1"] and len(
        impact["migration_checklist"]
    ) == 3 and impact["rollback_plan"]["anchor_snapshot"] == "old.yaml"
    sinks.json_document(spark, impact, str(tmp_path / "impact"))
    assert json.loads(spark.read.text(str(tmp_path / "impact")).first()[0])["contract_id"] == "c"
    assert report.evolution_documents(
        changes.where("path = 'b'"), hits, "c", "o", "n", "t"
    )[1]["rollback_plan"]["steps"] == []
    sinks.append_mode_transition(spark, str(tmp_path / "modes"), "ENFORCE", "WARN", ["k"], "t")
    assert spark.read.json(str(tmp_path / "modes")).first().runner_mode_effective == "WARN"
    assert report.gate(r, "QUARANTINE").first().pipeline_action == "BLOCK" and report.gate(
        r.where("check_type = 'range'"), "QUARANTINE"
    ).first().pipeline_action == "QUARANTINE"
    base = sinks.load_state(spark, str(tmp_path / "none"), "column string, mean double, std double, n long, established_at timestamp")
    kept = history.next_baselines(drift.column_stats(raw, {"ms": F.col("processing_time_ms")}), base, F.current_timestamp())
    sinks.state(kept, str(tmp_path / "base"))
    assert sinks.load_state(
        spark, str(tmp_path / "base"), "column string, n long, written_at timestamp"
    ).where("written_at is not null").first().n == 58


def test_lineage_metadata_gets_all_keys(spark):
    snap = spark.createDataFrame(
        [([("file::/r/a.py", {"path": "p"})], [("file::/r/a.py", "x", "READS")])],
        "nodes array<struct<node_id:string,metadata:struct<path:string>>>, edges "
        "array<struct<source:string,target:string,relationship:string>>"
    )
    r = migrate.lineage(snap, "/r").first()
    assert r.nodes[0].node_id == "file::a.py" and r.nodes[0].metadata.asDict() == {
        "path": "p", "language": None, "purpose": None, "last_modified": None
    } and r.edges[0].source == "file::a.py"


def test_breaker_counts_over_the_edges_of_spans(spark):
    t0 = datetime.datetime(2024, 1, 1, 0, 30)
    rows = [("k", t0 + datetime.timedelta(minutes=20 * i)) for i in range(9)] + [("j", t0), (None, t0), ("k", None)]
    df = spark.createDataFrame(rows, "check_id string, ts timestamp")
    plain = df.withColumn(
        "want",
        F.expr("count(*) over (partition by check_id order by ts range between interval 1 hour preceding and current row)")
    )
    got = sorted((str(r.check_id), str(r.ts), r.recent) for r in report.circuit_breaker(df, "check_id", "ts").collect())
    assert got == sorted((str(r.check_id), str(r.ts), r.want) for r in plain.collect())
