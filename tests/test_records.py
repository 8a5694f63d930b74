"""Projections, migrations of traces, state between runs, contract assembly, reports and streams on small frames."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from pactlake.operators import drift, history, lineage, migrate, project, registry, report
from pactlake.plans import assemble
from pactlake.plans.validate import validate
from pactlake.sources import control, records


def variants(spark, *docs):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "line long, s string").select("line", F.try_parse_json("s").alias("v"))


def test_projections(spark):
    v = variants(
        spark,
        {
            "doc_id": "a", "extracted_facts": [{"confidence": 0.5}, {"confidence": "x"}, {"confidence": 1}],
            "entities": [1], "token_count": {"input": 3}, "processing_time_ms": 2.5
        },
        {"doc_id": "b", "extracted_facts": "none", "processing_time_ms": "slow"},
        {"extracted_facts": None},
    )
    e = {r.doc_id: r for r in project.extractions(v).collect()}
    assert (e["a"].entities_len, e["a"].extracted_facts_len, e["a"].primary_fact_confidence, e["a"].token_count_input) == (1, 3, 0.5, 3)
    assert (e["b"].extracted_facts_len, e["b"].primary_fact_confidence, e["b"].processing_time_ms) == (0, None, None)
    assert [r[0] for r in v.select(project.mean_number("extracted_facts", "confidence")).collect()] == [0.75, None, None]
    assert {tuple(r) for r in project.shape_caveats(v, ["extracted_facts"], ["processing_time_ms"]).collect()} == {
        ("extracted_facts", "missing", 1), ("extracted_facts", "not an array", 1),
        ("processing_time_ms", "not a number", 1)
    }
    mix = project.type_mix(v, "processing_time_ms").first()
    assert (mix.kinds, mix.status) == (["NUMBER", "STRING"], "WARN")
    assert project.type_mix(v.limit(0), "x").first().status == "PASS"
    w = variants(
        spark, {"event_id": "1", "payload": {"a": 1, "b": None}, "metadata": {"correlation_id": "c"}},
        {"event_id": "2", "payload": 3}
    )
    assert [
        (r.metadata_correlation_id, r.payload_key_count) for r in project.events(w).orderBy("event_id").collect()
    ] == [("c", 2), (None, 0)]
    t = project.traces(variants(spark, {"id": "t", "tags": ["b", "a"], "inputs": {"x": 1}})).first()
    assert (t.tags_repr, t.inputs_key_count, t.outputs_key_count) == ('["b","a"]', 1, 0)
    nodes, edges = project.graph(
        variants(
            spark,
            {"nodes": [{"node_id": "n", "metadata": {"path": "p"}}], "edges": [{"source": "n", "target": "m", "confidence": 0.5}]},
            {}
        )
    )
    assert [r.metadata_path for r in nodes.collect()] == ["p"] and [r.confidence for r in edges.collect()] == [0.5]


def test_traces(spark):
    raw = variants(
        spark,
        {
            "inputs": {"session_id": "s", "b": 1}, "outputs": {},
            "metadata": {"revision_id": "abc-dirty", "LANGSMITH_PROJECT": "p"},
            "langsmith": {"tracing_project": {"name": "p"}}
        },
        {"inputs": 3, "outputs": {}}, {"inputs": {}, "outputs": {}}
    )
    good, bad = migrate.traces(raw, "test", "moved")
    g = {r.name: r for r in good.select("name", "id", "tags", "session_id", F.to_json("inputs").alias("inputs")).collect()}
    assert set(g) == {"p/s", "unknown-project/no-session"} and g["p/s"].tags == ["p", "moved"]
    meta = json.loads(g["p/s"].inputs)["_migration_source_envelope"]["metadata"]
    assert (meta["revision_id"], meta["revision_id_original"]) == ("abc", "abc-dirty")
    assert [r.reason for r in bad.collect()] == ["inputs_not_object"]
    again = {r.name: r.id for r in migrate.traces(raw, "test", "moved")[0].collect()}
    assert again == {n: r.id for n, r in g.items()}


def test_history(spark, tmp_path):
    t = datetime.datetime
    s = spark.createDataFrame(
        [
            ("c", t(2026, 1, 1), 1), ("c", t(2026, 1, 2), 2), ("c", t(2026, 1, 9), 3), ("d", t(2026, 1, 9), 4),
            ("e", None, 5), ("e", t(2026, 1, 9), 6)
        ],
        "c string, ts timestamp, v int"
    )
    pair = lambda cut: {(r.c, r.v, r.nth, r.status) for r in history.latest_pair(s, "c", ["v"], "ts", cut).collect()}
    assert pair(F.lit("2026-01-08").cast("timestamp")) == {
        ("c", 3, 1, "OK"), ("c", 2, 2, "OK"), ("d", 4, 1, "INSUFFICIENT_SNAPSHOTS"), ("e", 6, 1, "OK"),
        ("e", 5, 2, "OK")
    }
    names = spark.createDataFrame([("20260405T032800Z.yaml",), ("other.yaml",)], "n string")
    assert [str(r[0]) for r in names.select(history.stem_time(F.col("n"))).collect()] == ["2026-04-05 03:28:00", "None"]
    for i in range(2):
        history.append_snapshot(spark, str(tmp_path / "snaps"), "c", {"a": {"type": "string"}}, t(2026, 1, 1))
    assert spark.read.parquet(str(tmp_path / "snaps")).count() == 2
    now = drift.column_stats(
        spark.createDataFrame([(float(i), 1.0 if i < 3 else None) for i in range(12)], "x double, y double"),
        {"x": F.col("x"), "y": F.col("y")}
    )
    none = spark.createDataFrame([], "column string, mean double, std double, n long, established_at timestamp")
    first = history.next_baselines(now, none, F.lit("2026-01-01").cast("timestamp"))
    assert [(r.column, r.mean, r.n) for r in first.collect()] == [("x", 5.5, 12)]
    later = now.withColumn("mean", F.col("mean") + 100)
    assert history.next_baselines(later, first, F.current_timestamp()).first().mean == 5.5
    assert history.next_baselines(later, first, F.current_timestamp(), reset=True).first().mean == 105.5


def test_scaled_confidence_is_found_twice(spark):
    """A hundredfold confidence breaks its range and drifts from its baseline."""
    good = spark.createDataFrame([(str(i), 0.5 + i / 100) for i in range(20)], "doc_id string, confidence double")
    scaled = good.withColumn("confidence", F.col("confidence") * 100)
    contract = {"id": "c-1", "schema": {"confidence": {"type": "number", "minimum": 0, "maximum": 1}}}
    assert {r.status for r in validate(good, contract).collect()} == {"PASS"}
    assert {r.check_id: r.records_failing for r in validate(scaled, contract).collect()}["c.confidence.maximum"] == 20
    stats = lambda df: drift.column_stats(df, {"confidence": F.col("confidence")})
    assert drift.drift(stats(scaled), stats(good)).first().status == "FAIL"


def test_assembly(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.7)], "kind string, n int, confidence double")
    c = assemble.contract(df, "c-1", "C", subscribers=["x"], ranges=["confidence"])
    assert c["quality"]["checks"] == [
        "row_count >= 1", "missing_count(kind) = 0", "missing_count(n) = 0", "missing_count(confidence) = 0",
        "min(confidence) >= 0.5", "max(confidence) <= 0.7"
    ]
    assert {r.status for r in validate(df, c).collect()} == {"PASS"}
    assert validate(df, assemble.placeholder("c-2", "later")).first().status == "ERROR"
    x = spark.createDataFrame(
        [
            ("PaidInvoice", "2026-01-02", "2026-01-01"), ("paid", "2026-01-01", "2026-01-02")
        ], "event_type string, occurred_at string, recorded_at string"
    )
    got = {r.check_id: r.records_failing for r in validate(x, {"id": "e", "rules": assemble.EXTENSION_RULES["events"]}).collect()}
    assert got == {"e.event_type.pascal_case": 1, "e.recorded_at.order": 1}
    y = spark.createDataFrame(
        [([(["e1"],), (["e9"],)], [("e1",)]), ([(["e1"],)], [("e1",)])],
        "extracted_facts array<struct<entity_refs:array<string>>>, entities array<struct<entity_id:string>>"
    )
    assert validate(y, {"id": "e", "rules": assemble.EXTENSION_RULES["extractions"]}).first().records_failing == 1
    z = spark.createDataFrame(
        [({"a": (4, 0.5), "b": (2, 0.5)}, 3.0, "PASS"), ({"a": (6, 1.0)}, 2.0, "MAYBE")],
        "scores map<string,struct<score:int,weight:double>>, overall_score double, overall_verdict string"
    )
    assert {r.records_failing for r in validate(z, {"id": "v", "rules": assemble.EXTENSION_RULES["verdicts"]}).collect()} == {1}
    w = spark.createDataFrame([([(0.5,)],), ([],), (None,), ([(2.0,)],)], "code_refs array<struct<confidence:double>>")
    assert sorted(r.records_failing for r in validate(w, {"id": "i", "rules": assemble.EXTENSION_RULES["intents"]}).collect()) == [1, 2]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 5), (None, 50)], "doc_id string, n int")
    res = validate(df, {"id": "c-1", "schema": {"doc_id": {"required": True}, "n": {"type": "integer", "maximum": 10}}})
    doc = report.stakeholder(res)
    r = doc.first()
    assert (r.health_score, r.by_severity, [x.check_id for x in r.issues]) == (0.0, {"CRITICAL": 2}, ["c.doc_id.required", "c.n.maximum"])
    assert "c.n.maximum" in report.markdown(doc, "T")
    assert report.signals(res).first().asDict() == {"range_failed": False, "mean_drifted": False, "surfaced": False}
    changes = spark.createDataFrame(
        [("a", "BREAKING", "type_change"), ("b", "BREAKING", "odd")], "path string, verdict string, taxonomy string"
    )
    assert {(x.path, x.registry) for x in report.guide(changes).collect()} == {("a", "refused"), ("b", "review by hand")}
    reg = spark.createDataFrame(
        [("c", "s", [("a", "why")])],
        "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>"
    )
    hits = registry.blast_radius(
        changes.select(F.lit("c").alias("contract_id"), F.col("path").alias("check_id"), F.col("path").alias("column_name")),
        reg
    )
    assert {(x.path, x.consumers is None) for x in report.migration_impact(changes, hits).collect()} == {("a", False), ("b", True)}
    assert control.report_name(
        "Week 3-docs", datetime.datetime(2026, 1, 2, tzinfo=datetime.timezone.utc)
    ) == "week_3_docs_20260102T000000Z.json"
    (tmp_path / "r.json").write_text('{"summary": {"n": 3}}')
    assert records.summary(spark, str(tmp_path / "r.json"), {"n": "$.summary.n"}) == {"n": "3"}
    assert records.summary(spark, str(tmp_path / "no.json"), {"n": "$.n"}) is None
    assert control.resolve(spark, None, str(tmp_path / "no"), str(tmp_path)) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        control.resolve(spark, str(tmp_path / "no"))


def test_python_literals_are_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("{'a': None}\n{\"a\": 1}\n{broken\n")
    good, bad = records.lenient(spark, str(tmp_path), literals=True)
    assert good.count() == 2 and [r.kind for r in bad.collect()] == ["malformed_line"]
    assert records.lenient(spark, str(tmp_path))[0].count() == 1


def test_graph_helpers(spark):
    n = spark.createDataFrame([("file::src/extract.py",), ("table::t",), ("file::other",)], "node_id string")
    assert [r[0] for r in n.orderBy("node_id").select(lineage.repo_path(F.col("node_id"))).collect()] == ["other", "src/extract.py", None]
    files = spark.createDataFrame([("k", "a.py", 1), ("k", "b.py", 0)], "check_id string, path string, hops int")
    commits = spark.createDataFrame(
        [("a.py", "h1", datetime.datetime(2026, 1, 1))], "path string, commit_hash string, commit_time timestamp"
    )
    s = {
        r.path: (r.commit_hash, r.score) for r in lineage.commit_scores(
            files, commits, F.lit("2026-01-03").cast("timestamp"), "abcdef1"
        ).collect()
    }
    assert s == {"a.py": ("h1", 0.6), "b.py": ("abcdef1", 0.35)}
    reached = spark.createDataFrame([("a", 0), ("c", 1), ("b", 1)], "node string, hops int")
    assert [r.node for r in lineage.nearest(reached, 2).collect()] == ["a", "b"]
