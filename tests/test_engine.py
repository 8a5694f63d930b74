"""Operators on small frames, with nulls, empty inputs and errors."""

import ast
import collections
import datetime
import hashlib
import json
import math
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pactlake import queries
from pactlake.functions.text import recency_score, relative_to, slug, uuid5
from pactlake.operators import ai, attribution, drift, evolution, lineage, migrate, profile, registry, report
from pactlake.plans.validate import validate
from pactlake.sources import control, records, sinks, versions
from pactlake.streaming import enforce

U = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("a", 1, 0.5, "2024-01-01T00:00:00Z", "x"), ("a", -2, 50.0, "yesterday", "q"), (None, None, None, None, None),
        (U, 3, 0.9, "2024-01-02", "y")
    ]
    return spark.createDataFrame(rows, "doc_id string, n long, confidence double, at string, kind string").coalesce(1)


CONTRACT = {
    "id": "people-v1",
    "schema": {
        "doc_id": {"type": "string", "required": True, "unique": True, "format": "uuid"},
        "n": {"type": "integer", "minimum": 1}, "confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "at": {"format": "date-time"}, "kind": {"enum": ["x", "y"]}, "gone": {"required": True}
    },
    "quality": {
        "checks": ["row_count >= 4", "missing_count(n) = 0", "duplicate_count(doc_id) = 0", "max(confidence) <= 1.0", "median(n) < 3"]
    },
}


def test_contract(people):
    got = {r.check_id: r for r in validate(people, CONTRACT).collect()}
    n = {k: (r.status, r.records_failing) for k, r in got.items()}
    assert n["people.doc_id.required"] == ("FAIL", 1) and n["people.doc_id.unique"] == ("FAIL", 2) and n["people.doc_id.format.uuid"] == ("FAIL", 2)
    assert n["people.n.minimum"] == ("FAIL", 1) and n["people.confidence.maximum"] == ("FAIL", 1) and n["people.at.format.date-time"] == ("FAIL", 1) and n["people.kind.enum"] == ("FAIL", 1)
    # a field that no row has is missing in every row; a line that isn't understood blocks nothing
    assert n["people.gone.required"] == ("FAIL", 4) and n["people.quality.unparsed"][0] == "ERROR" and got["people.quality.unparsed"].severity == "WARNING"
    assert n["people.n.type_match"] == n["people.confidence.type_match"] == ("PASS", 0)
    assert n["people.quality.row_count"] == ("PASS", 0) and n[
        "people.quality.n.missing_count"
    ] == ("FAIL", 1) and n["people.quality.confidence.max"][0] == "FAIL"
    assert got["people.doc_id.format.uuid"].sample_failing == ["a", "a"] and got["people.n.minimum"].sample_failing == ["a"]


def test_fused_is_the_same_as_one_by_one(people):
    whole = {r.check_id: r.records_failing for r in validate(people, CONTRACT, samples=False).collect()}
    for name, spec in CONTRACT["schema"].items():
        for r in validate(people.repartition(3), {"id": "people-v1", "schema": {name: spec}}, samples=False).collect():
            assert whole[r.check_id] == r.records_failing


def test_scale_change_breaks_range_and_mean(spark):
    ok = spark.range(50).select((F.col("id") / 60).alias("confidence"))
    bad = ok.select((F.col("confidence") * 100).alias("confidence"))
    c = {"id": "c-1", "schema": {"confidence": {"type": "number", "minimum": 0, "maximum": 1}}}
    assert {r.status for r in validate(ok, c).collect()} == {"PASS"} and "FAIL" in {r.status for r in validate(bad, c).collect()}
    base = drift.column_stats(ok, {"confidence": F.col("confidence")})
    assert drift.drift(drift.column_stats(bad, {"confidence": F.col("confidence")}), base).first().status == "FAIL"
    assert drift.drift(base, base.limit(0)).first().status == "BASELINE_SET"


def test_array_items(spark):
    t = "doc_id string, facts array<struct<confidence:double>>"
    c = {"id": "f-1", "schema": {"facts": {"type": "array", "items": {"confidence": {"minimum": 0.0, "maximum": 1.0}}}}}
    r = validate(spark.createDataFrame([("a", [(0.5,), (7.0,), (9.0,)]), ("b", [])], t), c).first()
    assert (
        r.status, r.records_failing, r.actual_value, r.sample_failing
    ) == ("FAIL", 2, "max=9, mean=5.5", ["a", "a"]) and "0–100" in r.message
    assert validate(spark.createDataFrame([("b", [])], t), c).first().status == "WARN"


def test_sequence_and_reference(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "4"), ("b", "x"), (None, "1")], "g string, s string")
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    c = {
        "id": "q-1",
        "rules": [
            {"kind": "sequence", "name": "seq", "column": "s", "by": ["g"]},
            {"kind": "reference", "name": "ref", "column": "g", "table": keys, "key": "k"}
        ]
    }
    assert {r.check_id: r.records_failing for r in validate(df, c).collect()} == {"q.seq": 1, "q.ref": 1}


def test_reports(spark, people):
    r = validate(people, CONTRACT, samples=False)
    assert report.gate(r).first().pipeline_action == "BLOCK" and report.gate(r, "AUDIT").first().pipeline_action == "PASS"
    assert report.health_score(r).first().health_score == 0.0 and report.health_score(r.limit(0)).first().health_score == 0.0
    assert report.top_failures(r).count() == 3 and report.plain_language(r).where("plain is null").count() == 0


def test_functions(spark):
    one = spark.range(1)
    assert one.select(uuid5(U, F.lit("é name"))).first()[0] == str(uuid.uuid5(uuid.UUID(U), "é name"))
    at = lambda s: F.lit(s).cast("timestamp")
    got = one.select(
        recency_score(at("2024-01-10"), at("2024-01-07 12:00:00"), F.lit(1)),
        recency_score(at("2024-01-10"), F.lit(None).cast("timestamp"), F.lit(0)), slug(F.lit("A b-C!")),
        relative_to(F.lit("file::/r/x/y.py"), "/r")
    ).first()
    assert [round(got[0], 6), got[1], got[2], got[3]] == [0.6, 0.35, "a_b_c", "file::x/y.py"]


def test_profiles(spark, people):
    p = {r.column_name: r for r in profile.numeric_profile(people, ["n", "confidence"]).collect()}
    assert p["n"].n == 3 and p["n"].nulls == 1 and math.isclose(p["n"].mean, 2 / 3)
    s = {r.column_name: r for r in profile.structural_profile(people).collect()}
    assert s["doc_id"].cardinality == 2 and s["doc_id"].null_fraction == 0.25
    assert profile.structural_profile(people.limit(0)).first().null_fraction == 1.0
    assert profile.dominant_pattern(people, "doc_id").first().pattern == "free_text"
    assert profile.confidence_flags(people, "confidence").first().flags == ["OUTSIDE_0_1_RANGE", "MEAN_GT_0_99_CLAMP_SUSPECT"]
    assert profile.suggest_clauses(people)["kind"]["enum"] == ["q", "x", "y"]


def test_texts_of_documents(spark, tmp_path):
    """Null, empty, repeated and long texts, and bytes of all kinds, through the registered queries."""
    texts = [
        None, "", "same text", "same text", "é漢\0\n\x80\U0001f600ÿ", "ab" * 24_999 + "é€" + "tail" * 30,
        *(f"text {i}" for i in range(40))
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.byte): r.share for r in queries.QUERIES["byte_histogram_documents"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        n = collections.Counter((t or "").encode()[:50_000])
        want |= {(i, b): k / (math.sqrt(sum(v * v for v in n.values())) + 1e-9) for b, k in n.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    shapes = [(r.shape, r.n) for r in queries.QUERIES["shape_signature_documents"](spark, str(tmp_path)).collect()]
    shape = lambda t: "null" if t is None else f"string(len={len(t)},sha8={hashlib.sha256(t.encode()).hexdigest()[:8]})"
    assert sorted(shapes) == sorted(collections.Counter(map(shape, texts)).items())


def test_whole_texts_of_documents(spark, tmp_path):
    """Bytes beyond the first 50,000 count, in the query and in its SQL, and so does every piece of a text of many."""
    texts = ["a" * 50_000 + "b" * 50_000, "c" * 49_999 + "\u00e9" + "\u20ac" * 20_000, "de" * 32_768 + "f", "short", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.byte): r.share for r in queries.QUERIES["byte_histogram_documents"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        n = collections.Counter((t or "").encode())
        want |= {(i, b): k / (math.sqrt(sum(v * v for v in n.values())) + 1e-9) for b, k in n.items()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = duck.execute(f"SELECT doc_id, byte, share FROM ({queries.ORACLES['byte_histogram_documents']})").fetchall()
    for rows in (got, {(k, b): x for k, b, x in sql}):
        assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-6 for k in want)


def test_names_of_queries_stand_for_one_thing(spark):
    """A name of the module that is bound again changes the queries that already use it."""
    bound = collections.Counter()
    for n in ast.parse(Path(queries.__file__).read_text()).body:
        named = n.targets if isinstance(n, ast.Assign) else [n]
        bound.update(x for x in (getattr(t, "id", getattr(t, "name", None)) for t in named) if x)
    assert [x for x, n in bound.items() if n > 1] == []
    found = queries.QUERIES["drift_all_columns"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.column for r in found) == ["l_discount", "l_extendedprice", "l_linenumber", "l_quantity", "l_tax"] and {r.status for r in found} == {"PASS"}


def test_registry(spark):
    reg = spark.createDataFrame(
        [
            ("c", "s1", "t", ["f"], [("a.b", "r1"), ("a", "r2")], "AUDIT", None, "2024-01-01", "m"),
            ("c", "s2", None, [], [("z", "r")], "ODD", None, "never", "m")
        ],
        control.REGISTRY
    )
    f = spark.createDataFrame(
        [("c", "k1", "a.b[*].c"), ("c", "k2", "zz"), ("c", "k3", "*"), ("c", "k4", None)],
        "contract_id string, check_id string, column_name string"
    )
    hits = registry.blast_radius(f, reg)
    assert {(r.check_id, r.subscriber_id, r.reason) for r in hits.collect()} == {("k1", "s1", "r1"), ("k3", "s1", "r1"), ("k3", "s2", "r")}
    assert {r.check_id for r in registry.gaps(f, hits).collect()} == {"k2", "k4"}
    assert {r.subscriber_id for r in registry.stale(reg, F.current_timestamp()).collect()} == {"s1"}
    assert {r.problem for r in registry.lint(reg).where("subscriber_id = 's2'").collect()} == {
        "missing subscriber_team", "empty fields_consumed", "unknown validation_mode", "registered_at is no ISO time"
    }


def test_evolution(spark):
    rows = {
        r.path: r.taxonomy for r in evolution.diff(
            evolution.flatten(spark, {"m": {"type": "integer"}, "o": {"type": "object", "properties": {"p": {"type": "string"}}}}),
            evolution.flatten(spark, {"m": {"type": "integer", "minimum": 3}, "o": {"type": "object", "properties": {}}})
        ).collect()
    }
    assert rows == {"m": "range_minimum_change", "o": "no_material_change", "o.p": "remove_field"}


def test_lineage_and_attribution(spark, people):
    e = spark.createDataFrame(
        [("a", "b", "WRITES"), ("b", "c", "CONSUMES"), ("c", "a", "PRODUCES"), ("c", "d", "ODD"), ("table::t", "p", "CONSUMES")],
        "source string, target string, relationship string"
    )
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in lineage.reach(seeds, lineage.forward_edges(e), 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert lineage.dangling_edges(e, n).count() == 3 and lineage.table_consumers(e).count() == 1
    reg = spark.createDataFrame([("people-v1", "s", "t", ["n"], [("n", "why")], "WARN", None, "2024-01-01", "m")], control.REGISTRY)
    t = datetime.datetime(2024, 1, 3)
    commits = spark.createDataFrame(
        [("a", "x.py", t, t), ("c", "y.py", t, t)], "node string, path string, committed timestamp, detected timestamp"
    )
    v = attribution.violations(
        validate(people, CONTRACT, False), "people-v1", reg, e,
        spark.createDataFrame([("people.n.minimum", "a")], "check_id string, node string"), commits
    )
    r = v.where("check_id = 'people.n.minimum'").first()
    assert r.subscribers == ["s"] and [b.path for b in r.blame_chain] == ["x.py", "y.py"] and r.contamination_depth == 2


def test_migrations(spark):
    raw = spark.createDataFrame(
        [
            ("agent-1", "E", {"created_at": "2024-01-01T00:00:00Z", "fee_usd": "3.5"}, "2024-01-02T00:00:00Z"),
            ("agent-1", "E", {"fee_usd": "x"}, "2024-01-03T00:00:00Z"), ("agent-1", "E", {}, "2024-01-04T00:00:00Z")
        ],
        "stream_id string, event_type string, payload map<string,string>, recorded_at string"
    ).coalesce(1)
    good, bad = migrate.events(raw, "ns")
    rows = good.withColumn("payload", F.to_json("payload")).orderBy("sequence_number").collect()
    assert [r.sequence_number for r in rows] == [1, 3] and rows[0].occurred_at == "2024-01-01T00:00:00Z" and json.loads(rows[0].payload) == {
        "created_at": "2024-01-01T00:00:00Z", "fee_usd": 3.5
    } and rows[0].aggregate_type == "AgentSession"
    assert bad.first().reason == "usd_coerce_failed:fee_usd='x'" and bad.columns == [*raw.columns, "line_no", "reason"]
    x = spark.createDataFrame(
        [("doc123", "n", 0.5, 3, "f", "t"), ("d", "n", 0.5, 3, "f", "t")],
        "doc_id string, document_name string, confidence_score double, processing_time_ms long, final_strategy string, timestamp string"
    )
    good, bad = migrate.extractions(x, "ns")
    assert good.count() == bad.count() == 1 and good.first().extracted_facts[0].confidence == 0.5
    up = migrate.Upcasters()
    up.register("E", "1", lambda d: d.withColumn("schema_version", F.lit("2")))
    assert sorted(
        r.schema_version for r in up.apply(
            spark.createDataFrame([("E", "1"), ("F", "1")], "event_type string, schema_version string")
        ).collect()
    ) == ["1", "2"]


def test_sources_and_sinks(spark, tmp_path, people):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n[{"a": 2}, 3]\nnot json\n"text"\n\n{"a": 4}\n')
    good, issues = records.lenient(spark, str(p))
    assert good.count() == 3 and sorted(r.kind for r in issues.collect()) == [
        "malformed_line", "skip_non_object_in_line_array", "unexpected_line_type"
    ]
    assert json.loads(records.latest(spark, str(p)).select(F.to_json("v")).first()[0]) == {"a": 4}
    assert records.fingerprints(spark, str(p)).first().length == p.stat().st_size
    (tmp_path / "r.yaml").write_text(
        "subscriptions:\n- contract_id: c\n  subscriber_id: s\n  breaking_fields:\n  - {field: a, reason: b}\n"
    )
    assert control.registry(spark, str(tmp_path / "r.yaml")).first().breaking_fields[0].field == "a"
    assert control.since("7 days ago", datetime.datetime(2024, 1, 8)) == datetime.datetime(2024, 1, 1)
    assert control.settings(
        '{"warn_rate": 0.1}', {"PACTLAKE_RISING": "2"}, falling=0.4
    ) == control.Settings(warn_rate=0.1, rising=2.0, falling=0.4)
    sinks.report(validate(people, CONTRACT, False), str(tmp_path / "report"), contract="people")
    assert spark.read.json(str(tmp_path / "report")).first().contract == "people"
    for _ in range(2):
        sinks.quarantine(people, str(tmp_path / "q"), "r1")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 4
    sinks.state(people, str(tmp_path / "s"))
    sinks.state(versions.newest(spark, str(tmp_path / "s")), str(tmp_path / "s"))
    assert versions.versions(spark, str(tmp_path / "s")) == [0, 1] and versions.newest(spark, str(tmp_path / "s")).count() == 4
    assert sinks.dbt_tests(CONTRACT)["models"][0]["columns"][0]["tests"] == ["not_null", "unique"]


def test_ai(spark):
    df = spark.createDataFrame(
        [("d1234567", None, [(" t ",)]), ("short", "n", []), (None, None, None)],
        "doc_id string, document_name string, extracted_facts array<struct<text:string>>"
    )
    assert sorted(r.text for r in ai.embedding_texts(df).collect()) == ["n", "t"]
    good, bad = ai.validate_prompts(ai.prompt_envelopes(df))
    assert good.count() == 1 and sorted(r.error for r in bad.collect()) == ["doc_id is missing", "doc_id is too short"]
    v = spark.createDataFrame([([1.0, float(i % 2)],) for i in range(12)], "v array<double>")
    assert ai.embedding_drift(v, "v", None).first().status == "BASELINE_SET" and ai.embedding_drift(v, "v", [1.0, 0.5]).first().status == "PASS"
    assert ai.embedding_drift(v, "v", [-1.0, 0.0]).first().status == "FAIL" and ai.embedding_drift(v.limit(3), "v", [1.0, 0.0]).first().status == "INSUFFICIENT_DATA"
    assert drift.violation_rate(
        spark.createDataFrame([("APPROVE",), (None,), ("NO",)], "r string"), "r", ["APPROVE"], 0.0
    ).first().trend == "rising"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "c", datetime.datetime(2024, 1, 1, 0, i), -i if i == 4 else i) for i in range(1, 6)],
        "id long, check_id string, ts timestamp, v long"
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = enforce.failure_windows(stream, limit=5).writeStream.outputMode("complete").format("memory").queryName("tripped").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tripped").agg(F.max("failures")).first()[0] == 5
    q = enforce.quarantine_split(
        stream, F.col("v") < 0, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 4 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
