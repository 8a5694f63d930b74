"""Smaller operators: names, ranges of lines, arrays of records, column profiles, consumers, registered metrics, record rules."""

import datetime
import subprocess

import pytest
from pyspark.sql import functions as F

from pactlake.operators import drift, evolution, lineage, profile
from pactlake.plans import assemble
from pactlake.plans.validate import validate
from pactlake.sources import control, records

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9, tzinfo=datetime.timezone.utc)


def test_names():
    assert control.report_path("x/week3_extractions.yaml", "week3-a-b", NOW) == "week3_20240506_0708.json"
    assert control.report_path("x/My Contract.yaml", "other-a", NOW) == "my_contract_20240506_0708.json"
    assert control.stakeholder_stem("a b//c", "2024-01-02T03:04:05Z", NOW) == "stakeholder__a_b_c__20240102T030405Z"
    assert control.stakeholder_stem(None, "soon", NOW) == "stakeholder__unknown_contract__20240506T070809Z"
    assert control.report_version(["s_v1.json", "s_v12.json", "t_v99.json"], "s") == 13 and control.report_version([], "s") == 1


def test_lines_and_repositories(tmp_path):
    assert [
        control.line_range(*x) for x in ((None, None, 10), (5, 3, 10), (99, None, 10), (1, 900, 1000), (None, None, 0))
    ] == [(1, 10), (5, 5), (10, 10), (1, 200), (1, 1)]
    assert control.repository_of("/a/b/c/d.py", ["/a", "/a/b", "/z"]) == ("/a/b", "c/d.py") and control.repository_of("/q", ["/a"]) is None
    assert control.git_blame(str(tmp_path), "none", 1, 2) == [] and control.git_commit(str(tmp_path), "zz") is None
    git = lambda *a: subprocess.run(
        ["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x.org", *a], capture_output=True,
        check=True
    )
    git("init", "-q")
    for n, text in enumerate(("one\ntwo\nthree\n", "one\nTWO\nthree\n")):
        (tmp_path / "f.py").write_text(text)
        git("add", "-A")
        git("commit", "-qm", f"change {n}")
    blamed = control.git_blame(str(tmp_path), "f.py", 1, 3)
    assert [n for _, n in blamed] == [2, 1] and control.git_commit(str(tmp_path), blamed[1][0]).endswith("|change 1")


def test_arrays_of_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, 3,\n {"a": 2}, [4]]')
    good, issues = records.whole_array(spark, str(tmp_path / "a.json"))
    assert [r.a for r in good.select(F.try_variant_get("v", "$.a", "int").alias("a")).collect()] == [1, 2]
    assert sorted((r.line, r.kind, r.detail) for r in issues.collect()) == [
        (1, "skip_non_object_in_array", "3"), (3, "skip_non_object_in_array", "[4]")
    ]
    (tmp_path / "b.json").write_text("[1, ")
    assert [r.kind for r in records.whole_array(spark, str(tmp_path / "b.json"))[1].collect()] == ["malformed_line"]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nnot json\n')
    assert [(r.kind, r.detail) for r in records.lenient(spark, str(tmp_path / "c.jsonl"))[1].collect()] == [("malformed_line", "not json")]


def test_column_profile(spark):
    df = spark.createDataFrame(
        [("1.5", 3, ["x"], "a"), ("oops", 5, ["x"], "b"), (None, None, None, "a")],
        "some_confidence string, n int, tags array<string>, s string"
    )
    r = {x.column_name: x for x in profile.column_profile(df).collect()}
    assert (
        r["some_confidence"].n, r["some_confidence"].dropped, r["some_confidence"].mean
    ) == (1, 1, 1.5) and r["n"].stddev == pytest.approx(2**0.5)
    assert r["s"].samples == ["a", "b"] and r["s"].n is None and r["tags"].samples == ['{"tags":["x"]}'] and r["tags"].distinct == 1
    assert profile.optional_where_coerced(
        {"some_confidence": {"required": True}, "n": {"required": True}}, profile.column_profile(df)
    ) == {"some_confidence": {"required": False}, "n": {"required": True}}


def test_profiles_make_no_row_of_a_value(spark):
    rows = [(f"k{i % 40:02d}", i % 12 if i % 5 else None, -0.0 if i % 2 else 0.0, ["a"] if i % 2 else None, "red" if i % 3 else "") for i in range(900)]
    df = spark.createDataFrame(rows, "name string, n int, zero double, tags array<string>, colour string").repartition(6)
    least = profile.least_values(df, df.columns)
    assert "Generate" not in least._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in least.collect():
        got.setdefault(r.column_name, []).append(r.v)
    assert {k: sorted(v) for k, v in got.items()} == {
        "name": [f"k{i:02d}" for i in range(5)], "n": ["0", "1", "10", "11", "2"], "zero": ["-0.0", "0.0"], "tags": ['{"tags":["a"]}'],
        "colour": ["", "red"]
    }
    exact = profile.structural_profile(df, exact=True)
    assert {r.column_name: r.cardinality for r in exact.collect()} == {"name": 40, "n": 12, "zero": 1, "tags": 1, "colour": 2}
    s = profile.suggest_clauses(df)
    assert s["colour"]["enum"] == ["", "red"] and "enum" not in s["name"] and not s["n"]["required"]
    none = df.limit(0)
    assert {r.samples for r in profile.column_profile(none).collect()} == {None} and "enum" not in profile.suggest_clauses(none)["colour"]


def test_byte_histogram_of_rows(spark):
    df = spark.createDataFrame([(1, "aab"), (2, None), (3, ""), (4, "\u00e9" * 30000), (1, "b")], "k int, t string")
    h = drift.byte_histogram(df, "k", "t")
    assert "Exchange" not in h._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.k, r.byte, round(r.share, 6)) for r in h.collect())
    half = round(25000 / (2 * 25000.0**2) ** 0.5, 6)
    assert got == [(1, 97, round(2 / 5**0.5, 6)), (1, 98, round(1 / 5**0.5, 6)), (1, 98, 1.0), (4, 0xA9, half), (4, 0xC3, half)]


def test_byte_histogram_in_bounded_batches(spark):
    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Bytes", "Records")]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, str(1 << 30))
        rows = [(i, None if i % 7 == 0 else "ab\u00e9" * (i % 50)) for i in range(9000)]
        h = drift.byte_histogram(spark.createDataFrame(rows, "k int, t string").coalesce(1), "k", "t")
        # 256 counts are kept of each text of a batch, and all of the batch's texts
        assert int(spark.conf.get(keys[0]).rstrip("b")) <= 8 << 20 and int(spark.conf.get(keys[1])) <= 4096
        got = h.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("share"), 6).alias("low"), F.round(F.max("share"), 6).alias("high")).collect()
        assert len(got) == sum(1 for i, t in rows if t) and {(r.n, r.low, r.high) for r in got} == {(4, 0.5, 0.5)}
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_clauses_in_words(spark):
    old = evolution.flatten(spark, {"a": {"type": "integer", "required": True, "minimum": 1}, "b": {"type": "string", "enum": ["x", "y"]}})
    new = evolution.flatten(spark, {"a": {"type": "number"}, "b": {"type": "integer"}})
    assert {r.path: r.line for r in evolution.lines(old).collect()} == {"a": "integer, required, min=1.0", "b": "string, enum=x|y"}
    assert [(r.path, r.old_type, r.new_type) for r in evolution.widenings(old, new).collect()] == [("a", "integer", "number")]


def test_consumers(spark):
    e = spark.createDataFrame(
        [("table::t", f"pipeline::{i:02}", "CONSUMES") for i in range(30)] + [("x", "y", "CONSUMES")],
        "source string, target string, relationship string"
    )
    assert lineage.downstream_of(e, "table::t").count() == 25 and lineage.downstream_generic(e).count() == 15 and lineage.pipeline_targets(e).count() == 30
    assert lineage.lineage_section(
        lineage.downstream_of(e, "table::t", 2), "ask"
    )["downstream"] == [{"id": "pipeline::00"}, {"id": "pipeline::01"}]
    assert [r.node for r in lineage.contract_seeds({"lineage": {"downstream": [{"id": "y"}, {"id": "gone"}]}}, e).collect()] == ["y"]


def test_registered_metrics(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (3, None, "b")], "n int, x double, s string")
    every = {r.column: r for r in drift.contract_stats(df, "none").collect()}
    assert (every["n"].min, every["n"].max, every["x"].n) == (1.0, 3.0, 1) and set(every) == {"n", "x"}
    drift.register_extractors("mine", half="n / 2", x=F.col("x"))
    try:
        assert {r.column: r.mean for r in drift.contract_stats(df, "mine").collect()} == {"half": 1.0, "x": 2.0}
    finally:
        del drift.EXTRACTORS["mine"]


def test_rules_of_records(spark):
    t = "scores map<string,struct<score:double,weight:double>>, overall_score double, overall_verdict string"
    rows = [({"a": (4.0, 1.0), "b": (2.0, 1.0)}, 3.0, "PASS"), ({"a": (4.5, 0.0)}, 4.5, "PASS"), ({"a": (6.0, 1.0)}, 5.0, "ODD")]
    got = {
        r.check_id: r.records_failing for r in validate(
            spark.createDataFrame(rows, t), {"id": "v-1", "rules": assemble.EXTENSION_RULES["verdicts"]}
        ).collect()
    }
    assert got == {"v.scores.range": 2, "v.overall_score.mean": 1, "v.verdict.enum": 1}
    e = spark.createDataFrame(
        [("Opened", '{"id": 1}'), ("Opened", "{}"), ("Closed", "{}")], "event_type string, p string"
    ).select("event_type", F.parse_json("p").alias("payload"))
    rules = assemble.payload_rules({"Opened": ["id"], "Closed": []})
    assert {r.check_id: r.records_failing for r in validate(e, {"id": "e-1", "rules": rules}).collect()} == {"e.payload.Opened.required": 1}
    t = "extracted_facts array<struct<entity_refs:array<string>>>, entities array<struct<entity_id:string,type:string>>"
    x = spark.createDataFrame([([(["e1"],)], [("e1", "PERSON")]), ([(["e2"],)], [("e1", "CAT")])], t)
    got = {r.check_id: r.records_failing for r in validate(x, {"id": "x-1", "rules": assemble.EXTENSION_RULES["extractions"]}).collect()}
    assert got == {"x.entities.type.enum": 1, "x.entity_refs.reference": 1}
