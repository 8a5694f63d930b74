"""Times whatever the session's zone; rules, enums and names that once went wrong; stored sketches; joins without pairs."""

import re

import pytest
from pyspark.sql import functions as F

from pactlake.functions.text import parse_time, utc_z
from pactlake.operators import lineage, migrate, registry, sketches
from pactlake.plans import drivers
from pactlake.plans.validate import validate

ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_are_utc_in_any_session(spark, zone):
    texts = {
        "2024-01-01T00:00:00+00:00": "2024-01-01T00:00:00Z", "2024-01-01T00:00:00": "2024-01-01T00:00:00Z", "2024-01-01": "2024-01-01T00:00:00Z",
        "2024-03-10 02:30:00": "2024-03-10T02:30:00Z", "2024-03-10T07:30Z": "2024-03-10T07:30:00Z", "2024-11-03T06:30:00.25+05:30": "2024-11-03T01:00:00Z",
        "2024-11-03 01:30": "2024-11-03T01:30:00Z", "03/10/2024": None, "": None
    }
    df = spark.createDataFrame([*texts.items(), (None, None)], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", utc_z(F.col("t")).alias("got")).collect())
    typed = spark.sql("select timestamp'2024-03-10 07:30:00Z' as a, timestamp_ntz'2024-03-10 07:30:00' as b, date'2024-03-10' as c")
    assert tuple(typed.select(*[utc_z(F.col(c)) for c in "abc"]).first()) == ("2024-03-10T07:30:00Z", "2024-03-10T07:30:00Z", "2024-03-10T00:00:00Z")
    assert df.where(parse_time(F.col("t")).isNotNull()).count() == 7


def test_events_and_their_order_are_the_same_in_any_session(spark, zone):
    raw = spark.createDataFrame(
        [
            ("s-1", "E", '{"started_at": "2024-01-01T00:00:00+00:00"}', "2024-01-01T01:00:00"), ("s-1", "E", '{"made_at": "2024-01-01T09:00:00+00:00"}', "2024-01-01T08:00:00Z"),
            ("s-1", "E", "{}", "2024-01-01T06:00:00+05:30")
        ], "stream_id string, event_type string, payload string, recorded_at string"
    )
    good, bad = migrate.events(raw, "shop")
    assert bad.count() == 0
    assert [tuple(r) for r in good.orderBy("sequence_number").select("sequence_number", "occurred_at", "recorded_at").collect()] == [
        (1, "2024-01-01T00:30:00Z", "2024-01-01T00:30:00Z"), (2, "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"), (3, "2024-01-01T08:00:00Z", "2024-01-01T08:00:00Z")
    ]
    late = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01T01:00:00Z"), ("2024-01-01 02:00:00", "2024-01-01T01:00:00Z")], "recorded_at string, occurred_at string")
    got = validate(late, {"id": "e-1", "rules": [r for r in drivers.EVENTS["rules"] if r["kind"] == "expression"]}).first()
    assert (got.status, got.records_failing) == ("FAIL", 1)


def by_id(df):
    return {r.check_id: r for r in df.collect()}


def test_a_rule_that_fails_in_a_row_is_alone(spark):
    df = spark.createDataFrame([(0, "a"), (1, "2"), (-1, "3")], "x int, s string")
    rules = [
        {"kind": "expression", "name": "share", "holds": "1 / x > 0"}, {"kind": "expression", "name": "cast", "holds": "cast(s as int) < 3"},
        {"kind": "expression", "name": "bad", "holds": "x >"}, {"kind": "expression", "name": "far", "holds": "element_at(array(1), x + 5) = 1"}
    ]
    contract = {"id": "r-1", "schema": {"x": {"required": True}}, "rules": rules, "derived": {"inverse": "1 / x"}, "quality": {"checks": ["max(inverse) <= 1"]}}
    got = by_id(validate(df, contract))
    assert {k: (r.status, r.records_failing) for k, r in got.items()} == {
        "r.x.required": ("PASS", 0), "r.share": ("FAIL", 1), "r.cast": ("FAIL", 1), "r.bad": ("ERROR", 0), "r.far": ("PASS", 0), "r.quality.inverse.max": ("PASS", 0)
    }
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_enums_by_type_and_names_with_dots(spark):
    df = spark.createDataFrame(
        [(1.0, True, 2, "true", "x", "y"), (3.0, False, 3, "b", None, "x")], "d double, b boolean, i int, s string, `a.b` string, a string"
    ).withColumn("dec", F.col("d").cast("decimal(10,2)"))
    schema = {
        "d": {"enum": [1, 2]}, "b": {"enum": [True]}, "i": {"enum": ["2", 7]}, "s": {"enum": [True, "b"]}, "dec": {"enum": [1, "3.0"]},
        "a.b": {"required": True, "unique": True, "enum": ["x"]}
    }
    got = by_id(validate(df, {"id": "e-1", "schema": schema}))
    assert {k: r.records_failing for k, r in got.items()} == {
        "e.d.enum": 1, "e.b.enum": 1, "e.i.enum": 1, "e.s.enum": 0, "e.dec.enum": 0, "e.a.b.required": 1, "e.a.b.unique": 0, "e.a.b.enum": 0
    }


def test_keywords_are_found_within_words_without_pairs(spark):
    nodes = ["file::src/extractor.py", "file::document_refinery.py", "pipeline::week3refinery", "file::other", "t::ab", None]
    nodes = spark.createDataFrame([(n,) for n in nodes], "node_id string")
    topics = spark.createDataFrame([("fact", k) for k in ("extract", "refinery", "week3", "Ab", "")] + [("lost", "zzz")], "trigger string, keyword string")
    fails = spark.createDataFrame([("w.fact_id.x", "fact_id"), ("w.lost", "y"), ("w.z", None)], "check_id string, column_name string")
    named = spark.createDataFrame([("pipeline::named",)], "node string")
    seeds = lineage.keyword_seeds(fails, nodes, topics, named=named)
    assert sorted(tuple(r) for r in seeds.collect()) == [
        ("w.fact_id.x", "file::document_refinery.py"), ("w.fact_id.x", "file::src/extractor.py"), ("w.fact_id.x", "pipeline::week3refinery"),
        ("w.fact_id.x", "t::ab"), ("w.lost", "pipeline::named"), ("w.z", "pipeline::named")
    ]
    bare = [r.node for r in lineage.keyword_seeds(fails.where("check_id = 'w.z'"), nodes, topics).collect()]
    assert bare == ["file::document_refinery.py", "file::other", "file::src/extractor.py"]
    found = lineage.containing(nodes.where("node_id is not null"), "node_id", topics.select("keyword").distinct(), "keyword")
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())


def test_prefixes_meet_by_equality(spark):
    f = spark.createDataFrame([("c", f"k{i}", x) for i, x in enumerate(["a.b", "a", "*", "x[*].y, q", "", None, "ab"])], "contract_id string, check_id string, column_name string")
    r = spark.createDataFrame([("c", "s", [("a.b.c", "1"), ("a.b", "2"), ("x.y.z", "3"), ("ab.c", "4")]), ("d", "t", [("a", "5")])],
                              "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>")
    hits = registry.blast_radius(f, r)
    assert sorted((x.check_id, x.reason) for x in hits.collect()) == [("k0", "1"), ("k1", "1"), ("k2", "1"), ("k3", "3"), ("k6", "4")]
    # the only join by contract alone is that of *
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, \(\(?contract_id", plan)) == 3 and "startswith" not in plan.lower()


def test_fields_that_many_failures_name_are_matched_once(spark):
    f = spark.createDataFrame([("c", f"k{i}", "a.b") for i in range(50)] + [("c", "k0", "a.b"), ("c", None, "a.b"), ("c", "z", "q,*"), (None, "k0", "a.b")], "contract_id string, check_id string, column_name string")
    r = spark.createDataFrame([("c", "s", [("x", "0"), ("a.b.c", "1"), ("a", "2")]), ("c", "t", [("a.b", "3")])],
                              "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>")
    hits = registry.blast_radius(f, r)
    want = {(k, s, n) for k in [*(f"k{i}" for i in range(50)), None] for s, n in (("s", "1"), ("t", "3"))} | {("z", "s", "0"), ("z", "t", "3")}
    got = [(x.check_id, x.subscriber_id, x.reason) for x in hits.collect()]
    assert len(got) == len(want) and set(got) == want
    # first matches are sought for distinct fields, not for each failure that names them
    sought = [x for x in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "min_by" in x]
    assert sought and not any("check_id" in x for x in sought)


def test_profiles_of_parts_are_profiles_of_the_whole(spark, tmp_path):
    rows = [(i % 4, float((i * 7919) % 10007), f"v{i % 300}", None if i % 10 == 0 else i % 50) for i in range(20_000)]
    df = spark.createDataFrame([*rows, (0, float("nan"), None, None)], "day int, x double, s string, n int")
    store = sketches.Store(spark, str(tmp_path / "p"))
    for day in range(4):
        store.take(str(day), df.where(F.col("day") == day).drop("day"))
    got = {r.column_name: r for r in store.profile().collect()}
    whole = {r.column_name: r for r in sketches.profile(sketches.sketch(df.drop("day"))).collect()}
    for c in ("x", "s", "n"):
        for k in ("rows", "nulls", "n", "min", "max", "dropped"):
            assert got[c][k] == whole[c][k]
    assert (got["x"].n, got["x"].dropped, got["n"].nulls, got["s"].p50) == (20_000, 1, 2001, None)
    values = sorted(r[1] for r in rows)
    for q, p in ((0.25, "p25"), (0.5, "p50"), (0.99, "p99")):
        assert abs(sum(v <= got["x"][p] for v in values) / len(values) - q) <= sketches.RANK
    assert abs(got["s"].cardinality - 300) <= 12 and abs(got["n"].cardinality - 45) <= 2
    # a day that is taken again replaces itself, and some days have a profile of their own
    store.take("3", df.where("day = 3").drop("day"))
    assert {r.column_name: r["rows"] for r in store.profile().collect()} == {c: 20_001 for c in ("x", "s", "n")}
    assert store.profile("1", "2").where("column_name = 'x'").first()["rows"] == 10_000
    again = {r.column_name: r for r in sketches.profile(sketches.merged(store.parts().drop("part"))).collect()}
    assert again["x"]["stddev"] == pytest.approx(whole["x"]["stddev"], rel=1e-9)
    assert sketches.profile(sketches.sketch(df.limit(0))).count() == 0
