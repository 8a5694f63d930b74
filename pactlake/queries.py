"""Queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import uuid5
from .operators import ai, attribution, drift, evolution, history, lineage, migrate, moments, profile, project, registry, report, sketches
from .plans import assemble, drivers
from .model import RESULT
from .plans.validate import duplicate_groups, validate

EVENT_TYPES = ["click", "view", "purchase", "signup"]
CONTRACT = {
    "id": "lineitem-shipments",
    "schema": {
        "l_orderkey": {"type": "integer", "required": True, "minimum": 1},
        "l_quantity": {"type": "number", "required": True, "minimum": 5},
        "l_discount": {"type": "number", "minimum": 0.0, "maximum": 0.08},
        "l_returnflag": {"type": "string", "enum": ["A", "N"]},
        "l_linestatus": {"type": "string", "pattern": "[FO]$"},
    },
    "quality": {"checks": ["row_count >= 1", "min(l_quantity) >= 1", "max(l_tax) <= 0.01", "missing_count(l_partkey) = 0"]},
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _contract(spark: SparkSession, d: str) -> dict:
    rules = [
        {"kind": "unique", "name": "line.unique", "column": "l_orderkey,l_linenumber", "keys": ["l_orderkey", "l_linenumber"]},
        {
            "kind": "reference", "name": "order.reference", "column": "l_orderkey",
            "table": _t(spark, d, "orders").where("o_orderstatus <> 'P'"), "key": "o_orderkey", "severity": "HIGH"
        }
    ]
    return CONTRACT | {"rules": rules}


def results(spark: SparkSession, d: str, samples: bool = False) -> DataFrame:
    return validate(_t(spark, d, "lineitem"), _contract(spark, d), samples)


_SHORT = ["check_id", "column_name", "check_type", "status", "severity", "records_failing"]


def validation_report(s, d):
    return results(s, d).select(_SHORT)


_ROWS = """
WITH c AS (SELECT count(*) FILTER (WHERE l_orderkey IS NULL) a, count(*) FILTER (WHERE l_orderkey < 1) b, count(*) FILTER (WHERE l_quantity IS NULL) c1, count(*) FILTER (WHERE l_quantity < 5) d, count(*) FILTER (WHERE l_discount < 0) e, count(*) FILTER (WHERE l_discount > 0.08) f,
 count(*) FILTER (WHERE l_returnflag NOT IN ('A','N')) g, count(*) FILTER (WHERE NOT regexp_matches(l_linestatus,'^(?:[FO]$)')) h, count(*) FILTER (WHERE l_partkey IS NULL) m, CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END rc, CASE WHEN min(l_quantity) >= 1 THEN 0 ELSE count(*) FILTER (WHERE l_quantity < 1) END mq, CASE WHEN max(l_tax) <= 0.01 THEN 0 ELSE count(*) FILTER (WHERE l_tax > 0.01) END mt FROM lineitem),
u AS (SELECT coalesce(sum(n),0) n FROM (SELECT count(*) n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey,l_linenumber HAVING count(*)>1)),
r AS (SELECT count(*) n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus <> 'P' AND o.o_orderkey IS NOT DISTINCT FROM l.l_orderkey)),
x AS (SELECT 'lineitem.l_orderkey.required' check_id,'l_orderkey' column_name,'not_null' check_type,'CRITICAL' sev, a n FROM c UNION ALL SELECT 'lineitem.l_orderkey.minimum','l_orderkey','range','CRITICAL',b FROM c UNION ALL SELECT 'lineitem.l_quantity.required','l_quantity','not_null','CRITICAL',c1 FROM c
 UNION ALL SELECT 'lineitem.l_quantity.minimum','l_quantity','range','CRITICAL',d FROM c UNION ALL SELECT 'lineitem.l_discount.minimum','l_discount','range','CRITICAL',e FROM c UNION ALL SELECT 'lineitem.l_discount.maximum','l_discount','range','CRITICAL',f FROM c UNION ALL SELECT 'lineitem.l_returnflag.enum','l_returnflag','enum','CRITICAL',g FROM c
 UNION ALL SELECT 'lineitem.l_linestatus.pattern','l_linestatus','pattern','CRITICAL',h FROM c UNION ALL SELECT 'lineitem.quality.l_partkey.missing_count','l_partkey','completeness','CRITICAL',m FROM c UNION ALL SELECT 'lineitem.line.unique','l_orderkey,l_linenumber','unique','CRITICAL',n FROM u UNION ALL SELECT 'lineitem.order.reference','l_orderkey','referential','HIGH',n FROM r
 UNION ALL SELECT 'lineitem.quality.row_count','*','volume','CRITICAL',rc FROM c UNION ALL SELECT 'lineitem.quality.l_quantity.min','l_quantity','range','CRITICAL',mq FROM c UNION ALL SELECT 'lineitem.quality.l_tax.max','l_tax','range','CRITICAL',mt FROM c UNION ALL SELECT 'lineitem.'||f||'.type_match',f,'type','CRITICAL',0 FROM (VALUES ('l_orderkey'),('l_quantity'),('l_discount')) v(f)),
res AS (SELECT check_id,column_name,check_type,CASE WHEN n>0 THEN 'FAIL' ELSE 'PASS' END status,CASE WHEN n>0 THEN sev ELSE 'LOW' END severity,CAST(n AS BIGINT) records_failing FROM x)
"""
_FAILS = "events e WHERE event_type NOT IN ('click','view','purchase','signup')"


def _check(
    df: DataFrame, name: str, schema: dict | None = None, rules: list | None = None, lines: tuple = ("row_count >= 1",)
) -> DataFrame:
    return validate(
        df, {"id": f"{name}-1", "schema": schema or {}, "rules": rules or [], "quality": {"checks": list(lines)}},
        samples=False
    )


def _failing(*ids: str):
    return F.coalesce(F.sum(F.when(F.col("check_id").isin(*ids), F.col("records_failing"))), F.lit(0))


def _rows(name: str):
    return F.max(F.when(F.col("check_id") == f"{name}.quality.row_count", F.split("actual_value", "=")[1].cast("long")))


def required_null_counts(s, d):
    j = _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left")
    r = _check(j, "labelled", {"text": {"required": True}, "quality": {"required": True}})
    return r.agg(
        _rows("labelled").alias("total"), _failing("labelled.text.required").alias("text_nulls"),
        _failing("labelled.quality.required").alias("quality_nulls")
    )


def unique_composite_key(s, d):
    g = duplicate_groups(_t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records_failing"))


def pattern_and_format(s, d):
    p = _check(_t(s, d, "pages"), "pages", {"url": {"pattern": "https?://[a-z0-9.-]+/"}})
    c = _check(_t(s, d, "customer"), "customers", {"c_name": {"pattern": "Customer#[0-9]*[02468]$"}})
    return p.unionByName(c).agg(_failing("pages.url.pattern").alias("bad_urls"), _failing("customers.c_name.pattern").alias("bad_names"))


def enum_conformance(s, d):
    return drift.violation_rate(_t(s, d, "events"), "event_type", EVENT_TYPES).select(
        "total", "violations", F.round("rate", 6).alias("rate"), "status"
    )


def range_violations(s, d):
    n = _check(_t(s, d, "lineitem"), "lines", {"l_discount": {"minimum": 0, "maximum": 0.08}})
    c = _check(_t(s, d, "customer"), "customers", {"c_acctbal": {"minimum": 0}}, lines=("min(c_acctbal) >= 0",))
    least = F.max(F.when(F.col("check_id") == "customers.quality.c_acctbal.min", F.split("actual_value", "=")[1].cast("double")))
    discounts = _failing("lines.l_discount.minimum", "lines.l_discount.maximum")
    return n.unionByName(c).agg(
        discounts.alias("discounts"), _failing("customers.c_acctbal.minimum").alias("balances"),
        F.round(least, 2).alias("least")
    )


def temporal_order(s, d):
    j = _t(s, d, "lineitem").join(_t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = _check(
        j, "shipments",
        rules=[{"kind": "expression", "name": "order", "holds": "l_shipdate >= o_orderdate", "check_type": "temporal"}]
    )
    return r.agg(_rows("shipments").alias("pairs"), _failing("shipments.order").alias("records_failing"))


def arithmetic_identity(s, d):
    r = _check(
        _t(s, d, "documents"), "documents",
        rules=[{"kind": "expression", "name": "n_chars", "holds": "n_chars = char_length(text)", "check_type": "arithmetic"}]
    )
    return r.agg(_rows("documents").alias("rows"), _failing("documents.n_chars").alias("records_failing"))


def referential_integrity(s, d):
    o = _t(s, d, "orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey")
    return _t(s, d, "lineitem").join(
        o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"
    ).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("orphans"))


def sequence_monotonic(s, d):
    l = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return report.monotonic_violations(
        l, "l_orderkey", "l_linenumber", "l_partkey"
    ).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("breaks"))


def assign_sequence(s, d):
    return report.assign_sequence(_t(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "sequence_number")


def pipeline_gate(s, d):
    return report.gate(results(s, d))


def health_score(s, d):
    return report.health_score(results(s, d))


def status_counts(s, d):
    return report.status_counts(results(s, d))


def severity_rollup(s, d):
    return report.severity_rollup(results(s, d))


def top_failures(s, d):
    return report.top_failures(results(s, d)).select(_SHORT)


def numeric_profile(s, d):
    r = profile.numeric_profile(_t(s, d, "orders"), ["o_totalprice", "o_custkey"], exact=True)
    return r.select("column_name", "n", "nulls", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "p25", "p50", "p95", "stddev")])


def structural_profile(s, d):
    return profile.structural_profile(
        _t(s, d, "events"), ["event_id", "user_id", "event_type", "value"], exact=True
    ).select("column_name", "null_fraction", "cardinality")


def dominant_pattern(s, d):
    """The commonest class of ids, times, numbers, digests and texts, each column's own."""
    e = _t(s, d, "events").select(
        F.when(F.col("event_id") % 7 == 0, F.md5("props")).otherwise(F.regexp_replace(F.md5("props"), _ID, "$1-$2-$3-$4-$5")).alias("uid"),
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"),
        F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("user_id").cast("string")).alias("number"), F.sha2("props", 256).alias("digest")
    )
    found = [profile.dominant_pattern(e, c).withColumn("column_name", F.lit(c)) for c in e.columns]
    found += [profile.dominant_pattern(_t(s, d, t), c).withColumn("column_name", F.lit(c)) for t, c in (("customer", "c_name"), ("documents", "text"))]
    return functools.reduce(DataFrame.unionByName, found)


def shape_signature(s, d):
    return profile.shape_samples(_t(s, d, "nation"), "n_name", None)


def shape_signature_documents(s, d):
    return profile.shape_samples(_t(s, d, "documents"), "text", None)


def drift_by_day(s, d):
    e = _t(s, d, "events").withColumn("day", F.to_date("ts"))
    base = drift.column_stats(e.where("day < date'2024-01-16'"), {"value": F.col("value")})
    days = e.where("day >= date'2024-01-16'").groupBy(F.col("day").cast("string").alias("day")).agg(
        F.lit("value").alias("column"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count("value").alias("n")
    )
    return drift.drift(days, base).select("day", "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"), "status")


def violation_rate_trend(s, d):
    e = _t(s, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return drift.violation_rate(e, "event_type", EVENT_TYPES, by=["day"], baseline=0.2).select(
        "day", "total", "violations", F.round("rate", 6).alias("rate"), "trend"
    )


def circuit_breaker(s, d):
    e = _t(s, d, "events").where(~F.col("event_type").isin(EVENT_TYPES)).select("event_id", "event_type", "ts")
    return report.circuit_breaker(e, "event_type", "ts").select("event_id", "recent", "tripped")


def embedding_centroid_drift(s, d):
    e = _t(s, d, "embeddings")
    every = drift.centroid(e, "embedding").withColumnRenamed("centroid", "all")
    return drift.centroid(e, "embedding", ["label"]).crossJoin(every).select(
        "label", F.round(1 - drift.cosine(F.col("centroid"), F.col("all")), 6).alias("drift")
    )


def byte_histogram(s, d):
    h = drift.byte_histogram(_t(s, d, "region"), "r_regionkey", "r_name")
    return h.select("r_regionkey", "byte", F.round("share", 6).alias("share"))


def byte_histogram_documents(s, d):
    h = drift.byte_histogram(_t(s, d, "documents"), "doc_id", "text")
    return h.select("doc_id", "byte", F.round("share", 6).alias("share"))


_REGISTRY = [
    ("lineitem-shipments", "billing", [("l_discount", "totals"), ("l_tax", "totals")]),
    ("lineitem-shipments", "planning", [("l_quantity", "stock")]),
    ("lineitem-shipments", "ledger", [("l_orderkey", "keys"), ("l_orderkey.line", "lines")])
]


def _hits(s, d):
    fails = results(s, d).where("status <> 'PASS'").select(F.lit("lineitem-shipments").alias("contract_id"), "check_id", "column_name")
    reg = s.createDataFrame(
        _REGISTRY, "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>"
    )
    return fails, registry.blast_radius(fails, reg)


def blast_radius_lookup(s, d):
    return _hits(s, d)[1].select("check_id", "subscriber_id", "matched_field", "reason")


def registry_gap(s, d):
    fails, hits = _hits(s, d)
    return registry.gaps(fails, hits).select("check_id")


_HITS = _ROWS + """, reg(subscriber_id, nth, bf, reason) AS (VALUES ('billing',0,'l_discount','totals'),('billing',1,'l_tax','totals'),('planning',0,'l_quantity','stock'),('ledger',0,'l_orderkey','keys'),('ledger',1,'l_orderkey.line','lines')),
f AS (SELECT check_id, column_name, unnest(string_split(column_name, ',')) failing FROM res WHERE status <> 'PASS'),
h AS (SELECT check_id, subscriber_id, bf matched_field, reason, row_number() OVER (PARTITION BY check_id, subscriber_id ORDER BY nth) k FROM f JOIN reg ON failing = '*' OR failing = bf OR starts_with(bf, failing || '.') OR starts_with(failing, bf || '.'))
"""


def _edges(s, d):
    r, n, c = (_t(s, d, x) for x in ("region", "nation", "customer"))
    e = n.select(F.concat(F.lit("region::"), "n_regionkey").alias("source"), F.concat(F.lit("nation::"), "n_nationkey").alias("target"))
    return e.unionByName(
        c.select(F.concat(F.lit("nation::"), "c_nationkey").alias("source"), F.concat(F.lit("customer::"), "c_custkey").alias("target"))
    ), r


def lineage_bfs(s, d):
    edges, r = _edges(s, d)
    return lineage.reach(r.where("r_regionkey = 1").select(F.concat(F.lit("region::"), "r_regionkey").alias("node")), edges, 2)


def schema_diff_classify(s, d):
    """Two versions of a clause for every customer, made of the orders with even and with odd keys: what changed between them."""
    price = F.col("o_totalprice")
    clause = _t(s, d, "orders").groupBy((F.col("o_orderkey") % 2).alias("side"), F.concat(F.lit("customer."), "o_custkey").alias("path")).agg(
        F.when(F.max(price) > 400000, "number").otherwise("integer").alias("type"), (F.count(F.lit(1)) > 5).alias("required"),
        F.floor(F.min(price) / 200000).cast("double").alias("minimum"), F.floor(F.max(price) / 200000).cast("double").alias("maximum"),
        F.array_sort(F.collect_set("o_orderstatus")).alias("enum")
    )
    return evolution.diff(*[clause.where(F.col("side") == k).drop("side") for k in (0, 1)])


def blame_rank_topk(s, d):
    return blame_rank_all_orders(s, d)


def blame_rank_all_orders(s, d):
    o = _t(s, d, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("committed"),
        F.to_timestamp(F.lit("1998-08-02 00:00:00")).alias("detected"),
        (F.col("o_orderkey") % 3).cast("int").alias("hops")
    )
    return lineage.rank_blame(o, "o_custkey", "detected", "committed", "hops", "o_orderkey", 2).select(
        "o_custkey", "o_orderkey", "score", F.col("rank").cast("long").alias("rank")
    )


def quarantine_split(s, d):
    _, bad = migrate.split(
        _t(s, d, "conversations"),
        {"empty": F.trim("text") == "", "long": F.char_length("text") > 200, "role": ~F.col("role").isin("user", "assistant")}
    )
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def json_path_projection(s, d):
    v = _t(s, d, "events").select("event_type", F.try_parse_json("props").alias("v"))
    return v.select(
        "event_type", project.at("k", "bigint").alias("k")
    ).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def uuid5_ids(s, d):
    return _t(s, d, "events").select(
        "event_id",
        uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("uid")
    )


def explode_outer_flatten(s, d):
    turns = _t(s, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.char_length("text").alias("chars")))).alias("turns")
    )
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("conv_id")).join(turns, "conv_id", "left")
    return migrate.flatten_outer(docs, "turns", "fact_")


def event_projection(s, d):
    e = _t(s, d, "events").select(F.col("event_id").alias("id"), F.try_parse_json("props").alias("v"))
    return e.select("id", project.at("k", "bigint").alias("k"), F.size(F.map_keys(F.col("v").cast("map<string,variant>"))).alias("keys"))


def type_mix(s, d):
    r = project.type_mix(_t(s, d, "events").select(F.try_parse_json("props").alias("v")), "k")
    return r.select(F.array_join("kinds", ",").alias("kinds"), "n", "status")


def snapshot_pair(s, d):
    o = _t(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    p = history.latest_pair(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"))
    return p.select("o_custkey", "o_orderkey", "nth", "status")


def rate_history(s, d):
    e = _t(s, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("string"))
    r = drift.violation_rate(e, "event_type", EVENT_TYPES, by=["user_id", "hour"])
    return history.rate_history(r, "user_id", "hour").select("user_id", "hour", "violations", "nth")


def effective_mode(s, d):
    e = _t(s, d, "events").select("event_id", "event_type", "ts", "user_id")
    return history.effective_mode(report.circuit_breaker(e, "user_id", "ts"), "user_id")


_TOPICS = [("copper", "copper"), ("size", "small"), ("size", "large"), ("steel", "steel")]


def keyword_seeds(s, d):
    nodes = _t(s, d, "part").select(F.concat(F.lit("file::"), "p_type", F.lit("/"), "p_partkey").alias("node_id"))
    fails = s.createDataFrame(
        [("part.size.minimum", "p_size"), ("part.metal.enum", "copper"), ("part.other", "p_name")],
        "check_id string, column_name string"
    )
    return lineage.keyword_seeds(fails, nodes, s.createDataFrame(_TOPICS, "trigger string, keyword string"), 40)


def ambiguous_columns(s, d):
    e = _t(s, d, "labels").select(
        F.col("doc_id").alias("id"), "quality", F.lit(1).alias("toxicity_version"),
        F.nullif("toxic", F.lit(0)).alias("metadata")
    )
    return assemble.ambiguous_columns(profile.structural_profile(e, exact=True)).select("column_name", "score")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def drift_all_columns(s, d):
    l = _t(s, d, "lineitem")
    stats = lambda flag: drift.column_stats(l.where(F.col("l_linestatus") == flag), {c: F.col(c) for c in _NUMBERS})
    return drift.drift(stats("O"), stats("F")).select("column", "n", F.round("mean", 4).alias("mean"), F.round("z", 6).alias("z"), "status")


def rate_by_version(s, d):
    r = drift.violation_rate(_t(s, d, "orders"), "o_orderstatus", ["F", "O"], by=["o_orderpriority"], baseline=0.3)
    return r.select("o_orderpriority", "total", "violations", F.round("rate", 6).alias("rate"), "trend", "status")


def tiered_health(s, d):
    return report.health_score(results(s, d), {"CRITICAL": 20, "HIGH": 10, "MEDIUM": 5, "LOW": 1})


def change_counts(s, d):
    return report.change_counts(schema_diff_classify(s, d))


def migration_impact(s, d):
    """Breaking changes and who reads the field: the segments of customers in debt have subscribed to theirs."""
    changes = schema_diff_classify(s, d)
    field = F.struct(F.concat(F.lit("customer."), "c_custkey").alias("field"), F.lit("debt").alias("reason"))
    reg = _t(s, d, "customer").where("c_acctbal < 0").select(
        F.lit("c").alias("contract_id"), F.col("c_mktsegment").alias("subscriber_id"), F.array(field).alias("breaking_fields")
    )
    fails = changes.where("verdict = 'BREAKING'").select(
        F.lit("c").alias("contract_id"), F.col("path").alias("check_id"), F.col("path").alias("column_name")
    )
    return report.migration_impact(changes, registry.blast_radius(fails, reg)).select("path", "failure_mode")


def sampled_statistics(s, d):
    e = assemble.statistics_sample(_t(s, d, "orders"), "o_orderkey", 5)
    return profile.numeric_profile(e, ["o_totalprice"]).select("n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


def upstream_bfs(s, d):
    edges, _ = _edges(s, d)
    up = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return lineage.reach(
        _t(s, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer::"), "c_custkey").alias("node")),
        up, 2
    )


def first_of_repeats(s, d):
    return project.first_of_repeats(_t(s, d, "documents"), "text", "doc_id")


def next_baselines(s, d):
    e = _t(s, d, "events")
    stats = e.groupBy(F.col("event_type").alias("column")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n")
    )
    old = s.createDataFrame(
        [("click", 1.0, 2.0, 10, None), ("gone", 3.0, 4.0, 11, None)],
        "column string, mean double, std double, n long, established_at timestamp"
    )
    return history.next_baselines(stats, old, F.lit("2024-02-01").cast("timestamp"), 10).select(
        "column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n",
        F.col("established_at").isNotNull().alias("fresh")
    )


_ID = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"


def uuid_and_time_formats(s, d):
    """Ids of which every seventh is none, times of which every fifth is written otherwise."""
    e = _t(s, d, "events")
    digest = F.md5(F.col("event_id").cast("string"))
    uid = F.when(F.col("event_id") % 7 == 0, digest).otherwise(F.regexp_replace(digest, _ID, "$1-$2-$3-$4-$5"))
    at = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = e.select(uid.alias("uid"), at.alias("at"), F.nullif(F.col("event_id") % 11, F.lit(0)).cast("string").alias("maybe"))
    schema = {"uid": {"format": "uuid", "unique": True}, "at": {"format": "date-time"}, "maybe": {"format": "uuid"}}
    return _check(rows, "events", schema, lines=()).select(*_SHORT, "actual_value")


def nested_fields(s, d):
    """Required and formatted fields of a nested object; one that no row has gives no format row."""
    c = _t(s, d, "conversations")
    uid = F.when(
        F.col("turn") % 2 == 0, F.regexp_replace(F.md5(F.col("conv_id").cast("string")), _ID, "$1-$2-$3-$4-$5")
    ).when(F.col("turn") % 5 == 0, F.lit("none"))
    rows = c.select(
        F.struct(F.nullif("role", F.lit("user")).alias("role"), uid.alias("uid"), F.lit(None).cast("string").alias("gone")).alias("meta")
    )
    props = {"role": {"required": True}, "uid": {"format": "uuid"}, "gone": {"format": "uuid"}, "absent": {"required": True}}
    return _check(rows, "talk", {"meta": {"type": "object", "properties": props}}, lines=()).select(*_SHORT, "actual_value")


def array_items(s, d):
    """Numbers in the elements of arrays, in range or not; and an array of which no element has one."""
    turns = F.array_sort(
        F.collect_list(F.struct("turn", (F.char_length("text") / 100).alias("share"), F.lit(None).cast("double").alias("none")))
    )
    rows = _t(s, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    items = {"share": {"minimum": 0.2, "maximum": 1.5}, "none": {"minimum": 0}}
    return _check(rows, "talk", {"turns": {"type": "array", "items": items}}, lines=()).select(_SHORT)


def type_clauses(s, d):
    e = _t(s, d, "events").withColumn("whole", F.col("user_id").cast("double"))
    kinds = {"event_id": "integer", "value": "integer", "whole": "integer", "user_id": "number", "event_type": "number", "ghost": "integer"}
    return _check(e, "events", {k: {"type": v} for k, v in kinds.items()}, lines=()).select(*_SHORT, "actual_value")


def rules_across_fields(s, d):
    """Order within groups, an identity whose operands may be missing, an order of which only the first break counts."""
    l = _t(s, d, "lineitem").withColumn("net", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    rules = [
        {"kind": "sequence", "name": "lines", "column": "l_linenumber", "by": ["l_orderkey"]},
        {"kind": "expression", "name": "net", "holds": "net <= l_extendedprice - 1", "check_type": "arithmetic"},
        {"kind": "expression", "name": "part", "holds": "l_partkey > l_suppkey", "check_type": "temporal", "first_only": True},
        {"kind": "expression", "name": "never", "holds": "cast(null as int) = l_partkey", "empty": "NONE"},
        {"kind": "expression", "name": "odd", "holds": "no_such_column > 1"},
        {"kind": "sequence", "name": "gone", "column": "nowhere", "by": ["l_orderkey"]},
    ]
    return _check(l, "lines", rules=rules, lines=("max(l_tax) <= 8e-2", "min(l_tax) >= 1e-06", "row_count >= 1 and more")).select(_SHORT)


def validation_samples(s, d):
    """The first five failing rows of each clause, in row order."""
    r = validate(
        _t(s, d, "orders"),
        {
            "id": "orders-1",
            "schema": {"o_orderstatus": {"enum": ["F", "O"]}, "o_orderpriority": {"pattern": "[1-4]"}, "o_totalprice": {"maximum": 200000}}
        }
    )
    return r.select("check_id", F.array_join("sample_failing", ",").alias("samples"), "records_failing")


_LINEAGE_CHECKS = [("geo.region.required", "region::1"), ("geo.nation.unique", "nation::3"), ("geo.nation.unique", "nation::7")]


def attribution_per_check(s, d):
    """Two failing checks with seeds of their own: what each reaches downstream, and its likeliest changes upstream."""
    edges, _ = _edges(s, d)
    kinds = edges.withColumn("relationship", F.lit("WRITES"))
    fails = s.createDataFrame(
        [(c, c, "not_null", "FAIL", "", "", "CRITICAL", 1, [], "") for c in ("geo.region.required", "geo.nation.unique")],
        RESULT
    )
    seeds = s.createDataFrame(_LINEAGE_CHECKS, "check_id string, node string")
    reg = s.createDataFrame(
        [("geo-1", "maps", [("geo.nation.unique", "keys")])],
        "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>"
    )
    day = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    commits = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().where("node not like 'customer%'")
    age = F.make_dt_interval((F.char_length("node") % 5).cast("int"))
    commits = commits.select("node", F.concat("node", F.lit(".sql")).alias("path"), (day - age).alias("committed"), day.alias("detected"))
    v = attribution.violations(fails, "geo-1", reg, kinds, seeds, commits, 2)
    worst = F.array_join(F.transform("blame_chain", lambda b: F.concat_ws("@", b["path"], b["score"].cast("string"))), ",")
    return v.select(
        "check_id", "contamination_depth", F.array_join("direct_nodes", ",").alias("direct"),
        F.size("transitive_nodes").alias("reached"), worst.alias("blame"),
        F.array_join("subscribers", ",").alias("subscribers")
    )


def drift_results(s, d):
    l = _t(s, d, "lineitem")
    stats = lambda flag: drift.column_stats(
        l.where(F.col("l_returnflag") == flag),
        {c: F.col(c) for c in ("l_quantity", "l_tax")} | {"late": F.year("l_shipdate")}
    )
    return drift.as_results(drift.drift(stats("N"), stats("R")), "lines").select(*_SHORT)


def prompt_quarantine(s, d):
    """Prompt envelopes of documents: what is too short, too long, missing, or has a key that it shouldn't."""
    t = _t(s, d, "documents")
    rows = t.select(
        F.lpad(F.col("doc_id").cast("string"), 9, "0").substr(
            F.lit(1), F.when(F.col("doc_id") % 5 == 0, 4).otherwise(9)
        ).alias("doc_id"), F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source_path"),
        F.col("text").alias("content_preview"), F.when(F.col("doc_id") % 11 == 0, F.lit("x")).alias("note"),
    )
    good, bad = ai.validate_prompts(rows)
    return good.select(F.lit("valid").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def event_migration(s, d):
    """Raw events as envelopes: ids, sequences of streams, times; and rows whose money can't be read."""
    e = _t(s, d, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fee = F.when(F.col("event_id") % 13 == 0, F.lit("none")).otherwise(F.lit("1.5"))
    raw = e.select(
        F.concat(F.lit("agent-"), "user_id").alias("stream_id"), "event_type",
        F.to_json(F.struct(F.struct(fee.alias("fee_usd"), at.alias("created_at")).alias("order"))).alias("payload"),
        at.alias("recorded_at"), F.col("event_id").alias("line_no")
    )
    good, _ = migrate.events(raw, "shop")
    return good.select(
        "event_id", "aggregate_id", "aggregate_type", "sequence_number", "occurred_at",
        F.try_variant_get("payload", "$.order.fee_usd", "double").alias("fee")
    )


def extraction_migration(s, d):
    t = _t(s, d, "documents").select(
        F.when(F.col("doc_id") % 10 == 0, "doc123").otherwise(F.concat(F.lit("d"), "doc_id")).alias("doc_id"),
        F.col("source").alias("document_name"), (F.col("doc_id") % 4 / 4).alias("confidence_score"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp")
    )
    good, _ = migrate.extractions(t, "shop")
    return good.select(
        "doc_id", "source_path", F.col("extracted_facts")[0]["fact_id"].alias("fact_id"),
        F.col("extracted_facts")[0]["confidence"].alias("confidence"), F.size("entities").alias("entities")
    )


def lineage_snapshot(s, d):
    """The last snapshot of a graph: nations of three regions are missing, and one relationship is unknown."""
    n = _t(s, d, "nation")
    node = F.struct(F.concat(F.lit("nation::"), "n_nationkey").alias("node_id"))
    edge = F.struct(
        F.concat(F.lit("nation::"), F.lit(0)).alias("source"),
        F.concat(F.lit("nation::"), "n_nationkey").alias("target"),
        F.when(F.col("n_nationkey") == 4, "ODD").otherwise("READS").alias("relationship")
    )
    snap = n.agg(F.collect_list(F.when(F.col("n_regionkey") < 2, node)).alias("nodes"), F.collect_list(edge).alias("edges"))
    snap = snap.select(F.lit(2).alias("taken"), F.lit("s2").alias("snapshot_id"), F.lit("a" * 40).alias("git_commit"), "nodes", "edges")
    old = snap.select(
        F.lit(1).alias("taken"), F.lit(None).cast("string").alias("snapshot_id"), F.lit("x").alias("git_commit"),
        "nodes", "edges"
    )
    return drivers.lineage_results(old.unionByName(snap), "taken", "graph").select(_SHORT)


def quarantine_gate(s, d):
    r = results(s, d)
    rows = r.where(F.col("check_type").isin(*report.ROW_CHECKS))
    return report.gate(r, "QUARANTINE").unionByName(report.gate(rows, "QUARANTINE")).unionByName(
        report.gate(r.where("status = 'PASS'"), "QUARANTINE")
    )


def migration_checklist(s, d):
    return report.migration_checklist(schema_diff_classify(s, d), "billing").select("path", "nth", "item")


QUERIES = {
    f.__name__: f
    for f in (
        validation_report, required_null_counts, unique_composite_key, pattern_and_format, enum_conformance,
        range_violations, temporal_order, arithmetic_identity, referential_integrity, sequence_monotonic,
        assign_sequence, pipeline_gate, health_score, status_counts, severity_rollup, top_failures, numeric_profile,
        structural_profile, dominant_pattern, shape_signature, shape_signature_documents, drift_by_day,
        violation_rate_trend, circuit_breaker, embedding_centroid_drift, byte_histogram, byte_histogram_documents,
        blast_radius_lookup, registry_gap, lineage_bfs, schema_diff_classify, blame_rank_topk, blame_rank_all_orders,
        quarantine_split, json_path_projection, uuid5_ids, explode_outer_flatten, event_projection, type_mix,
        snapshot_pair, rate_history, effective_mode, keyword_seeds, ambiguous_columns, drift_all_columns,
        rate_by_version, tiered_health, change_counts, migration_impact, sampled_statistics, upstream_bfs,
        first_of_repeats, next_baselines, uuid_and_time_formats, nested_fields, array_items, type_clauses,
        rules_across_fields, validation_samples, attribution_per_check, drift_results, prompt_quarantine,
        event_migration, extraction_migration, lineage_snapshot, quarantine_gate, migration_checklist
    )
}

_PROFILE = "SELECT '{c}' column_name, count({c}) n, count(*) FILTER (WHERE {c} IS NULL) nulls, round(min({c})::DOUBLE,4) \"min\", round(max({c})::DOUBLE,4) \"max\", round(avg({c}),4) mean, round(quantile_cont({c}::DOUBLE,0.25),4) p25, round(quantile_cont({c}::DOUBLE,0.5),4) p50, round(quantile_cont({c}::DOUBLE,0.95),4) p95, round(stddev_pop({c}),4) stddev FROM orders"
_STRUCT = "SELECT '{c}' column_name, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) null_fraction, count(DISTINCT {c}) cardinality FROM events"
_GOOD = "('click','view','purchase','signup')"
ORACLES = {
    "validation_report": _ROWS + "SELECT * FROM res",
    "required_null_counts": (
        "SELECT count(*) total, count(*) FILTER (WHERE text IS NULL) text_nulls, count(*) FILTER (WHERE quality IS NULL) "
        "quality_nulls FROM documents LEFT JOIN labels USING (doc_id)"
    ),
    "unique_composite_key": (
        "SELECT count(*) groups, coalesce(sum(n),0)::BIGINT records_failing FROM (SELECT count(*) n FROM lineitem GROUP BY "
        "l_orderkey,l_linenumber HAVING count(*)>1)"
    ),
    "pattern_and_format": (
        "SELECT (SELECT count(*) FROM pages WHERE NOT regexp_matches(url,'^https?://[a-z0-9.-]+/')) bad_urls, (SELECT "
        "count(*) FROM customer WHERE NOT regexp_matches(c_name,'^Customer#[0-9]*[02468]$')) bad_names"
    ),
    "enum_conformance": (
        f"SELECT count(*) total, count(*) FILTER (WHERE NOT coalesce(event_type IN {_GOOD},false)) violations, round(count(*) "
        f"FILTER (WHERE NOT coalesce(event_type IN {_GOOD},false))/greatest(count(*),1),6) rate, CASE WHEN count(*) FILTER "
        f"(WHERE NOT coalesce(event_type IN {_GOOD},false))/greatest(count(*),1) > 0.05 THEN 'WARN' ELSE 'PASS' END status "
        f"FROM events"
    ),
    "range_violations": (
        "SELECT (SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.08) discounts, (SELECT count(*) FROM "
        "customer WHERE c_acctbal < 0) balances, (SELECT round(min(c_acctbal),2) FROM customer) least"
    ),
    "temporal_order": (
        "SELECT count(*) pairs, count(*) FILTER (WHERE l_shipdate < o_orderdate) records_failing FROM lineitem JOIN orders ON "
        "l_orderkey=o_orderkey"
    ),
    "arithmetic_identity": "SELECT count(*) \"rows\", count(*) FILTER (WHERE n_chars <> length(text)) records_failing FROM documents",
    "referential_integrity": (
        "SELECT l_returnflag, count(*) orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority <> "
        "'1-URGENT' AND o_orderkey=l_orderkey) GROUP BY 1"
    ),
    "sequence_monotonic": (
        "SELECT l_linenumber, count(*) breaks FROM (SELECT l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey "
        "ORDER BY l_linenumber,l_partkey) p FROM lineitem) WHERE l_linenumber <> p+1 GROUP BY 1"
    ),
    "assign_sequence": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) sequence_number FROM events",
    "pipeline_gate": _ROWS + "SELECT CASE WHEN bool_or(severity IN ('CRITICAL','HIGH')) THEN 'BLOCK' ELSE 'PASS' END pipeline_action, 'ENFORCE' mode FROM res",
    "health_score": _ROWS + "SELECT round(greatest(0.0, least(100.0, 100.0*count(*) FILTER (WHERE status='PASS')/count(*) - 20*count(*) FILTER (WHERE severity='CRITICAL' AND status='FAIL'))),2)::DOUBLE health_score, count(*) total_checks, count(*) FILTER (WHERE severity='CRITICAL' AND status='FAIL') critical_fails FROM res",
    "status_counts": _ROWS + "SELECT count(*) total_checks, count(*) FILTER (WHERE status='PASS') passed, count(*) FILTER (WHERE status='FAIL') failed, count(*) FILTER (WHERE status='WARN') warned, count(*) FILTER (WHERE status='ERROR') errored FROM res",
    "severity_rollup": _ROWS + "SELECT check_type, severity, count(*) n FROM res GROUP BY ROLLUP(check_type, severity)",
    "top_failures": _ROWS + "SELECT * FROM res WHERE status <> 'PASS' ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 99 END, records_failing DESC, check_id LIMIT 3",
    "numeric_profile": " UNION ALL ".join(_PROFILE.format(c=c) for c in ("o_totalprice", "o_custkey")),
    "structural_profile": " UNION ALL ".join(_STRUCT.format(c=c) for c in ("event_id", "user_id", "event_type", "value")),
    "dominant_pattern": (
        "SELECT 'uid' column_name, 'uuid_like' pattern, count(*) FILTER (WHERE event_id % 7 <> 0) n FROM events WHERE props IS NOT NULL UNION ALL "
        "SELECT 'at', 'iso8601_prefix', count(*) FILTER (WHERE event_id % 3 <> 0) FROM events WHERE ts IS NOT NULL UNION ALL "
        "SELECT 'number', 'numeric_string', count(user_id) FILTER (WHERE event_id % 5 <> 0) FROM events UNION ALL "
        "SELECT 'digest', 'hex64_like', count(props) FROM events UNION ALL SELECT 'c_name', 'free_text', count(c_name) FROM customer UNION ALL "
        "SELECT 'text', 'free_text', count(*) FROM documents WHERE NOT regexp_matches(text, '(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{64}|[0-9]+)$|^[0-9]{4}-[0-9]{2}-[0-9]{2}T')"
    ),
    "shape_signature": (
        "SELECT 'string(len=' || length(n_name) || ',sha8=' || substr(sha256(n_name),1,8) || ')' shape, count(*) n FROM "
        "nation GROUP BY 1"
    ),
    "shape_signature_documents": (
        "SELECT CASE WHEN text IS NULL THEN 'null' ELSE 'string(len=' || length(text) || ',sha8=' || substr(sha256(text),1,8) "
        "|| ')' END shape, count(*) n FROM documents GROUP BY 1"
    ),
    "drift_by_day": (
        "WITH b AS (SELECT avg(value) bm, stddev_pop(value) bs FROM events WHERE ts < TIMESTAMP '2024-01-16'), t AS (SELECT "
        "ts::DATE::VARCHAR AS day, count(*) n, avg(value) m FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1) SELECT "
        "day, n, round(m,4) mean, round(abs(m-bm)/greatest(bs,1e-9),4) z, CASE WHEN abs(m-bm)/greatest(bs,1e-9)>3 THEN 'FAIL' "
        "WHEN abs(m-bm)/greatest(bs,1e-9)>2 THEN 'WARN' ELSE 'PASS' END status FROM t, b"
    ),
    "violation_rate_trend": (
        f"WITH t AS (SELECT ts::DATE::VARCHAR AS day, count(*) total, count(*) FILTER (WHERE NOT coalesce(event_type IN "
        f"{_GOOD},false)) violations FROM events GROUP BY 1) SELECT day, total, violations, round(violations/total,6) rate, "
        f"CASE WHEN violations/total > 0.2*1.5 THEN 'rising' WHEN violations/total < 0.2*0.5 THEN 'falling' ELSE 'stable' END "
        f"trend FROM t"
    ),
    "circuit_breaker": (
        f"SELECT event_id, count(*) OVER w recent, count(*) OVER w >= 3 tripped FROM events WHERE event_type NOT IN {_GOOD} "
        f"WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"
    ),
    "embedding_centroid_drift": (
        "WITH e AS (SELECT label, unnest(embedding)::DOUBLE x, unnest(range(64)) p FROM embeddings), c AS (SELECT label, p, "
        "avg(x) m FROM e GROUP BY 1,2), a AS (SELECT p, avg(x) g FROM e GROUP BY 1) SELECT label, round(1 - "
        "sum(m*g)/(sqrt(sum(m*m))*sqrt(sum(g*g))+1e-12),6) drift FROM c JOIN a USING (p) GROUP BY 1"
    ),
    "byte_histogram": (
        "WITH b AS (SELECT r_regionkey, ascii(unnest(string_split(r_name,''))) AS byte FROM region), c AS (SELECT "
        "r_regionkey, byte, count(*) n FROM b GROUP BY 1,2) SELECT r_regionkey, byte, round(n/(sqrt(sum(n*n) OVER (PARTITION "
        "BY r_regionkey))+1e-9),6) share FROM c"
    ),
    "byte_histogram_documents": (
        "WITH h AS (SELECT doc_id, hex(encode(coalesce(text,''))) h FROM documents), b AS (SELECT doc_id, "
        "('0x' || substr(h,p*2+1,2))::INT AS byte FROM (SELECT doc_id, h, unnest(range(0, length(h)//2)) p FROM h)), c AS "
        "(SELECT doc_id, byte, count(*) n FROM b GROUP BY 1,2) SELECT doc_id, byte, round(n/(sqrt(sum(n*n) OVER (PARTITION BY "
        "doc_id))+1e-9),6) share FROM c"
    ),
    "blast_radius_lookup": _HITS + "SELECT check_id, subscriber_id, matched_field, reason FROM h WHERE k = 1",
    "registry_gap": _HITS + "SELECT DISTINCT check_id FROM f WHERE check_id NOT IN (SELECT check_id FROM h)",
    "lineage_bfs": (
        "WITH RECURSIVE e AS (SELECT 'region::'||n_regionkey s, 'nation::'||n_nationkey t FROM nation UNION ALL SELECT "
        "'nation::'||c_nationkey, 'customer::'||c_custkey FROM customer), r(node,hops) AS (SELECT 'region::1', 0 UNION ALL "
        "SELECT t, hops+1 FROM r JOIN e ON node=s WHERE hops < 2) SELECT node, min(hops) hops FROM r GROUP BY 1"
    ),
    "blame_rank_topk": (
        "WITH x AS (SELECT o_custkey, o_orderkey, round(greatest(0.0, least(1.0, greatest(0.0, 1.0 - greatest(0, "
        "floor(date_diff('second', o_orderdate, TIMESTAMP '1998-08-02')/86400.0))*0.1) - (o_orderkey%3)*0.2)),6)::DOUBLE "
        "score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score "
        "DESC, o_orderkey) rank FROM x) SELECT * FROM r WHERE rank <= 2"
    ),
    "blame_rank_all_orders": (
        "WITH x AS (SELECT o_custkey, o_orderkey, round(greatest(0.0, least(1.0, greatest(0.0, 1.0 - greatest(0, "
        "floor(date_diff('second', o_orderdate, TIMESTAMP '1998-08-02')/86400.0))*0.1) - (o_orderkey%3)*0.2)),6)::DOUBLE "
        "score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) rank "
        "FROM x) SELECT * FROM r WHERE rank <= 2"
    ),
    "quarantine_split": (
        "SELECT CASE WHEN trim(text)='' THEN 'empty' WHEN length(text)>200 THEN 'long' WHEN role NOT IN ('user','assistant') "
        "THEN 'role' END reason, count(*) n FROM conversations WHERE trim(text)='' OR length(text)>200 OR role NOT IN "
        "('user','assistant') GROUP BY 1"
    ),
    "json_path_projection": (
        "SELECT event_type, count(k) n, sum(k)::BIGINT total FROM (SELECT event_type, json_extract(props,'$.k')::BIGINT k "
        "FROM events) GROUP BY 1"
    ),
    "explode_outer_flatten": (
        "SELECT d.doc_id conv_id, c.turn fact_turn, c.role fact_role, length(c.text) fact_chars FROM documents d LEFT JOIN "
        "conversations c ON c.conv_id = d.doc_id"
    ),
    "uuid5_ids": (
        "WITH h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('event:' || event_id)) x FROM "
        "events) SELECT event_id, substr(x,1,8)||'-'||substr(x,9,4)||'-5'||substr(x,14,3)||'-'||substr('89ab', "
        "(('0x'||substr(x,17,1))::INT % 4)+1, 1)||substr(x,18,3)||'-'||substr(x,21,12) uid FROM h"
    ),
    "event_projection": "SELECT event_id id, json_extract(props,'$.k')::BIGINT k, len(json_keys(props))::INT AS \"keys\" FROM events",
    "type_mix": "SELECT 'NUMBER' kinds, count(json_extract(props,'$.k')) n, 'PASS' status FROM events",
    "snapshot_pair": (
        "WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderdate >= TIMESTAMP '1998-01-01' r FROM orders), c AS "
        "(SELECT o_custkey, count(*) a, count(*) FILTER (WHERE r) n FROM s GROUP BY 1), t AS (SELECT o_custkey, o_orderkey, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT nth, a FROM s JOIN c "
        "USING (o_custkey) WHERE r OR n < 2) SELECT o_custkey, o_orderkey, nth, CASE WHEN a < 2 THEN 'INSUFFICIENT_SNAPSHOTS' "
        "ELSE 'OK' END status FROM t WHERE nth <= 2"
    ),
    "rate_history": (
        f"WITH t AS (SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) FILTER (WHERE NOT "
        f"coalesce(event_type IN {_GOOD},false)) violations FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER "
        f"(PARTITION BY user_id ORDER BY hour DESC)::INT nth FROM t) SELECT * FROM r WHERE nth <= 24"
    ),
    "effective_mode": (
        "WITH r AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING "
        "AND CURRENT ROW) n FROM events) SELECT user_id, CASE WHEN max(n) >= 3 THEN 'WARN' ELSE 'ENFORCE' END AS mode, max(n) "
        "most_recent FROM r GROUP BY 1"
    ),
    "keyword_seeds": (
        "WITH n AS (SELECT 'file::' || p_type || '/' || p_partkey node FROM part), k(check_id, w) AS (VALUES "
        "('part.size.minimum','small'),('part.size.minimum','large'),('part.metal.enum','copper')), h AS (SELECT DISTINCT "
        "check_id, node FROM n JOIN k ON contains(lower(node), w)), r AS (SELECT *, row_number() OVER (PARTITION BY check_id "
        "ORDER BY node) i FROM h), o AS (SELECT DISTINCT node FROM n ORDER BY node LIMIT 8) SELECT check_id, node FROM r "
        "WHERE i <= 40 UNION ALL SELECT f, node FROM o, (VALUES ('part.size.minimum'),('part.metal.enum'),('part.other')) "
        "v(f) WHERE f NOT IN (SELECT check_id FROM h)"
    ),
    "ambiguous_columns": (
        "WITH p AS (SELECT 'id' column_name, 0.0 base, count(*) FILTER (WHERE doc_id IS NULL)/count(*) nf, count(DISTINCT "
        "doc_id) c FROM labels UNION ALL SELECT 'quality', 0, count(*) FILTER (WHERE quality IS NULL)/count(*), "
        "count(DISTINCT quality) FROM labels UNION ALL SELECT 'toxicity_version', 0, 0, 1 FROM labels UNION SELECT "
        "'metadata', 2, count(*) FILTER (WHERE toxic IS NULL OR toxic = 0)/count(*), count(DISTINCT nullif(toxic,0)) FROM "
        "labels), s AS (SELECT DISTINCT column_name, (base + CASE WHEN nf > 0.4 THEN 1 ELSE 0 END + CASE WHEN c <= 1 THEN 0.5 "
        "ELSE 0 END + CASE WHEN length(column_name) <= 2 THEN 1.5 ELSE 0 END)::DOUBLE score FROM p) SELECT * FROM s WHERE "
        "score > 0"
    ),
    "drift_all_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) FILTER (WHERE l_linestatus='O') n, round(avg({c}) FILTER (WHERE l_linestatus='O'),4) mean, round(abs(avg({c}) FILTER (WHERE l_linestatus='O')-avg({c}) FILTER (WHERE l_linestatus='F'))/greatest(stddev_pop({c}) FILTER (WHERE l_linestatus='F'),1e-9),6) z, 'PASS' status FROM lineitem" for c in _NUMBERS
    ),
    "rate_by_version": (
        "WITH t AS (SELECT o_orderpriority, count(*) total, count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN "
        "('F','O'),false)) violations FROM orders GROUP BY 1) SELECT *, round(violations/total,6) rate, CASE WHEN "
        "violations/total > 0.3*1.5 THEN 'rising' WHEN violations/total < 0.3*0.5 THEN 'falling' ELSE 'stable' END trend, "
        "CASE WHEN violations/total > 0.05 THEN 'WARN' ELSE 'PASS' END status FROM t"
    ),
    "tiered_health": _ROWS + "SELECT round(greatest(0.0, least(100.0, 100.0*count(*) FILTER (WHERE status='PASS')/count(*) - 20*count(*) FILTER (WHERE severity='CRITICAL' AND status='FAIL') - 10*count(*) FILTER (WHERE severity='HIGH' AND status='FAIL'))),2)::DOUBLE health_score, count(*) total_checks, count(*) FILTER (WHERE severity='CRITICAL' AND status='FAIL') critical_fails FROM res",
    "sampled_statistics": (
        "SELECT count(o_totalprice) n, round(avg(o_totalprice),4) mean, round(stddev_pop(o_totalprice),4) stddev FROM orders "
        "WHERE ('0x' || substr(md5(o_orderkey::VARCHAR),1,6))::INT % 100 < 5"
    ),
    "upstream_bfs": (
        "WITH c AS (SELECT c_custkey k, c_nationkey n, n_regionkey r FROM customer JOIN nation ON c_nationkey=n_nationkey "
        "WHERE c_acctbal < 0) SELECT 'customer::'||k node, 0 hops FROM c UNION SELECT 'nation::'||n, 1 FROM c UNION SELECT "
        "'region::'||r, 2 FROM c"
    ),
    "first_of_repeats": "SELECT min(doc_id) doc_id, count(*) copies FROM documents GROUP BY text",
    "next_baselines": (
        "WITH t AS (SELECT event_type, round(avg(value),4) m, round(greatest(stddev_pop(value),1e-9),4) s, count(value) n "
        "FROM events GROUP BY 1 HAVING count(value) >= 10) SELECT event_type AS column, m mean, s std, n, true fresh FROM t "
        "WHERE event_type <> 'click' UNION ALL SELECT * FROM (VALUES "
        "('click',1.0::DOUBLE,2.0::DOUBLE,10,false),('gone',3.0,4.0,11,false))"
    ),
}

_CHECKS = "SELECT check_id, column_name, check_type, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END status, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'LOW' END severity, n::BIGINT records_failing"
_UUID = "substr(x,1,8)||'-'||substr(x,9,4)||'-5'||substr(x,14,3)||'-'||substr('89ab', (('0x'||substr(x,17,1))::INT % 4)+1, 1)||substr(x,18,3)||'-'||substr(x,21,12)"


def _uuid_sql(kind: str, name: str) -> str:
    ns = uuid.uuid5(uuid.NAMESPACE_URL, f"shop/{kind}").hex
    return f"(SELECT {_UUID} FROM (SELECT sha1(unhex('{ns}') || encode({name})) x))"


ORACLES |= {
    "uuid_and_time_formats": f"""
WITH e AS (SELECT event_id, md5(event_id::VARCHAR) m FROM events),
r AS (SELECT CASE WHEN event_id % 7 = 0 THEN m ELSE regexp_replace(m, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END uid, event_id % 5 = 0 bad_at, event_id % 11 <> 0 maybe FROM e),
c AS (SELECT count(*) FILTER (WHERE NOT regexp_matches(uid, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')) u, count(*) FILTER (WHERE bad_at) a, count(*) FILTER (WHERE maybe) m FROM r),
d AS (SELECT coalesce(sum(n), 0) n FROM (SELECT count(*) n FROM r GROUP BY uid HAVING count(*) > 1)),
x AS (SELECT 'events.uid.format.uuid' check_id, 'uid' column_name, 'format' check_type, u n, 'invalid_uuid_count=' || u v, 'all valid uuid shape' ok FROM c
 UNION ALL SELECT 'events.maybe.format.uuid', 'maybe', 'format', m, 'invalid_uuid_count=' || m, 'all valid uuid shape' FROM c
 UNION ALL SELECT 'events.at.format.date-time', 'at', 'format', a, 'unparseable_count=' || a, 'all parseable' FROM c
 UNION ALL SELECT 'events.uid.unique', 'uid', 'unique', n, '?', 'duplicate_count=0' FROM d)
{_CHECKS}, CASE WHEN n > 0 THEN v ELSE ok END actual_value FROM x""",
    "nested_fields": f"""
WITH r AS (SELECT nullif(role, 'user') role, CASE WHEN turn % 2 = 0 THEN 'u' WHEN turn % 5 = 0 THEN 'none' END uid FROM conversations),
c AS (SELECT count(*) all_, count(*) FILTER (WHERE role IS NULL) a, count(*) FILTER (WHERE uid = 'none') b FROM r),
x AS (SELECT 'talk.meta.role.required' check_id, 'meta.role' column_name, 'not_null' check_type, a n, 'missing=' || a v, 'missing=0' ok FROM c
 UNION ALL SELECT 'talk.meta.absent.required', 'meta.absent', 'not_null', all_, 'missing=' || all_, '' FROM c
 UNION ALL SELECT 'talk.meta.uid.format', 'meta.uid', 'format', b, 'invalid=' || b, 'valid' FROM c)
{_CHECKS}, CASE WHEN n > 0 THEN v ELSE ok END actual_value FROM x""",
    "array_items": f"""
WITH x AS (SELECT 'talk.turns.share.range' check_id, 'turns[*].share' column_name, 'range' check_type, count(*) FILTER (WHERE length(text)/100 < 0.2 OR length(text)/100 > 1.5) n FROM conversations)
{_CHECKS} FROM x UNION ALL SELECT 'talk.turns.none.range', 'turns[*].none', 'range', 'WARN', 'WARNING', 0""",
    "type_clauses": f"""
WITH c AS (SELECT count(value) v, count(*) FILTER (WHERE value <> round(value)) f, count(event_type) t FROM events),
x AS (SELECT 'event_id' f, 0 n, 'int64' said FROM c UNION ALL SELECT 'value', CASE WHEN f > 0 THEN v ELSE 0 END, CASE WHEN f > 0 THEN 'dtype=float64' ELSE 'float64' END FROM c UNION ALL SELECT 'whole', 0, 'float64' FROM c
 UNION ALL SELECT 'user_id', 0, 'int64' FROM c UNION ALL SELECT 'event_type', t, 'dtype=object' FROM c),
y AS (SELECT 'events.' || f || '.type_match' check_id, f column_name, 'type' check_type, n, said FROM x)
{_CHECKS}, said actual_value FROM y UNION ALL SELECT 'events.ghost.type_match', 'ghost', 'type', 'ERROR', 'WARNING', 0, 'column_absent'""",
    "rules_across_fields": f"""
WITH l AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) p, CASE WHEN l_orderkey % 3 > 0 THEN l_extendedprice * (1 - l_discount) END net FROM lineitem),
c AS (SELECT count(*) FILTER (WHERE l_linenumber <> p + 1) s, count(*) FILTER (WHERE NOT net <= l_extendedprice - 1) a, least(count(*) FILTER (WHERE NOT l_partkey > l_suppkey), 1) t,
 count(*) FILTER (WHERE l_tax > 0.08) hi, count(*) FILTER (WHERE l_tax < 1e-6) lo FROM l),
x AS (SELECT 'lines.lines' check_id, 'l_linenumber' column_name, 'sequence' check_type, s n FROM c UNION ALL SELECT 'lines.net', '*', 'arithmetic', a FROM c UNION ALL SELECT 'lines.part', '*', 'temporal', t FROM c
 UNION ALL SELECT 'lines.quality.l_tax.max', 'l_tax', 'range', hi FROM c UNION ALL SELECT 'lines.quality.l_tax.min', 'l_tax', 'range', lo FROM c)
{_CHECKS} FROM x UNION ALL SELECT * FROM (VALUES ('lines.odd', '*', 'custom', 'ERROR', 'WARNING', 0), ('lines.gone', 'nowhere', 'sequence', 'ERROR', 'WARNING', 0), ('lines.quality.unparsed', '*', 'custom', 'ERROR', 'WARNING', 0))""",
    "validation_samples": """
WITH o AS (SELECT row_number() OVER () rn, * FROM orders),
f AS (SELECT 'orders.o_orderstatus.enum' check_id, rn, o_orderstatus s FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'orders.o_orderpriority.pattern', rn, o_orderpriority FROM o WHERE NOT regexp_matches(o_orderpriority, '^[1-4]')
 UNION ALL SELECT 'orders.o_totalprice.maximum', rn, 'row' FROM o WHERE o_totalprice > 200000),
k AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY rn) i FROM f)
SELECT c check_id, coalesce(string_agg(s, ',' ORDER BY i) FILTER (WHERE i <= 5), '') samples, count(s) records_failing FROM (VALUES ('orders.o_orderstatus.enum'), ('orders.o_orderpriority.pattern'), ('orders.o_totalprice.maximum')) v(c) LEFT JOIN k ON c = check_id GROUP BY 1""",
    "attribution_per_check": """
WITH RECURSIVE e AS (SELECT 'region::'||n_regionkey s, 'nation::'||n_nationkey t FROM nation UNION ALL SELECT 'nation::'||c_nationkey, 'customer::'||c_custkey FROM customer),
seed(c, node) AS (VALUES ('geo.region.required', 'region::1'), ('geo.nation.unique', 'nation::3'), ('geo.nation.unique', 'nation::7')),
down(c, node, h) AS (SELECT c, node, 0 FROM seed UNION ALL SELECT c, t, h+1 FROM down JOIN e ON node = s WHERE h < 2),
dm AS (SELECT c, node, min(h) h FROM down GROUP BY 1, 2),
up(c, node, h) AS (SELECT c, node, 0 FROM seed UNION ALL SELECT c, s, h+1 FROM up JOIN e ON node = t WHERE h < 2),
um AS (SELECT c, node, min(h) h FROM up GROUP BY 1, 2),
b AS (SELECT c, node || '.sql' p, round(greatest(0.0, 1 - (length(node) % 5) * 0.1 - h * 0.2), 6)::DOUBLE sc FROM um WHERE node NOT LIKE 'customer%'),
br AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY sc DESC, p) k FROM b),
dr AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY node) k FROM dm WHERE h = 1)
SELECT c check_id, (SELECT max(h) FROM dm WHERE dm.c = v.c)::INT contamination_depth, (SELECT string_agg(node, ',' ORDER BY k) FROM dr WHERE dr.c = v.c AND k <= 40) direct,
 least((SELECT count(*) FROM dm WHERE dm.c = v.c AND h > 0), 40)::INT reached, (SELECT string_agg(p || '@' || sc, ',' ORDER BY k) FROM br WHERE br.c = v.c AND k <= 5) blame,
 CASE WHEN c = 'geo.nation.unique' THEN 'maps' END subscribers FROM (SELECT DISTINCT c FROM seed) v""",
    "drift_results": """
WITH l AS (SELECT l_returnflag f, l_quantity::DOUBLE q, l_tax::DOUBLE t, year(l_shipdate)::DOUBLE y FROM lineitem),
u AS (UNPIVOT l ON q, t, y INTO NAME k VALUE v), g AS (SELECT k, avg(v) FILTER (WHERE f = 'N') m, count(v) FILTER (WHERE f = 'N') n, avg(v) FILTER (WHERE f = 'R') bm, stddev_pop(v) FILTER (WHERE f = 'R') bs FROM u GROUP BY 1),
z AS (SELECT CASE k WHEN 'q' THEN 'l_quantity' WHEN 't' THEN 'l_tax' ELSE 'late' END c, n, abs(m - bm) / greatest(bs, 1e-9) z FROM g)
SELECT 'lines.' || c || '.drift.mean' check_id, c column_name, 'drift' check_type, CASE WHEN z > 3 THEN 'FAIL' WHEN z > 2 THEN 'WARN' ELSE 'PASS' END status,
 CASE WHEN z > 3 THEN 'HIGH' WHEN z > 2 THEN 'MEDIUM' ELSE 'LOW' END severity, (CASE WHEN z > 2 THEN n ELSE 0 END)::BIGINT records_failing FROM z""",
    "prompt_quarantine": """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 9 END k, CASE WHEN doc_id % 7 > 0 THEN source END p, text FROM documents),
x AS (SELECT CASE WHEN k < 8 THEN 'doc_id is too short' WHEN p IS NULL THEN 'source_path is missing' WHEN length(p) < 1 THEN 'source_path is too short' WHEN text IS NULL THEN 'content_preview is missing'
 WHEN length(text) > 8000 THEN 'content_preview is too long' WHEN doc_id % 11 = 0 THEN 'unknown key note' ELSE 'valid' END error FROM r)
SELECT error, count(*) n FROM x GROUP BY 1""",
    "event_migration": f"""
WITH r AS (SELECT event_id line, 'agent-' || user_id stream, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') tm FROM events),
q AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY tm, line) n FROM r)
SELECT {_uuid_sql("event_id", "line || '|' || tm || '|' || stream || '|' || event_type")} event_id, {_uuid_sql("aggregate_id", "'stream:' || stream")} aggregate_id, 'AgentSession' aggregate_type, n sequence_number, tm occurred_at, 1.5::DOUBLE fee FROM q WHERE line % 13 <> 0""",
    "extraction_migration": f"""
WITH r AS (SELECT 'd' || doc_id id, source, (doc_id % 4) / 4.0::DOUBLE c FROM documents WHERE doc_id % 10 <> 0)
SELECT {_uuid_sql("doc_id", "id")} doc_id, source source_path, {_uuid_sql("fact_id", "id || '|2024-01-01T00:00:00Z|' || c")} fact_id, c confidence, 0 entities FROM r""",
    "lineage_snapshot": """
WITH c AS (SELECT count(*) FILTER (WHERE NOT coalesce(n_regionkey < 2, false)) + count(*) FILTER (WHERE n_nationkey = 4) n, bool_or(n_nationkey = 0 AND n_regionkey < 2) root FROM nation)
SELECT 'graph.edges.endpoints' check_id, 'edges[*].source,target' column_name, 'referential' check_type, 'FAIL' status, 'CRITICAL' severity, n::BIGINT records_failing FROM c WHERE root
UNION ALL SELECT * FROM (VALUES ('graph.snapshot_id.required', 'snapshot_id', 'not_null', 'PASS', 'LOW', 0), ('graph.git_commit.format', 'git_commit', 'pattern', 'PASS', 'LOW', 0))""",
    "quarantine_gate": _ROWS + """
, s AS (SELECT *, check_type IN ('not_null','format','pattern','enum','accepted_values','range','temporal','arithmetic','custom') AND records_failing > 0 of_rows, severity IN ('CRITICAL','HIGH') severe FROM res)
SELECT CASE WHEN bool_or(severe AND NOT of_rows) THEN 'BLOCK' WHEN bool_or(severe) THEN 'QUARANTINE' ELSE 'PASS' END pipeline_action, 'QUARANTINE' AS mode FROM s
UNION ALL SELECT CASE WHEN bool_or(severe AND NOT of_rows) THEN 'BLOCK' WHEN bool_or(severe) THEN 'QUARANTINE' ELSE 'PASS' END, 'QUARANTINE' FROM s WHERE check_type IN ('not_null','format','pattern','enum','accepted_values','range','temporal','arithmetic','custom')
UNION ALL SELECT 'PASS', 'QUARANTINE'""",
}


def merged_baselines(s, d):
    """Moments of each day, joined to those of all days."""
    days = moments.moments(_t(s, d, "events").withColumn("day", F.to_date("ts")), {"value": "value"}, ["event_type", "day"])
    return moments.baselines(days.drop("column").withColumnRenamed("event_type", "column"), 10).select(
        "column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")]
    )


def incremental_profile(s, d):
    """A profile of events from the sketches of its days; its quantiles and cardinalities against exact ones."""
    e = _t(s, d, "events").withColumn("day", F.to_date("ts"))
    columns = ["event_id", "user_id", "event_type", "value", "props"]
    found = sketches.profile(sketches.sketch(e, columns, ["day"]).drop("day")).persist()
    asked = found.collect()  # a row for each column
    exact = []
    for r in asked:
        c = F.col(r.column_name)
        near = F.lit(True)
        for q in (0.25, 0.5, 0.75, 0.95, 0.99):
            if r[f"p{int(q * 100)}"] is not None:
                v = F.lit(r[f"p{int(q * 100)}"])
                off = F.lit(sketches.RANK) * F.count(c)
                near = near & (F.count_if(c < v) <= F.lit(q) * F.count(c) + off) & (F.count_if(c <= v) >= F.lit(q) * F.count(c) - off)
        many = F.abs(F.count_distinct(c) - r.cardinality) <= 4 * sketches.CARDINALITY * F.count_distinct(c)
        exact.append(F.struct(F.lit(r.column_name).alias("column_name"), near.alias("ranks_near"), many.alias("distinct_near")))
    checked = e.agg(F.array(*exact).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return found.join(checked, "column_name").select(
        "column_name", "rows", "nulls", "n", "min", "max", F.round("mean", 3).alias("mean"), F.round("stddev", 3).alias("stddev"), "ranks_near", "distinct_near"
    )


_ADDRESSES = [("url", "ther"), ("url", "ample.org"), ("url", "ab"), ("page", "=1"), ("never", "http"), ("url", "nowhere"), ("page", "#TOP")]


def keyword_seeds_within_words(s, d):
    """Addresses that hold a keyword anywhere, within longer words too; a check that no topic touches gets stand-ins."""
    nodes = _t(s, d, "pages").select(F.concat(F.lit("file::"), "url", F.lit("/"), "page_id").alias("node_id"))
    fails = s.createDataFrame([("pages.url.pattern", "Url"), ("pages.page.unique", "page_id"), ("pages.other", "html")], "check_id string, column_name string")
    return lineage.keyword_seeds(fails, nodes, s.createDataFrame(_ADDRESSES, "trigger string, keyword string"), 200_000)


def breaking_prefixes(s, d):
    """Fields of parts against fields that consumers name, whole or as prefixes of either: hits by brand and consumer."""
    path = F.concat_ws(".", F.lower("p_brand"), F.lower("p_type"), F.split("p_name", " ")[0], F.concat(F.lit("s"), F.col("p_size").cast("string")))
    p = _t(s, d, "part").withColumn("path", path)
    fails = p.select(F.col("p_brand").alias("contract_id"), F.col("p_partkey").cast("string").alias("check_id"), F.col("path").alias("column_name"))
    cut_at = lambda n: F.array_join(F.slice(F.split("path", r"\."), 1, n), ".")
    # texts' extremes are found by sorting: distinct ones and counts first, which are hashed
    named = p.select("p_brand", "p_size", "path").distinct().groupBy(F.col("p_brand").alias("contract_id"), F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("subscriber_id")).agg(
        F.min(F.concat("path", F.lit(".deep"))).alias("below"), F.max("path").alias("same"), F.max(cut_at(3)).alias("above")
    )
    fields = F.array(*[F.struct(F.col(c).alias("field"), F.lit(c).alias("reason")) for c in ("below", "same", "above")])
    hits = registry.blast_radius(fails, named.select("contract_id", "subscriber_id", fields.alias("breaking_fields")))
    counted = hits.groupBy("contract_id", "subscriber_id", "reason", "matched_field").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("contract_id", "subscriber_id", "reason").agg(F.sum("n").alias("hits"), F.min("matched_field").alias("field"))


def typed_enums(s, d):
    """Enums of whole numbers, of fractions and of booleans."""
    l = _t(s, d, "lineitem").withColumn("cheap", F.col("l_extendedprice") < 30000).withColumn("never", F.lit(False))
    enums = {"l_linenumber": [1, 2, 3], "l_discount": [0, 0.05, 0.1], "l_quantity": ["1", 2.0, 50], "cheap": [True], "never": [True, "false"]}
    return _check(l, "lines", {k: {"enum": v} for k, v in enums.items()}, lines=()).select(_SHORT)


def rules_that_fail_in_rows(s, d):
    """Rules that can't be computed in some rows don't apply to these; a clause that can't be is alone."""
    e = _t(s, d, "events").withColumn("left", F.col("user_id") % 3).withColumn("code", F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("string")).otherwise("none"))
    rules = [
        {"kind": "expression", "name": "share", "holds": "6 / left > 3"}, {"kind": "expression", "name": "code", "holds": "cast(code as int) % 5 <> 0"},
        {"kind": "expression", "name": "gone", "holds": "nowhere > 1"}
    ]
    return _check(e, "events", {"value": {"required": True}}, rules).select(_SHORT)


def column_profile(s, d):
    """Orders, columns with whole numbers and texts: least values, and numbers with the sample deviation."""
    r = profile.column_profile(_t(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return r.select(
        "column_name", "null_fraction", F.array_join("samples", "|").alias("samples"), "n", "min", "max", F.round("mean", 3).alias("mean"), F.round("stddev", 3).alias("stddev")
    )


def suggested_clauses(s, d):
    """Clauses that the events suggest, as rows."""
    found = profile.suggest_clauses(_t(s, d, "events").withColumn("seen_at", F.col("ts").cast("string")).withColumn("kind_id", F.col("event_type")))
    rows = [(k, c["type"], c["required"], c.get("format"), "|".join(c["enum"]) if "enum" in c else None) for k, c in found.items()]
    return s.createDataFrame(rows, "column_name string, type string, required boolean, format string, enum string")


def graph_tables(s, d):
    """Lines of orders as edges from orders to parts: orders of one status and large parts are no nodes, one relationship is unknown."""
    kinds = F.array(*[F.lit(k) for k in ("READS", "WRITES", "CALLS", "IMPORTS", "PRODUCES", "CONSUMES", "ODD")])
    edges = _t(s, d, "lineitem").select(
        F.concat(F.lit("order::"), "l_orderkey").alias("source"), F.concat(F.lit("part::"), "l_partkey").alias("target"), F.get(kinds, F.col("l_linenumber") - 1).alias("relationship")
    )
    orders = _t(s, d, "orders").where("o_orderstatus <> 'P'").select(F.concat(F.lit("order::"), "o_orderkey").alias("node_id"))
    return drivers.graph_results(edges, orders.unionByName(_t(s, d, "part").where("p_size < 40").select(F.concat(F.lit("part::"), "p_partkey").alias("node_id"))), "graph").select(
        *_SHORT, F.array_join("sample_failing", "|").alias("samples")
    )


def migration_blast_radius(s, d):
    """Breaking changes of customers' clauses, and what lies below: their nation, its region, and pipelines of suppliers in debt there."""
    edge = lambda t, a, b, kind: t.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("relationship"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}::"), c)
    c, n, sup = _t(s, d, "customer"), _t(s, d, "nation"), _t(s, d, "supplier").where("s_acctbal < 0")
    edges = edge(c, name("customer", "c_custkey"), name("nation", "c_nationkey"), "PRODUCES").unionByName(
        edge(n, name("nation", "n_nationkey"), name("region", "n_regionkey"), "WRITES")
    ).unionByName(edge(sup, name("nation", "s_nationkey"), name("pipeline", "s_suppkey"), "CONSUMES"))
    touched = c.where("c_acctbal > 1000").select(F.concat(F.lit("customer."), "c_custkey").alias("path"), name("customer", "c_custkey").alias("node"))
    return report.lineage_impact(schema_diff_classify(s, d), touched, edges, 3)


_MORE = (merged_baselines, incremental_profile, keyword_seeds_within_words, breaking_prefixes, typed_enums, rules_that_fail_in_rows, column_profile, suggested_clauses, graph_tables, migration_blast_radius)
QUERIES |= {f.__name__: f for f in _MORE}

_RULE = "SELECT '{}' check_id, '{}' column_name, '{}' check_type, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END status, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'LOW' END severity, n::BIGINT records_failing FROM (SELECT count(*) FILTER (WHERE {}) n FROM {})"
_EXACT = "SELECT '{c}' column_name, count(*) \"rows\", count(*) FILTER (WHERE {c} IS NULL) nulls, count({v}) n, min({v})::DOUBLE \"min\", max({v})::DOUBLE \"max\", round(avg({v}),3) mean, round(stddev_pop({v}),3) stddev, true ranks_near, true distinct_near FROM events"
ORACLES |= {
    "merged_baselines": (
        "SELECT event_type AS column, count(value) n, round(avg(value),4) mean, round(stddev_pop(value),4) std, round(min(value),4) \"min\", "
        "round(max(value),4) \"max\" FROM events GROUP BY 1 HAVING count(value) >= 10"
    ),
    "incremental_profile": " UNION ALL ".join(
        _EXACT.format(c=c, v=c if c in ("event_id", "user_id", "value") else "NULL::DOUBLE") for c in ("event_id", "user_id", "event_type", "value", "props")
    ),
    "keyword_seeds_within_words": (
        "WITH n AS (SELECT 'file::' || url || '/' || page_id node FROM pages), k(check_id, w) AS (VALUES ('pages.url.pattern','ther'),"
        "('pages.url.pattern','ample.org'),('pages.url.pattern','ab'),('pages.url.pattern','nowhere'),('pages.page.unique','=1'),('pages.page.unique','#top'),('pages.url.pattern','=1'),('pages.url.pattern','#top'),('pages.other','=1'),('pages.other','#top')), "
        "h AS (SELECT DISTINCT check_id, node FROM n JOIN k ON contains(lower(node), w)), o AS (SELECT DISTINCT node FROM n ORDER BY node LIMIT 8) "
        "SELECT check_id, node FROM h UNION ALL SELECT f, node FROM o, (VALUES ('pages.url.pattern'),('pages.page.unique'),('pages.other')) v(f) WHERE f NOT IN (SELECT check_id FROM h)"
    ),
    "breaking_prefixes": (
        "WITH p AS (SELECT *, lower(p_brand)||'.'||lower(p_type)||'.'||split_part(p_name,' ',1)||'.s'||p_size path FROM part), "
        "r AS (SELECT p_brand, 'c'||p_size subscriber_id, min(path||'.deep') below, max(path) same, max(array_to_string(string_split(path,'.')[1:3],'.')) above FROM p GROUP BY ALL), "
        "x AS (SELECT p_brand, subscriber_id, 0 nth, below bf, 'below' reason FROM r UNION ALL SELECT p_brand, subscriber_id, 1, same, 'same' FROM r UNION ALL SELECT p_brand, subscriber_id, 2, above, 'above' FROM r), "
        "h AS (SELECT x.p_brand contract_id, p_partkey, subscriber_id, arg_min((bf, reason), nth) m FROM p JOIN x ON p.p_brand = x.p_brand AND (path = bf OR starts_with(bf, path||'.') OR starts_with(path, bf||'.')) GROUP BY ALL) "
        "SELECT contract_id, subscriber_id, m[2] reason, count(*) hits, min(m[1]) field FROM h GROUP BY ALL"
    ),
    "typed_enums": " UNION ALL ".join(
        _RULE.format(f"lines.{c}.enum", c, "enum", bad, "lineitem") for c, bad in (
            ("l_linenumber", "l_linenumber NOT IN (1,2,3)"), ("l_discount", "l_discount NOT IN (0,0.05::DOUBLE,0.1::DOUBLE)"), ("l_quantity", "l_quantity NOT IN (1,2,50)"),
            ("cheap", "NOT l_extendedprice < 30000"), ("never", "false")
        )
    ),
    "rules_that_fail_in_rows": " UNION ALL ".join([
        _RULE.format("events.value.required", "value", "not_null", "value IS NULL", "events"), _RULE.format("events.share", "*", "custom", "user_id % 3 > 0 AND NOT 6 / (user_id % 3) > 3", "events"),
        _RULE.format("events.code", "*", "custom", "event_id % 4 > 0 AND event_id % 5 = 0", "events"), "SELECT 'events.gone', '*', 'custom', 'ERROR', 'WARNING', 0",
        "SELECT 'events.quality.row_count', '*', 'volume', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(*) > 0 THEN 'LOW' ELSE 'CRITICAL' END, CASE WHEN count(*) > 0 THEN 0 ELSE 1 END FROM events"
    ])
}

_CHANGES = """
WITH v AS (SELECT o_orderkey % 2 side, 'customer.' || o_custkey path, CASE WHEN max(o_totalprice) > 400000 THEN 'number' ELSE 'integer' END t, count(*) > 5 req, floor(min(o_totalprice) / 200000) mn, floor(max(o_totalprice) / 200000) mx, list(DISTINCT o_orderstatus) en FROM orders GROUP BY ALL),
o AS (SELECT * FROM v WHERE side = 0), n AS (SELECT * FROM v WHERE side = 1),
x AS (SELECT coalesce(o.path, n.path) path, CASE WHEN o.path IS NULL AND n.req THEN 'add_required_field' WHEN o.path IS NULL THEN 'add_nullable_field' WHEN n.path IS NULL THEN 'remove_field' WHEN o.t <> n.t THEN 'type_change' WHEN o.mx <> n.mx THEN 'range_maximum_change' WHEN o.mn <> n.mn THEN 'range_minimum_change'
 WHEN NOT list_has_all(n.en, o.en) THEN 'enum_value_removed' WHEN NOT list_has_all(o.en, n.en) THEN 'enum_value_added' ELSE 'no_material_change' END taxonomy FROM o FULL JOIN n ON o.path = n.path),
c AS (SELECT path, CASE WHEN taxonomy IN ('add_nullable_field', 'enum_value_added', 'no_material_change') THEN 'COMPATIBLE' ELSE 'BREAKING' END verdict, taxonomy FROM x),
b AS (SELECT * FROM c WHERE verdict = 'BREAKING')
"""
ORACLES |= {
    "schema_diff_classify": _CHANGES + "SELECT * FROM c", "change_counts": _CHANGES + "SELECT verdict, taxonomy, count(*) n FROM c GROUP BY ALL",
    "migration_impact": _CHANGES + "SELECT path, CASE WHEN c_custkey IS NULL THEN 'no registered consumer' ELSE '1 consumers read ' || path END failure_mode FROM b LEFT JOIN customer ON path = 'customer.' || c_custkey AND c_acctbal < 0",
    "migration_checklist": _CHANGES + """SELECT path, 0 nth, '[REQUIRED] Tell subscribers (' || path || ', ' || taxonomy || '): billing' item FROM b UNION ALL SELECT path, 1, '[REQUIRED] Write and test the migration before deploying' FROM b
UNION ALL SELECT path, 2, '[REQUIRED] Validate again after the migration' FROM b UNION ALL SELECT NULL, k, i FROM (VALUES (0, '[OK] No breaking change between these versions'), (1, '[RECOMMENDED] Check models and consumers if enums or types were widened')) w(k, i) WHERE NOT EXISTS (SELECT 1 FROM b)"""
}

_COLUMN = "SELECT '{c}' column_name, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) null_fraction, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR v FROM orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) samples, {n} FROM orders"
_NUMBER_STATS = "count({c}) n, min({c})::DOUBLE \"min\", max({c})::DOUBLE \"max\", round(avg({c}),3) mean, round(stddev_samp({c}),3) stddev"
_SUGGESTED = "SELECT '{c}' column_name, '{t}' AS type, count(*) = count({v}) required, {f} format, CASE WHEN '{t}' = 'string' AND count(DISTINCT {v}) BETWEEN 1 AND 10 THEN (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {v}::VARCHAR v FROM events WHERE {v} IS NOT NULL)) END AS enum FROM events"
_GRAPH = "SELECT 'graph.{i}' check_id, '{c}' column_name, '{k}' check_type, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END status, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'LOW' END severity, n::BIGINT records_failing, {s} samples FROM f"
ORACLES |= {
    "column_profile": " UNION ALL ".join(
        _COLUMN.format(c=c, n=_NUMBER_STATS.format(c=c) if c.endswith("key") else "NULL::BIGINT n, NULL::DOUBLE \"min\", NULL::DOUBLE \"max\", NULL::DOUBLE mean, NULL::DOUBLE stddev")
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ),
    "suggested_clauses": " UNION ALL ".join(
        _SUGGESTED.format(c=c, v=v, t=t, f=f) for c, v, t, f in (
            ("event_id", "event_id", "integer", "NULL"), ("ts", "ts", "string", "NULL"), ("user_id", "user_id", "integer", "NULL"), ("event_type", "event_type", "string", "NULL"),
            ("value", "value", "number", "NULL"), ("props", "props", "string", "NULL"), ("seen_at", "ts", "string", "'date-time'"), ("kind_id", "event_type", "string", "'uuid'")
        )
    ),
    "graph_tables": """
WITH e AS (SELECT 'order::' || l_orderkey || '->part::' || l_partkey shown, l_linenumber = 7 odd, l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') a, l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) b FROM lineitem),
g AS (SELECT count(*) FILTER (WHERE a) a, count(*) FILTER (WHERE b) b, count(*) FILTER (WHERE odd) odd, count(*) FILTER (WHERE a OR b) ab FROM e)
""" + " UNION ALL ".join(
        "SELECT * FROM (WITH f AS (SELECT {} n FROM g) {})".format(n, _GRAPH.format(i=i, c=c, k=k, s=s)) for n, i, c, k, s in (
            ("a", "edges.source.reference", "source", "referential", "''"), ("b", "edges.target.reference", "target", "referential", "''"),
            ("odd", "edges.relationship.enum", "relationship", "enum", "''"),
            ("ab + odd", "edges.endpoints", "edges[*].source,target", "referential", "(SELECT string_agg(shown, '|' ORDER BY shown) FROM (SELECT shown FROM e WHERE a OR b ORDER BY shown LIMIT 5))")
        )
    ),
    "migration_blast_radius": _CHANGES + """
, k AS (SELECT s_nationkey, count(DISTINCT s_suppkey) pipes FROM supplier WHERE s_acctbal < 0 GROUP BY 1)
SELECT path, taxonomy, CASE WHEN c_custkey IS NULL THEN 0 ELSE 2 + coalesce(pipes, 0) END::BIGINT n_nodes, CASE WHEN c_custkey IS NULL THEN 0 ELSE coalesce(pipes, 0) END::BIGINT n_pipelines, CASE WHEN c_custkey IS NULL THEN 0 ELSE 2 END::INT hops
FROM b LEFT JOIN customer ON path = 'customer.' || c_custkey AND c_acctbal > 1000 LEFT JOIN k ON s_nationkey = c_nationkey"""
}
