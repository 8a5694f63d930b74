"""The registry of consumers: who is hit by a failing field, who isn't registered, what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_token, parse_time
from ..model import ISO_DATE_TIME

REQUIRED = (
    "contract_id", "subscriber_id", "subscriber_team", "fields_consumed", "breaking_fields", "validation_mode",
    "registered_at", "contact"
)
MODES = ("AUDIT", "WARN", "ENFORCE")


def prefix_match(a: Column, b: Column) -> Column:
    """Equal, or one is a dotted prefix of the other."""
    return (a == b) | F.startswith(b, F.concat(a, F.lit("."))) | F.startswith(a, F.concat(b, F.lit(".")))


def prefixes(field: Column, whole: bool = True) -> Column:
    """The dotted prefixes of a field, ``a.b.c`` -> a, a.b, a.b.c; without ``whole`` only the proper ones."""
    parts = F.split(field, r"\.")
    n = F.size(parts) if whole else F.size(parts) - 1
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def blast_radius(failures: DataFrame, registry: DataFrame) -> DataFrame:
    """failures (contract_id, check_id, column_name) x subscribers whose breaking fields match: the first match of each.

    Fields may be comma-separated; ``*`` hits every subscriber of the contract; an empty field hits none. Fields match
    if they are equal or one is a dotted prefix of the other: each side meets the other's prefixes by equality, so no
    field is compared with all of its contract's. A field that many failures name is matched once, and its matches go
    to each of them afterwards.
    """
    f = failures.select("contract_id", "column_name").where("column_name is not null").distinct()
    f = f.select("contract_id", "column_name", F.explode(F.split("column_name", ",")).alias("raw"))
    f = f.withColumn("failing", field_token(F.col("raw"))).where("failing <> ''").drop("raw").distinct()
    r = registry.select("contract_id", "subscriber_id", F.posexplode("breaking_fields").alias("nth", "bf")).select(
        "contract_id", "subscriber_id", "nth", field_token(F.col("bf.field")).alias("breaking"),
        F.col("bf.reason").alias("reason")
    )
    said = ["contract_id", "column_name", "subscriber_id", "nth", "breaking", "reason"]
    named = f.where("failing <> '*'")
    on = ["contract_id", "field"]
    up = named.withColumnRenamed("failing", "field").join(r.withColumn("field", F.explode(prefixes(F.col("breaking")))), on)
    down = named.withColumn("field", F.explode(prefixes(F.col("failing"), False))).join(r.withColumn("field", F.col("breaking")), on)
    every = f.where("failing = '*'").select("contract_id", "column_name").join(r, "contract_id")
    j = up.select(said).unionByName(down.select(said)).unionByName(every.select(said))
    first = j.groupBy("contract_id", "column_name", "subscriber_id").agg(F.min_by(F.struct("breaking", "reason"), "nth").alias("m"))
    return failures.select("contract_id", "check_id", "column_name").distinct().join(first, ["column_name", "contract_id"]).select(
        "contract_id", "check_id", "column_name", "subscriber_id", F.col("m.breaking").alias("matched_field"),
        F.col("m.reason").alias("reason")
    )


def gaps(failures: DataFrame, hits: DataFrame) -> DataFrame:
    return failures.join(hits, ["contract_id", "check_id"], "left_anti")


def stale(registry: DataFrame, now: Column, days: int = 30) -> DataFrame:
    old = F.col("mode_upgraded_at").isNull() | (parse_time(F.col("mode_upgraded_at")) < now - F.make_dt_interval(F.lit(days)))
    return registry.where((F.col("validation_mode") == "AUDIT") & old)


def lint(registry: DataFrame) -> DataFrame:
    """(contract_id, subscriber_id, problem) for every broken rule of the registry."""
    bad = []
    for k in REQUIRED:
        if k not in registry.columns:
            bad.append(F.lit(f"missing key {k}"))
        elif dict(registry.dtypes)[k].startswith("array"):
            bad.append(F.when(F.coalesce(F.size(k), F.lit(0)) <= 0, f"empty {k}"))
        else:
            bad.append(F.when(F.coalesce(F.trim(k), F.lit("")) == "", f"missing {k}"))
    if "validation_mode" in registry.columns:
        bad.append(F.when(~F.col("validation_mode").isin(*MODES), "unknown validation_mode"))
    if "registered_at" in registry.columns:
        bad.append(F.when(~F.col("registered_at").rlike(ISO_DATE_TIME), "registered_at is no ISO time"))
    n = F.count(F.lit(1)).over(Window.partitionBy("contract_id", "subscriber_id"))
    r = registry.withColumn("__n", n)
    bad.append(F.when(F.col("__n") > 1, "repeated subscription"))
    return r.select("contract_id", "subscriber_id", F.explode(F.array_compact(F.array(*bad))).alias("problem")).distinct()


def subscribers(registry: DataFrame) -> DataFrame:
    return registry.groupBy("contract_id").agg(F.array_join(F.array_sort(F.collect_set("subscriber_id")), ", ").alias("subscribers"))
