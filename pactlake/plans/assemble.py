"""Contracts from data: clauses from a profile, quality lines, consumers; and ready-made rules for AI records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile

#: Columns that hold anything; fixed names.
OPEN_COLUMNS = ("payload", "metadata", "outputs", "inputs")


def ambiguous_columns(profiles: DataFrame, limit: int = 12) -> DataFrame:
    """Columns whose meaning a profile doesn't show, with a score: sparse, constant, open or tersely named."""
    name, points = F.col("column_name"), lambda cond, p: F.when(cond, p).otherwise(0.0)
    open_ = name.isin(*OPEN_COLUMNS) | F.startswith(name, F.lit("_migration"))
    score = points(
        F.col("null_fraction") > 0.4, 1.0
    ) + points(F.col("cardinality") <= 1, 0.5) + points(open_, 2.0) + points(F.char_length(name) <= 2, 1.5)
    return profiles.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "column_name").limit(limit)


def hints(profiles: DataFrame) -> DataFrame:
    """Words on what a column may be, from its name and profile alone: no value leaves the data."""
    name = F.col("column_name")
    words = F.array(
        F.when(F.endswith(name, F.lit("_id")), "identifier"),
        F.when(F.contains(F.lower(name), F.lit("confidence")), "probability"),
        F.when(F.col("null_fraction") > 0.5, "sparse")
    )
    return profiles.withColumn("hints", F.array_compact(words))


def contract(
    df: DataFrame, contract_id: str, title: str, owner: str = "", subscribers: list[str] | None = None,
    ranges: list[str] | None = None
) -> dict[str, Any]:
    """A contract for a table: suggested clauses, row count and completeness lines, bounds seen of ``ranges``."""
    schema = profile.suggest_clauses(df)
    lines = ["row_count >= 1"] + [f"missing_count({c}) = 0" for c, s in schema.items() if s["required"]]
    if ranges:
        lines += [
            x for r in profile.numeric_profile(df, ranges).collect() if r.n for x in (
                f"min({r.column_name}) >= {r.min}", f"max({r.column_name}) <= {r.max}"
            )
        ]
    return {
        "kind": "DataContract", "apiVersion": "v3.0.0", "id": contract_id, "info": {
            "title": title, "version": "1.0.0", "owner": owner
        }, "schema": schema, "quality": {"checks": lines},
        "lineage": {"downstream": [{"id": s} for s in subscribers or []]},
    }


def placeholder(contract_id: str, why: str) -> dict[str, Any]:
    return {
        "kind": "DataContract", "id": contract_id, "placeholder": True, "info": {"description": why}, "schema": {},
        "quality": {"checks": []}
    }


def _holds(name: str, column: str, holds: str, **more: Any) -> dict[str, Any]:
    return {"kind": "expression", "name": name, "column": column, "holds": holds, **more}


#: Fixed kinds of entities.
ENTITY_TYPES = ("PERSON", "ORG", "LOCATION", "DATE", "AMOUNT", "OTHER")


def payload_rules(required: dict[str, list[str]], payload: str = "payload") -> list[dict[str, Any]]:
    """A rule for each event type: its payload (a variant) has these keys (an extension)."""
    return [
        _holds(
            f"payload.{kind}.required", payload,
            f"event_type <> '{kind}' or (" + " and ".join(f"try_variant_get({payload}, '$.{k}', 'variant') is not null" for k in keys) + ")",
            check_type="structural",
        )
        for kind, keys in required.items() if keys
    ]


#: Cross-field rules of the records an AI platform keeps (an extension), for ``rules`` of a contract.
EXTENSION_RULES: dict[str, list[dict[str, Any]]] = {
    "intents": [
        _holds("code_refs.present", "code_refs", "coalesce(size(code_refs), 0) > 0"),
        _holds("code_refs.confidence", "code_refs[].confidence", "forall(code_refs, r -> r.confidence between 0 and 1)", check_type="range")
    ],
    "verdicts": [
        _holds("scores.range", "scores", "forall(map_values(scores), s -> s.score between 1 and 5 and s.score = round(s.score))", check_type="range"),
        _holds(
            "overall_score.mean", "overall_score",
            "abs(overall_score - try_divide(aggregate(map_values(scores), 0D, (t, s) -> t + s.score * s.weight), "
            "aggregate(map_values(scores), 0D, (t, s) -> t + s.weight))) < 0.005",
            check_type="arithmetic"
        ),
        _holds("verdict.enum", "overall_verdict", "overall_verdict in ('PASS', 'FAIL', 'WARN')", check_type="enum"),
    ],
    "extractions": [
        _holds(
            "entities.type.enum", "entities[].type", f"forall(entities, e -> e.type in {ENTITY_TYPES})", check_type="enum"
        ),
        _holds(
            "entity_refs.reference", "extracted_facts[].entity_refs",
            "size(array_except(flatten(transform(extracted_facts, f -> f.entity_refs)), transform(entities, e -> e.entity_id))) = 0",
            check_type="referential"
        )
    ],
    "events": [
        _holds("event_type.pascal_case", "event_type", "event_type rlike '^[A-Z][A-Za-z0-9]*$'", check_type="pattern"),
        _holds("recorded_at.order", "recorded_at", "recorded_at >= occurred_at", check_type="temporal")
    ],
    "traces": [
        _holds("end_time.order", "end_time", "start_time < end_time", check_type="temporal"), _holds(
            "total_tokens.sum", "total_tokens", "total_tokens = prompt_tokens + completion_tokens",
            check_type="arithmetic"
        ),
        _holds("total_cost.range", "total_cost", "total_cost >= 0", check_type="range"),
    ],
}


def statistics_sample(df: DataFrame, key: str, percent: int = 5) -> DataFrame:
    """A sample for statistics only, by a digest of the key: the same rows in every run. Structural checks take all rows."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long") % 100 < percent)
