"""Flat rows from semi-structured records (a variant column), for profiles, drift and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(path: str, kind: str = "string", v: str = "v") -> Column:
    """The value at a dotted path; null if a step is missing or the value has another type."""
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


def key_count(path: str, v: str = "v") -> Column:
    """Keys of an object; null where there is no object."""
    m = at(path, "map<string,variant>", v)
    return F.when(m.isNotNull(), F.size(F.map_keys(m)))


def length(path: str, v: str = "v") -> Column:
    """Elements of an array; 0 where there is none."""
    a = at(path, "array<variant>", v)
    return F.when(a.isNull(), 0).otherwise(F.size(a))


def canonical(path: str, v: str = "v") -> Column:
    """JSON text with sorted keys, equal for equal values."""
    return at(path, "variant", v).cast("string")


def first_number(path: str, name: str, v: str = "v") -> Column:
    """A field of an array's first element as a number."""
    return at(f"{path}[0].{name}", "double", v)


def mean_number(path: str, name: str, v: str = "v") -> Column:
    """Mean of a field over a row's own array elements, without those that aren't numbers."""
    a = F.coalesce(at(path, "array<variant>", v), F.array().cast("array<variant>"))
    xs = F.filter(F.transform(a, lambda e: F.try_variant_get(e, f"$.{name}", "double")), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs).cast("double"))


def _columns(paths: dict[str, str]) -> list[Column]:
    return [at(p, k).alias(p.replace(".", "_")) for p, k in paths.items()]


def extractions(records: DataFrame) -> DataFrame:
    flat = _columns(
        {
            "doc_id": "string", "source_path": "string", "source_hash": "string", "extraction_model": "string",
            "processing_time_ms": "double", "token_count.input": "bigint", "token_count.output": "bigint",
            "extracted_at": "string"
        }
    )
    return records.select(
        *flat, length("entities").alias("entities_len"), length("extracted_facts").alias("extracted_facts_len"),
        first_number("extracted_facts", "confidence").alias("primary_fact_confidence")
    )


def events(records: DataFrame) -> DataFrame:
    flat = _columns(
        {
            "event_id": "string", "event_type": "string", "aggregate_id": "string", "aggregate_type": "string",
            "sequence_number": "bigint", "schema_version": "string", "occurred_at": "string", "recorded_at": "string",
            "metadata.correlation_id": "string", "metadata.source_service": "string"
        }
    )
    return records.select(*flat, F.coalesce(key_count("payload"), F.lit(0)).alias("payload_key_count"))


def traces(records: DataFrame) -> DataFrame:
    flat = _columns(
        {
            "id": "string", "name": "string", "run_type": "string", "session_id": "string", "error": "string",
            "start_time": "string", "end_time": "string", "total_tokens": "bigint", "prompt_tokens": "bigint",
            "completion_tokens": "bigint", "total_cost": "double"
        }
    )
    counts = [F.coalesce(key_count(c), F.lit(0)).alias(f"{c}_key_count") for c in ("inputs", "outputs")]
    return records.select(*flat, F.coalesce(canonical("tags"), F.lit("[]")).alias("tags_repr"), *counts)


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of lineage snapshots, a row each."""
    def rows(name: str, paths: dict[str, str]) -> DataFrame:
        return records.select(F.explode(at(name, "array<variant>")).alias("v")).where("v is not null").select(*_columns(paths))

    nodes = rows(
        "nodes",
        {"node_id": "string", "type": "string", "label": "string", "metadata.path": "string", "metadata.language": "string"}
    )
    return nodes, rows("edges", {"source": "string", "target": "string", "relationship": "string", "confidence": "double"})


def type_mix(records: DataFrame, path: str) -> DataFrame:
    """kinds, n, status: WARN if a field's values are of several types."""
    kind = F.schema_of_variant(at(path, "variant"))
    kind = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "NUMBER").when(
        kind.rlike("^[A-Z]+<"), F.regexp_extract(kind, "^[A-Z]+", 0)
    ).when(kind != "VOID", kind)
    one = records.select(kind.alias("kind")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("kind").alias("n"))
    return one.withColumn("status", F.when(F.size("kinds") > 1, "WARN").otherwise("PASS"))


def shape_caveats(records: DataFrame, arrays: list[str], numbers: list[str]) -> DataFrame:
    """(field, problem, n): arrays that are missing or no arrays, numbers that aren't; n > 0 only."""
    aggs = []
    def add(field: str, problem: str, cond: Column) -> None:
        aggs.append(
            F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.count_if(F.coalesce(cond, F.lit(False))).alias("n"))
        )

    for p in arrays:
        kind = F.coalesce(F.schema_of_variant(at(p, "variant")), F.lit("VOID"))
        add(p, "missing", kind == "VOID")
        add(p, "not an array", (kind != "VOID") & ~F.startswith(kind, F.lit("ARRAY")))
    for p in numbers:
        kind = F.coalesce(F.schema_of_variant(at(p, "variant")), F.lit("VOID"))
        add(p, "not a number", ~kind.rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    one = records.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    return one.select(F.explode(F.array(*[f"a{i}" for i in range(len(aggs))])).alias("r")).select("r.*").where("n > 0")


def first_of_repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """(order, copies): the first of rows with equal keys, by ``order``, and how many there are. Combined before its shuffle."""
    return df.groupBy(key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).select(order, "copies")
