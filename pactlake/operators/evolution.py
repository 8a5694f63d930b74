"""Schema versions: flattening to paths, full outer diff, classification of changes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLAUSE = "path string, type string, required boolean, format string, pattern string, minimum double, maximum double, unique boolean, enum array<string>"


def walk(schema: dict[str, Any], prefix: str = "") -> Iterator[tuple]:
    """A schema's fields as rows: ``a.b`` for properties, ``a[].b`` for elements of arrays."""
    for name, spec in schema.items():
        if not isinstance(spec, dict):
            continue
        path = f"{prefix}{name}"
        num = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        yield (
            path, spec.get("type"), bool(spec.get("required")), spec.get("format"), spec.get("pattern"),
            num(spec.get("minimum")), num(spec.get("maximum")), bool(spec.get("unique")),
            [str(v) for v in spec["enum"]] if spec.get("enum") is not None else None
        )
        yield from walk(spec.get("properties") or {}, f"{path}.")
        items = spec.get("items") or {}
        if isinstance(items, dict):
            inner = items.get("properties") if isinstance(items.get("properties"), dict) else {
                k: v for k, v in items.items() if isinstance(v, dict)
            }
            yield from walk(inner, f"{path}[].")


def flatten(spark: SparkSession, schema: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(list(walk(schema)), CLAUSE)


def classify(o: str = "o", n: str = "n") -> tuple[Column, Column]:
    """(verdict, taxonomy): the first rule that fits; any change of a range breaks, also a wider one."""
    old, new = (lambda f: F.col(f"{o}.{f}")), (lambda f: F.col(f"{n}.{f}"))
    ne = lambda f: ~old(f).eqNullSafe(new(f))
    none = F.array().cast("array<string>")
    gone = F.size(F.array_except(F.coalesce(old("enum"), none), F.coalesce(new("enum"), none))) > 0
    more = F.size(F.array_except(F.coalesce(new("enum"), none), F.coalesce(old("enum"), none))) > 0
    rules = [
        (
            F.col(o).isNull() & new("required"), "BREAKING", "add_required_field"
        ), (F.col(o).isNull(), "COMPATIBLE", "add_nullable_field"), (F.col(n).isNull(), "BREAKING", "remove_field"), (ne("type"), "BREAKING", "type_change"),
        (
            ne("maximum"), "BREAKING", "range_maximum_change"
        ), (ne("minimum"), "BREAKING", "range_minimum_change"), (gone, "BREAKING", "enum_value_removed"), (more, "COMPATIBLE", "enum_value_added"),
    ]
    verdict, taxonomy = F.lit("COMPATIBLE"), F.lit("no_material_change")
    for cond, v, t in reversed(rules):
        verdict, taxonomy = F.when(cond, v).otherwise(verdict), F.when(cond, t).otherwise(taxonomy)
    return verdict, taxonomy


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    a = old.select("path", F.struct(*[c for c in old.columns if c != "path"]).alias("o"))
    b = new.select("path", F.struct(*[c for c in new.columns if c != "path"]).alias("n"))
    verdict, taxonomy = classify()
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"), taxonomy.alias("taxonomy"))


def rename_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed and added fields with equal clauses, perhaps renamed (an extension)."""
    cols = [c for c in old.columns if c != "path"]
    key = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    gone = old.join(new, "path", "left_anti").select(F.col("path").alias("old_path"), key.alias("k"))
    come = new.join(old, "path", "left_anti").select(F.col("path").alias("new_path"), key.alias("k"))
    return gone.join(come, "k").drop("k")


def snapshot_json(schema: dict[str, Any]) -> str:
    return json.dumps(schema, sort_keys=True)


def human_line(field: Column) -> Column:
    """One line for a field's clause (a struct as ``diff`` has it)."""
    said = [
        F.coalesce(field["type"], F.lit("any")), F.when(field["required"], "required"), F.when(field["unique"], "unique"),
        F.concat(F.lit("format="), field["format"]), F.concat(F.lit("pattern="), field["pattern"]),
        F.concat(F.lit("min="), field["minimum"].cast("string")), F.concat(F.lit("max="), field["maximum"].cast("string")),
        F.concat(F.lit("enum="), F.array_join(field["enum"], "|")),
    ]
    return F.concat_ws(", ", *said)


def lines(clauses: DataFrame) -> DataFrame:
    """path and its human line."""
    field = F.struct(*[c for c in clauses.columns if c != "path"])
    return clauses.select("path", human_line(field).alias("line"))


#: Types that hold all values of another; a change to them widens.
WIDER = (("integer", "number"), ("integer", "string"), ("number", "string"), ("boolean", "string"))


def widenings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields whose new type holds all old values (an extension): path, from, to."""
    j = old.select("path", F.col("type").alias("old_type")).join(new.select("path", F.col("type").alias("new_type")), "path")
    wide = F.lit(False)
    for a, b in WIDER:
        wide = wide | ((F.col("old_type") == a) & (F.col("new_type") == b))
    return j.where(wide)
