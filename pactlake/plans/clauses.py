"""From a contract (a plain dict, as its YAML reads) to clauses.

A field that the data lacks is null in every row: it breaks ``required``, and its
type and enum can't be checked. Whatever the schema can't resolve becomes an
error result of its own; the other clauses run.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import anchored, as_int, parse_time, short_number
from ..model import RESULT, UUID, Clause, prefix_of

#: Columns that name a row in samples, by preference.
KEYS = ("doc_id", "event_id", "id")
#: What a type is called in results; fixed names.
DTYPES = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64",
    "string": "object", "boolean": "bool"
}
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Most characters of a sample.
SHOWN = 64


def row_key(columns: list[str]) -> Column:
    found = [F.nullif(F.col(k).cast("string"), F.lit("")) for k in KEYS if k in columns]
    return F.coalesce(*found, F.lit("row"))


def field_at(schema: T.StructType, path: str) -> T.DataType | None:
    """The type of a column of that name, else of a dotted path; None where the schema has neither."""
    if path in schema.fieldNames():
        return schema[path].dataType
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None
        kind = kind[name].dataType
    return kind


@dataclass(frozen=True)
class Field:
    """A field of a contract where the data has it, or null."""

    path: str
    spec: dict[str, Any]
    prefix: str
    key: Column
    kind: T.DataType | None
    name_of: str

    @property
    def col(self) -> Column:
        return F.lit(None).cast("string") if self.kind is None else F.col(self.name_of)

    @property
    def name(self) -> str:
        return "absent" if self.kind is None else self.kind.simpleString()

    def clause(self, suffix: str, check_type: str, expected: str, **more: Any) -> Clause:
        return Clause(f"{self.prefix}.{self.path}.{suffix}", self.path, check_type, expected, **more)

    def shown(self) -> Column:
        return F.substring(self.col.cast("string"), 1, SHOWN)


def _error(clause: Clause, actual: str, message: str) -> Clause:
    return Clause(
        clause.check_id, clause.column, clause.check_type, clause.expected, kind="error", message=message,
        params={"actual": actual}
    )


def _required(f: Field) -> Clause:
    if "." in f.path:
        return f.clause(
            "required", "not_null", "required", bad=f.col.isNull(), sample=f.key, said=("missing", "missing=0"),
            message=f"{f.path} is required."
        )
    message = f"Required field '{f.path}' is null or absent on {{n}} record(s)."
    return f.clause(
        "required", "not_null", "all non-null", bad=f.col.isNull(), sample=f.key,
        said=("missing_count", "missing_count=0"), message=message
    )


def _type(f: Field) -> Clause:
    """Numbers are numeric, integers are whole: of a column that isn't, all values fail."""
    want, name = f.spec["type"], f.name
    numeric = name in DTYPES and name not in ("string", "boolean") or name.startswith("decimal")
    said = DTYPES.get(name, name)
    expected = {"integer": "integer", "number": "float64 or int64 (numeric)"}.get(want, want)
    out = f.clause(
        "type_match", "type", expected, expected_ok="numeric" if want == "number" else None, bad=F.lit(False),
        sample=F.typeof(f.col)
    )
    if f.kind is None:
        return _error(out, "column_absent", f"Cannot run type check: the data has no column '{f.path}'.")
    if want == "number":
        ok = F.lit(numeric)
    elif want == "integer":
        v = f.col.try_cast("double")
        ok = F.lit(True) if name in WHOLE else (F.count_if(v != F.round(v)) == 0) & (F.count(v) > 0) if numeric else F.lit(False)
    else:
        ok = F.lit(name.startswith({"array": "array", "object": ("struct", "map", "variant")}.get(want, want)))
    params = {"failing": F.when(ok, F.lit(0)).otherwise(F.count(f.col)), "actual": F.lit(f"dtype={said}")}
    message = f"Contract type {want} but column '{f.path}' is not {'numeric' if want == 'number' else want}."
    return f.clause(
        "type_match", "type", expected, expected_ok=out.expected_ok, bad=F.lit(False), sample=F.typeof(f.col),
        said=("dtype", said), message=message, params=params
    )


def _texts(f: Field) -> list[Clause]:
    """Patterns, ids and times: values that are not strings break them."""
    spec, there = f.spec, f.col.isNotNull()
    string = F.lit(isinstance(f.kind, T.StringType))
    nested = "." in f.path
    out = []
    if spec.get("format") == "uuid":
        pattern = UUID if nested else spec.get("pattern") or UUID
        bad = there & ~(string & f.col.cast("string").rlike("(?i)" + anchored(pattern)))
        if nested:
            out.append(
                f.clause(
                    "format", "format", "uuid", bad=bad, applies=there, sample=f.shown(), empty="NONE",
                    said=("invalid", "valid"), message=f"{f.path} must be a UUID."
                )
            )
        else:
            message = f"Field '{f.path}' does not match UUID pattern."
            out.append(
                f.clause(
                    "format.uuid", "format", spec.get("pattern") or "uuid", expected_ok="uuid", bad=bad, applies=there,
                    sample=f.shown(), said=("invalid_uuid_count", "all valid uuid shape"), message=message
                )
            )
    elif spec.get("pattern"):
        bad = there & ~(string & f.col.cast("string").rlike(anchored(spec["pattern"])))
        out.append(
            f.clause(
                "pattern", "pattern", spec["pattern"], bad=bad, applies=there, sample=f.shown(),
                said=("pattern_mismatch", "all match or null"), message=f"Field '{f.path}' does not match pattern."
            )
        )
    if spec.get("format") == "date-time":
        bad = there & parse_time(f.col).isNull()
        message = "date-time field has values that do not parse as ISO-8601."
        out.append(
            f.clause(
                "format.date-time", "format", "ISO-8601", bad=bad, applies=there, sample=f.shown(),
                said=("unparseable_count", "all parseable"), message=message
            )
        )
    return out


def _allowed(f: Field) -> Column:
    """Whether a value is one of the enum's, compared as what the column holds: numbers as numbers, booleans as booleans."""
    values, name = f.spec["enum"], f.name
    if name == "boolean":
        known = {"true": True, "false": False}
        return f.col.isin([known[str(v).lower()] for v in values if str(v).lower() in known])
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    numbers += [float(v) for v in values if isinstance(v, str) and re.fullmatch(_NUMBER, v.strip())]
    if name in WHOLE:
        return f.col.cast("bigint").isin([int(v) for v in numbers if v == int(v) and abs(v) < 1 << 63])
    if name in ("float", "double"):
        return f.col.isin([float(v) for v in numbers])
    if name.startswith("decimal"):
        return functools.reduce(Column.__or__, [f.col == F.lit(Decimal(str(v))) for v in numbers], F.lit(False))
    return f.col.cast("string").isin([str(v) for v in values] + [str(v).lower() for v in values if isinstance(v, bool)])


def _enum(f: Field) -> Clause:
    allowed = [str(v) for v in f.spec["enum"]]
    inside = _allowed(f) if f.kind is not None else F.lit(None)
    if f.spec.get("null_is_bad"):
        expected = str(sorted(allowed))
        return f.clause(
            "enum", "accepted_values", expected, bad=~F.coalesce(inside, F.lit(False)), sample=f.key, empty="NONE",
            said=("invalid_count", "valid"), message=f"{f.path} must be enum value."
        )
    out = f.clause(
        "enum", "enum", "|".join(allowed), bad=~F.coalesce(inside, F.lit(True)), applies=f.col.isNotNull(),
        sample=f.shown(), said=("non_conforming_count", "all values in enum"), message="Values outside contract enum."
    )
    return _error(out, "column_absent", f"Cannot run enum check: no column '{f.path}' in the data.") if f.kind is None else out


def _bounds(f: Field) -> list[Clause]:
    out = []
    for name, op, side in (("minimum", "<", "below"), ("maximum", ">", "above")):
        limit = f.spec.get(name)
        if limit is None:
            continue
        v = as_int(f.col) if f.spec.get("type") == "integer" else f.col.try_cast("double")
        outside = F.coalesce(v < F.lit(limit) if op == "<" else v > F.lit(limit), F.lit(True))
        expected = f"{'>=' if op == '<' else '<='} {limit}"
        message = f"{'Integer' if f.spec.get('type') == 'integer' else 'Number'} '{f.path}' must be {expected}."
        there = f.col.isNotNull()
        out.append(
            f.clause(
                name, "range", expected, bad=there & outside, applies=there, sample=f.key,
                said=(f"{side}_{name}_count", f"all {expected}"), message=message
            )
        )
    return out


def _outside(lo: float, hi: float):
    return lambda v: (v < lo) | (v > hi)


def _numbers(f: Field, name: str, label: str | None, lo: float, hi: float) -> tuple[Column, Column]:
    """The numbers of an array's elements, and what names the elements whose number is out of range."""
    pair = lambda x: F.struct(
        x[name].try_cast("double").alias("v"),
        (x[label].cast("string") if label else F.lit(None).cast("string")).alias("k")
    )
    pairs, outside = F.transform(f.col, pair), _outside(lo, hi)
    values = F.filter(F.transform(pairs, lambda x: x["v"]), lambda v: v.isNotNull())
    return values, F.transform(F.filter(pairs, lambda x: outside(x["v"])), lambda x: F.coalesce(x["k"], f.key))


def _elements(f: Field) -> list[Clause]:
    """Ranges of numbers in the elements of an array; every number counts, and is named by its element's own id."""
    out = []
    for name, sub in (f.spec.get("items") or {}).items():
        if not isinstance(sub, dict) or (sub.get("minimum") is None and sub.get("maximum") is None):
            continue
        lo, hi = sub.get("minimum", float("-inf")), sub.get("maximum", float("inf"))
        element = f.kind.elementType if isinstance(f.kind, T.ArrayType) else None
        column, cid = f"{f.path}[*].{name}", f"{f.prefix}.{f.path}.{name}.range"
        bad_expected, ok_expected = f"max<={hi}, min>={lo}", f"min>={lo}, max<={hi}"
        if not isinstance(element, T.StructType) or name not in element.fieldNames():
            values, ids = F.array().cast("array<double>"), F.array().cast("array<string>")
        else:
            label = next((k for k in (f"{f.path.rsplit('_', 1)[-1].rstrip('s')}_id", *KEYS) if k in element.fieldNames()), None)
            values, ids = _numbers(f, name, label, lo, hi)
        outside = _outside(lo, hi)
        top, low = F.max(F.array_max(values)), F.min(F.array_min(values))
        count = F.sum(F.size(values))
        total = F.try_divide(F.sum(F.aggregate(values, F.lit(0.0), lambda s, v: s + v)), count)
        actual = F.concat(F.lit("max="), short_number(top, 4), F.lit(", mean="), short_number(total, 4))
        message = (
            F.when(top > 1.0, "confidence is in 0–100 range, not 0.0–1.0. Breaking change detected.")
            .when(
                low < lo, f"One or more values of {column} are below the contract minimum ({lo})."
            ).otherwise(f"One or more values of {column} violate the contract range.")
        )
        params = {
            "failing": F.coalesce(F.sum(F.size(F.filter(values, outside))), F.lit(0)), "actual": actual,
            "message": message if (lo, hi) == (0.0, 1.0) else f"Values of {column} violate the contract range.",
            "none": ok_expected
        }
        out.append(
            Clause(
                cid, column, "range", bad_expected, bad=F.coalesce(
                    F.exists(values, outside), F.lit(False)
                ), applies=F.coalesce(F.size(values) > 0, F.lit(False)),
                sample=ids, empty="WARN", said=("failing", f"all in [{lo},{hi}]"), expected_ok=ok_expected, params=params,
            )
        )
    return out


def field_clauses(path: str, spec: dict[str, Any], prefix: str, key: Column, schema: T.StructType) -> list[Clause]:
    """Clauses of one field; nested objects recurse, and array items range over elements."""
    f = Field(path, spec, prefix, key, field_at(schema, path), f"`{path}`" if path in schema.fieldNames() else path)
    out = []
    if spec.get("required"):
        out.append(_required(f))
    if spec.get("type") in ("integer", "number") and "." not in path or (spec.get("check_type") and spec.get("type")):
        out.append(_type(f))
    if spec.get("unique"):
        out.append(unique_clause(f"{prefix}.{path}.unique", path, [f.name_of], f.kind is None))
    out += _texts(f)
    if spec.get("enum"):
        out.append(_enum(f))
    out += _bounds(f)
    for name, sub in (spec.get("properties") or {}).items():
        if isinstance(sub, dict):
            out += field_clauses(f"{path}.{name}", sub, prefix, key, schema)
    return out + _elements(f)


def unique_clause(check_id: str, column: str, keys: list[str], absent: bool = False, **more: Any) -> Clause:
    said = ("duplicate_values", "duplicate_count=0")
    more = {"message": f"Duplicate values for '{column}'.", "check_type": "unique", "expected": "unique", "said": said} | more
    if absent:  # a column of nulls has no duplicates
        return Clause(check_id, column, bad=F.lit(False), sample=F.lit(""), **more)
    return Clause(check_id, column, kind="unique", params={"keys": keys}, **more)


_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_LINE = re.compile(
    rf"(?:(?P<rows>row_count)|(?P<what>missing_count|duplicate_count|min|max|avg|sum)\((?P<column>\w+)\))\s*(?P<op>>=|<=|>|<|=)\s*(?P<limit>{_NUMBER})"
)


def _holds(v: Column, op: str, limit: float) -> Column:
    return {">=": v >= limit, "<=": v <= limit, ">": v > limit, "<": v < limit, "=": v == limit}[op]


def quality_clause(line: str, prefix: str, columns: dict[str, Column]) -> Clause:
    """One line of the quality language, the whole of it; what isn't understood becomes an error result."""
    line = line.strip()
    m = _LINE.fullmatch(line)
    what, column = (m["what"], m["column"]) if m else (None, None)
    limit, op = (float(m["limit"]), m["op"]) if m else (0.0, "")
    known = bool(m) and (column is None or column in columns)
    if not known or (what == "duplicate_count" and (op, limit) != ("=", 0.0)):
        why = f"no column '{column}'" if m and not known else "Quality line not understood."
        return Clause(f"{prefix}.quality.unparsed", "*", "custom", "a quality line", kind="error", message=why, params={"actual": line})
    cid = f"{prefix}.quality.{'row_count' if column is None else f'{column}.{what}'}"
    expected = f"{op} {int(limit) if column is None and limit == int(limit) else limit}"
    if column is None:
        params = {
            "agg": F.count(F.lit(1)).cast("double"), "shown": F.count(F.lit(1)).cast("string"), "op": op,
            "limit": limit, "each": F.count(F.lit(1))
        }
        return Clause(cid, "*", "volume", expected, kind="aggregate", said=("row_count", ""), message=line, params=params)
    c = columns[column]
    if what == "missing_count" and (op, limit) == ("=", 0.0):
        return Clause(
            cid, column, "completeness", "0", bad=c.isNull(), sample=F.lit(None).cast("string"),
            said=("missing_count", "missing_count=0"), message=line, params={"always": line}
        )
    if what == "missing_count":
        n = F.count_if(c.isNull())
        return Clause(
            cid, column, "completeness", expected, kind="aggregate", said=("missing_count", ""), message=line,
            params={"agg": n.cast("double"), "shown": n.cast("string"), "op": op, "limit": limit, "each": n}
        )
    if what == "duplicate_count":
        return unique_clause(cid, column, [column], message=line)
    v = c.try_cast("double")
    agg = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum}[what](v)
    each = F.count_if(~_holds(v, op, limit)) if (what, op[0]) in (("min", ">"), ("max", "<")) else F.lit(1)
    return Clause(
        cid, column, "range", expected, kind="aggregate", said=(what, ""), message=line,
        params={"agg": agg, "shown": agg.cast("string"), "op": op, "limit": limit, "each": each}
    )


#: Columns that hold whether a row meets an expression rule, by the rule's place.
RULE = "__rule"


def with_rules(df: DataFrame, contract: dict[str, Any]) -> DataFrame:
    """Expression rules and derived columns, computed so that no row can end the job.

    What can't be computed in a row (a division by zero, a text that is no number) is null there: such a rule doesn't
    apply to the row. Spark fixes this when an expression is analysed, so its strict mode is off just then.
    """
    conf, mode = df.sparkSession.conf, "spark.sql.ansi.enabled"
    found = {f"{RULE}{i}": r["holds"] for i, r in enumerate(contract.get("rules") or []) if r.get("kind") == "expression"}
    found |= {f"{RULE}_{name}": e for name, e in (contract.get("derived") or {}).items()}
    before = conf.get(mode)
    conf.set(mode, "false")
    try:
        for name, holds in found.items():
            try:
                df = df.withColumn(name, holds() if callable(holds) else F.expr(holds))
                df.schema  # noqa: B018  analysis only
            except AnalysisException:
                continue  # the clause says so
    finally:
        conf.set(mode, before)
    return df


def rule_clause(rule: dict[str, Any], cid: str, key: Column, computed: str | None = None) -> Clause:
    """A rule across fields: a row predicate (``computed``: the column that holds it), or uniqueness, order or reference."""
    severity, column, kind = rule.get("severity", "CRITICAL"), rule.get("column", "*"), rule["kind"]
    if kind == "expression":
        holds = F.col(computed) if computed else rule["holds"]() if callable(rule["holds"]) else F.expr(rule["holds"])
        failing = F.count_if(~holds)
        params = {"failing": F.least(failing, F.lit(1))} if rule.get("first_only") else {}
        return Clause(
            cid, column, rule.get("check_type", "custom"), rule.get("expected", "expression"), severity, bad=~holds, applies=holds.isNotNull(), sample=key,
            empty=rule.get("empty", "PASS"), said=(
                rule.get("said", "violations"), rule.get("ok", "ok")
            ), expected_ok=rule.get("expected_ok"), message=rule.get("message", f"{column}: {rule.get('expected', 'the rule')} doesn't hold in {{n}} records."), params=params,
        )
    if kind == "unique":
        return unique_clause(cid, column, rule["keys"], severity=severity)
    if kind == "sequence":
        return Clause(
            cid, column, "sequence", rule.get("expected", "+1 per group"), severity, kind="sequence",
            said=("breaks", "monotonic"), message="Values of a group have to follow one another.", params=rule
        )
    if kind != "reference":
        raise ValueError(f"unknown kind of rule: {kind}")
    return Clause(
        cid, column, "referential", "reference", severity, kind="reference", said=("orphans", "all resolve"),
        message="Keys have to be in the other table.", params=rule
    )


def derived_columns(contract: dict[str, Any], df: DataFrame) -> dict[str, Column]:
    """Columns that quality lines may name: the data's own, and expressions of the contract (null where the data lacks their fields)."""
    out = {c: F.col(f"`{c}`") for c in df.columns}
    for name in contract.get("derived") or {}:
        computed = f"{RULE}_{name}"
        out[name] = F.col(f"`{computed}`") if computed in df.columns else F.lit(None).cast("double")
    return out


def compile_contract(contract: dict[str, Any], df: DataFrame) -> list[Clause]:
    """All clauses of a contract for a DataFrame with its fields, and with its rules' columns (``with_rules``)."""
    prefix, key = prefix_of(contract["id"]), row_key(df.columns)
    clauses: list[Clause] = []
    for name, spec in (contract.get("schema") or {}).items():
        if isinstance(spec, dict):
            clauses += _safe(f"{prefix}.{name}", name, lambda n=name, s=spec: field_clauses(n, s, prefix, key, df.schema))
    for i, rule in enumerate(contract.get("rules") or []):
        cid = f"{prefix}.{rule.get('name', i)}"
        computed = f"{RULE}{i}" if f"{RULE}{i}" in df.columns else None
        clauses += _safe(cid, rule.get("column", "*"), lambda r=rule, c=cid, k=computed: [rule_clause(r, c, key, k)])
    quality = contract.get("quality") or {}
    lines = quality.get("checks") or (quality.get("specification") or {}).get("checks") or []
    columns = derived_columns(contract, df)
    clauses += [quality_clause(line, prefix, columns) for line in lines if isinstance(line, str)]
    return [isolated(c, df) for c in clauses]


def _safe(cid: str, column: str, make) -> list[Clause]:
    """A clause that can't even be made is an error result."""
    try:
        return make()
    except Exception as e:
        return [Clause(cid, column, "system", "a clause", kind="error", message=f"{type(e).__name__}: {e}"[:300])]


def isolated(clause: Clause, df: DataFrame) -> Clause:
    """The clause, or an error result if the schema can't resolve all that it reads."""
    p = clause.params
    try:
        rows = [c for c in (clause.bad, clause.applies, clause.sample) if c is not None]
        rows += [F.col(k) for k in p.get("keys", [])]
        if clause.kind == "sequence":
            rows += [F.col(p["column"]).try_cast("bigint"), *[F.col(c) for c in p["by"]]]
        aggs = [p[k] for k in ("failing", "actual", "message", "agg", "shown", "each") if isinstance(p.get(k), Column)]
        if rows:
            df.select(*[c.alias(f"c{i}") for i, c in enumerate(rows)]).schema  # noqa: B018  analysis only
        if aggs:
            df.agg(*[c.alias(f"a{i}") for i, c in enumerate(aggs)]).schema  # noqa: B018
        if clause.kind == "reference":
            keys = p["table"].select(F.col(p["key"]).alias("k"))
            df.select(F.col(p["column"]).alias("c")).join(keys, F.col("c").eqNullSafe(F.col("k")), "left_anti").schema  # noqa: B018
        return clause
    except Exception as e:
        return _error(clause, "error", str(e).splitlines()[0][:300])


RESULT_NAMES = RESULT.fieldNames()
