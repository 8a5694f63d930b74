"""Reading semi-structured records: strict, with an issue log, or skipping bad lines."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _from_literal(lines: Column) -> Column:
    """Lines that are Python literals as JSON, null for others. Only lines that aren't JSON come here."""

    def convert(values: pd.Series) -> pd.Series:  # local, so that executors needn't have this package
        import ast
        import json

        def one(line: str) -> str | None:
            try:
                return json.dumps(ast.literal_eval(line.strip()))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return values.map(one)

    return F.pandas_udf(convert, "string")(lines)


def strict(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """Fails on the first bad record."""
    r = spark.read.option("mode", "FAILFAST").option("multiLine", multi_line)
    return (r.schema(schema) if schema is not None else r).json(path)


def skipping(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Drops bad lines."""
    r = spark.read.option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema is not None else r).json(path)


def lenient(spark: SparkSession, path: str, literals: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, issues): records as variants with their order; arrays on a line give their objects.

    With ``literals``, lines that aren't JSON but a Python literal (single quotes, None) are records, too.

    Issues are (line, kind, detail): malformed_line, unexpected_line_type, skip_non_object_in_line_array;
    the detail is the begin of the text.
    """
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^﻿", "").alias("value")
    ).where("trim(value) <> ''")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    if literals:
        parsed = parsed.where("v is not null").unionByName(
            parsed.where("v is null").withColumn("v", F.try_parse_json(_from_literal(F.col("value"))))
        )
    kind = F.upper(F.substring(F.schema_of_variant("v"), 1, 5))
    parsed = parsed.withColumn("kind", F.when(F.col("v").isNull(), "BAD").otherwise(kind))
    flat = parsed.where("kind = 'ARRAY'").select("line", F.expr("explode(cast(v as array<variant>))").alias("v"))
    inner = F.upper(F.substring(F.schema_of_variant("v"), 1, 6)) == "OBJECT"
    records = parsed.where("kind = 'OBJEC'").select("line", "v").unionByName(flat.where(inner))
    issues = (
        parsed.where("kind = 'BAD'").select("line", F.lit("malformed_line").alias("kind"), _begin("value"))
        .unionByName(
            parsed.where("kind not in ('BAD', 'ARRAY', 'OBJEC')").select(
                "line", F.lit("unexpected_line_type").alias("kind"), _begin("value")
            )
        )
        .unionByName(flat.where(~inner).select("line", F.lit("skip_non_object_in_line_array").alias("kind"), _begin("v")))
    )
    return records, issues


#: Characters of an issue's detail.
DETAIL = 120


def _begin(column: str) -> Column:
    return F.substring(F.col(column).cast("string"), 1, DETAIL).alias("detail")


def whole_array(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of files that are one JSON array each; what isn't an object in it is an issue."""
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    items = files.select(F.expr("posexplode(try_variant_get(v, '$', 'array<variant>'))").alias("line", "v"))
    items = items.withColumn("line", F.col("line").cast("long"))
    is_object = F.coalesce(F.upper(F.substring(F.schema_of_variant("v"), 1, 6)) == "OBJECT", F.lit(False))
    bad = items.where(~is_object).select("line", F.lit("skip_non_object_in_array").alias("kind"), _begin("v"))
    odd = files.where("v is null").select(F.lit(0).cast("long").alias("line"), F.lit("malformed_line").alias("kind"), _begin("value"))
    return items.where(is_object), bad.unionByName(odd)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last record of a file that parses, as one variant."""
    records, _ = lenient(spark, path)
    return records.agg(F.max_by("v", "line").alias("v"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def summary(spark: SparkSession, path: str, fields: dict[str, str]) -> dict | None:
    """Fields (name -> JSON path) of a report of another step, one JSON document; None if it isn't there or broken."""
    try:
        doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        row = doc.select(
            *[F.try_variant_get("v", p, "string").alias(n) for n, p in fields.items()],
            F.col("v").isNotNull().alias("__ok")
        ).first()
    except AnalysisException:
        return None
    return {n: row[n] for n in fields} if row is not None and row["__ok"] else None
