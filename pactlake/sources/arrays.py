"""JSON arrays of any size: one file is read by many tasks.

Spark's text reader cuts a file at every ``}``, wherever its splits lie. A piece starts inside a string if the
unescaped quotes before it are odd in number, and its depth is what the brackets outside of strings before it add up to: both are
prefix sums, which are taken within a split and, over a row for each split, between splits. Where a ``}`` leads
back to the array itself, an element ends. Only an element's own pieces meet in one place; no task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import DETAIL

_AT = ["file", "split", "id"]


def _before(df: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over a file's pieces before each. Splits' sums meet, pieces don't."""
    inside = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("file", "split").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "split", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    own = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(sums, ["file", "split"]).withColumn(name, F.col(name) + F.col("__earlier")).drop("__earlier")


def _brackets(text: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    count = lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    return count("{") + count("[") - count("}") - count("]")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, last, text): the text that ends with each object of a file's array, and what follows the last one.

    ``nth`` counts these texts from 0; other elements stand before an object, or in the last text.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value"
    )
    end = pieces.groupBy("file").agg(F.max(F.struct("split", "id")).alias("end"))  # a row for each file
    pieces = pieces.join(end, "file").withColumn("last", F.struct("split", "id") == F.col("end")).drop("end")
    pieces = pieces.withColumn("text", F.when(F.col("last"), F.col("value")).otherwise(F.concat("value", F.lit("}")))).drop("value")
    # only structure matters for bounds: no escapes, then no insides of strings
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quotes = F.char_length(bare) - F.char_length(F.replace(bare, F.lit('"'), F.lit("")))
    p = _before(pieces.withColumn("quotes", quotes), "quotes", "quoted")
    inside = F.col("quoted") % 2 == 1
    open_ = F.when(inside, F.concat(F.lit('"'), bare)).otherwise(bare)
    structure = F.regexp_replace(F.regexp_replace(open_, r'(?s)"[^"]*"', ""), r'(?s)"[^"]*$', "")
    p = _before(p.withColumn("change", _brackets(structure)).withColumn("closes", F.endswith(structure, F.lit("}"))), "change", "depth")
    ends = F.col("closes") & (F.col("depth") + F.col("change") == 1)
    p = _before(p.withColumn("ends", F.coalesce(ends, F.lit(False)).cast("long")), "ends", "nth")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "id", "text"))), lambda x: x["text"]), "")
    # the file's last piece makes a text of its own
    return p.groupBy("file", "nth").agg(
        whole.alias("text"), F.bool_or("last").alias("last"), F.max(F.struct("split", "id")).alias("at"), F.sum("change").alias("change")
    )


def array_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of files that are one JSON array each, as ``records.whole_array`` gives them, with the file.

    records: (file, line, v), ``line`` the element's place. What isn't an object is an issue; a file that isn't an array as a
    whole is one ``malformed_line`` and has no records. A byte order mark is skipped.
    """
    e = elements(spark, path)
    text = F.when(F.col("nth") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    first, last = F.col("nth") == 0, F.col("last")
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    opened = F.when(first, F.startswith(body, F.lit("["))).otherwise(F.startswith(body, F.lit(",")) | last)
    closed = ~last | F.endswith(body, F.lit("]"))
    comma = ~first & F.startswith(body, F.lit(","))
    inner = F.when(first | comma, F.substr(body, F.lit(2))).otherwise(body)
    inner = F.when(last, F.regexp_replace(inner, r"\]$", "")).otherwise(inner)
    blank = F.trim(F.regexp_replace(inner, r"\s", "")) == ""
    items = F.expr("cast(try_parse_json(concat('[', inner, ']')) as array<variant>)")
    e = e.withColumn("good", opened & closed & ~(comma & blank)).withColumn("blank", blank).withColumn("inner", inner)
    e = e.withColumn("items", F.when(F.col("good"), items))
    e = e.withColumn("good", F.col("good") & F.col("items").isNotNull() & (F.col("blank") == (F.size("items") == 0)))
    e = e.withColumn("n", F.when(F.col("good"), F.size("items")).otherwise(0).cast("long"))
    ok = e.groupBy("file").agg(
        F.bool_and("good").alias("whole"), F.sum("change").alias("left"), F.min_by("text", "nth").alias("begin")
    ).withColumn("whole", F.col("whole") & (F.col("left") == 0))
    placed = _before(e.select("file", "at.split", F.col("nth").alias("id"), "items", "n"), "n", "place")
    flat = placed.join(ok.where("whole").select("file"), "file", "left_semi").select("file", "place", F.posexplode("items").alias("k", "v"))
    flat = flat.select("file", (F.col("place") + F.col("k")).alias("line"), "v")
    is_object = F.coalesce(F.upper(F.substring(F.schema_of_variant("v"), 1, 6)) == "OBJECT", F.lit(False))
    said = lambda c: F.substring(F.col(c).cast("string"), 1, DETAIL).alias("detail")
    issues = flat.where(~is_object).select("file", "line", F.lit("skip_non_object_in_array").alias("kind"), said("v"))
    odd = ok.where(~F.col("whole")).select("file", F.lit(0).cast("long").alias("line"), F.lit("malformed_line").alias("kind"), said("begin"))
    return flat.where(is_object), issues.unionByName(odd)
