"""Profiles of columns and the clauses they suggest; one aggregation a profile."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shape_signature, string_pattern
from ..session import cut

QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


def numeric_profile(df: DataFrame, columns: list[str], sample_std: bool = False, exact: bool = False) -> DataFrame:
    """column_name, n, nulls, dropped, min, max, mean, p25 ... p99, stddev.

    Uncastable, infinite and NaN values are counted as dropped. Percentiles are
    sketched (to a rank of 1 in 10,000); ``exact=True`` finds them by rank in the
    column's order (see exact_quantiles), which sorts each column.
    """
    aggs = []
    for c in columns:
        v = F.col(c).try_cast("double")
        good = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
        q = F.percentile_approx(good, list(QUANTILES), 10000)
        std = F.stddev_samp(good) if sample_std else F.stddev_pop(good)
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(good).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"),
                F.count_if(F.col(c).isNotNull() & good.isNull()).alias("dropped"), F.min(good).alias("min"),
                F.max(good).alias("max"), F.avg(good).alias("mean"),
                *[q[i].alias(f"p{int(x * 100)}") for i, x in enumerate(QUANTILES)],
                F.coalesce(std, F.lit(0.0)).alias("stddev")
            ).alias(f"s_{c}")
        )
    out = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("r")).select("r.*")
    if not exact:
        return out
    names = [f"p{int(x * 100)}" for x in QUANTILES]
    return out.drop(*names).join(exact_quantiles(df, columns), "column_name", "left").select(out.columns)


def exact_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, p25 ... p99, interpolated linearly, of finite values.

    Values of a column are counted, ranged over partitions by Spark's sort, and
    ranked by the counts of the ranges before theirs: no task holds a column.
    """
    v = lambda c: F.col(c).try_cast("double")
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), v(c).alias("v")) for c in columns])).alias("r")
    ).select("r.*")
    long = long.where(~F.isnan("v") & (F.abs("v") != float("inf"))).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(long.repartitionByRange("column_name", "v").withColumn("part", F.spark_partition_id()))
    part = ranged.groupBy("column_name", "part").agg(F.sum("n").alias("size"))  # a row for each range of a column
    run = Window.partitionBy("column_name").orderBy("part")
    part = part.withColumn("before", F.sum("size").over(run) - F.col("size")).withColumn(
        "all", F.sum("size").over(Window.partitionBy("column_name"))
    )
    w = Window.partitionBy("column_name", "part").orderBy("v")
    last = F.sum("n").over(w) + F.col("before")
    at = ranged.join(
        F.broadcast(part.drop("size")), ["column_name", "part"]
    ).withColumn("last", last).withColumn("first", F.col("last") - F.col("n"))
    out = []
    for q in QUANTILES:
        place = q * (F.col("all") - 1)
        low, high = F.floor(place), F.ceil(place)
        pick = lambda r: F.max(F.when((F.col("first") <= r) & (F.col("last") > r), F.col("v")))
        share = F.max(place - low)
        out.append((pick(low) + (pick(high) - pick(low)) * share).alias(f"p{int(q * 100)}"))
    return at.groupBy("column_name").agg(*out)


def structural_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """column_name, dtype, null_fraction (1 if there are no rows), cardinality, and the rows.

    Cardinalities are sketched (2 % deviation); exact ones are counted column by column,
    each by a grouping that is combined before its shuffle.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    count = lambda c: F.approx_count_distinct(c, 0.02)
    aggs = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"),
            F.coalesce(F.round(F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))), 6), F.lit(1.0)).alias("null_fraction"),
            count(
                F.when(F.col(c).isNotNull(), F.to_json(F.struct(c))) if kinds[c].startswith(("struct", "map", "array")) else F.col(c)
            ).alias("cardinality"),
            F.count(F.lit(1)).alias("rows")
        ).alias(f"s_{c}") for c in columns
    ]
    out = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("r")).select("r.*")
    if not exact:
        return out
    # a column's scan reads that column alone, and each grouping is combined before its shuffle
    counted = [
        df.select(_as_text(df, c, signless=True).alias("v")).where("v is not null").distinct().agg(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("exact")
        ) for c in columns
    ]
    return out.join(reduce(DataFrame.unionAll, counted), "column_name", "left").withColumn(
        "cardinality", F.coalesce("exact", F.lit(0))
    ).select(out.columns)


def _as_text(df: DataFrame, c: str, signless: bool = False) -> Column:
    """A column's values as text, nested ones as JSON; ``signless`` makes -0.0 and 0.0 one value."""
    kind = dict(df.dtypes)[c]
    if kind.startswith(("struct", "map", "array")):
        return F.when(F.col(c).isNotNull(), F.to_json(F.struct(c)))
    return (F.col(c) + 0.0 if signless and kind in ("float", "double") else F.col(c)).cast("string")


def pattern_counts(df: DataFrame, value: Column) -> DataFrame:
    """(pattern, n) of a column's strings."""
    return df.where(value.isNotNull()).groupBy(string_pattern(value.cast("string")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def dominant_pattern(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """The commonest class of a column's strings; of equal counts the one that comes first by ``order``, else by name."""
    if order is None:
        return pattern_counts(df, F.col(column)).orderBy(F.desc("n"), "pattern").limit(1)
    kind = string_pattern(F.col(column).cast("string")).alias("pattern")
    p = df.where(F.col(column).isNotNull()).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return p.orderBy(F.desc("n"), "first").limit(1).drop("first")


def shape_samples(df: DataFrame, column: str, k: int | None = 5) -> DataFrame:
    """The ``k`` most frequent shapes, or all of them."""
    kind = dict(df.dtypes)[column]
    every = df.select(shape_signature(F.col(column), kind).alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    return every if k is None else every.orderBy(F.desc("n"), "shape").limit(k)


def confidence_flags(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).try_cast("double")
    one = df.agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"),
        F.count_if(F.col(column).isNotNull() & v.isNull()).alias("dropped")
    )
    flags = F.array_compact(
        F.array(
            F.when((F.col("lo") < 0) | (F.col("hi") > 1), "OUTSIDE_0_1_RANGE"),
            F.when(F.col("mean") > 0.99, "MEAN_GT_0_99_CLAMP_SUSPECT"),
            F.when(F.col("mean") < 0.01, "MEAN_LT_0_01_BROKEN_SUSPECT")
        )
    )
    return one.withColumn("flags", flags)


#: Distinct values of a text column that is an enum, at most.
ENUM = 10


def suggest_clauses(df: DataFrame) -> dict[str, dict]:
    """A schema from profiles: one small row for each column comes to the driver.

    One scan sketches all columns. Text columns whose sketch leaves it open that they are enums have their values
    gathered by a second scan, all at once: at most about twice ENUM for each.
    """
    kinds, out = dict(df.dtypes), {}
    contract_type = lambda k: "integer" if k in (
        "tinyint", "smallint", "int", "bigint"
    ) else "number" if k in ("float", "double") or k.startswith("decimal") else "boolean" if k == "boolean" else "array" if k.startswith("array") else "object" if k.startswith(("struct", "map")) else "string"
    shape = {r.column_name: r for r in structural_profile(df).collect()}
    few = [c for c in df.columns if kinds[c] == "string" and 0 < shape[c].cardinality <= 2 * ENUM]
    values = df.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict() if few else {}
    for r in (shape[c] for c in df.columns):
        name, clause = r.column_name, {"type": contract_type(kinds[r.column_name]), "required": r.null_fraction == 0.0}
        if "confidence" in name and clause["type"] == "number":
            clause |= {"minimum": 0.0, "maximum": 1.0}
        if name.endswith("_id") and clause["type"] == "string":
            clause |= {"format": "uuid"}
        if name.endswith("_at"):
            clause["format"] = "date-time"
        if 0 < len(values.get(name, ())) <= ENUM:
            clause["enum"] = sorted(values[name])
        out[name] = clause
    return out


#: Names of columns whose text is read as numbers.
NUMERIC_NAMES = ("confidence", "_ms", "sequence", "_tokens")
#: Values shown of a column.
SHOWN = 5


def is_numeric_name(name: str) -> bool:
    return any(part in name if part in ("confidence", "sequence") else name.endswith(part) for part in NUMERIC_NAMES)


def least_values(df: DataFrame, columns: list[str], k: int = SHOWN) -> DataFrame:
    """(column_name, v, k): the ``k`` least distinct values of each column as text.

    A task sends on no more than ``k`` values of a column, whatever it reads.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: pa.array([], pa.string()) for c in columns}
        for batch in batches:
            for c, v in zip(columns, batch.columns, strict=True):
                both = pa.chunked_array([held[c], v.cast(pa.string())]).unique().drop_null()
                held[c] = both.take(pc.array_sort_indices(both)[:k])
        names = pa.array([c for c in columns for _ in held[c]], pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.concat_arrays(held.values())], ["column_name", "v"])

    text = df.select(*[_as_text(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    seen = text.mapInArrow(least, "column_name string, v string").distinct()
    return seen.withColumn("k", F.row_number().over(Window.partitionBy("column_name").orderBy("v"))).where(F.col("k") <= k)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, null_fraction, distinct, samples (the least values as text), and numbers of numeric columns (with the sample deviation).

    Text columns whose name says that they are numbers are read so; ``dropped`` counts what can't be.
    """
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")
               or kinds[c].startswith("decimal") or (kinds[c] == "string" and is_numeric_name(c))]
    shape = structural_profile(df, columns).withColumnRenamed("cardinality", "distinct")
    first = least_values(df, columns)
    samples = first.groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("samples"))
    out = shape.join(samples, "column_name", "left")
    if numeric:
        numbers = numeric_profile(df, numeric, sample_std=True).drop("nulls")
        out = out.join(numbers, "column_name", "left")
    return out


def optional_where_coerced(schema: dict[str, dict], profiled: DataFrame) -> dict[str, dict]:
    """A suggested schema in which columns with values that can't be read are no longer required."""
    junk = {r.column_name for r in profiled.where("dropped > 0").select("column_name").collect()}  # a row for each column
    return {k: v | {"required": False} if k in junk else v for k, v in schema.items()}
