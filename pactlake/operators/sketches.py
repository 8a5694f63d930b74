"""Profiles that are kept: a part of a table is read once, profiles of the whole are merged from the parts'.

A part leaves one row a column: counts, moments, a KLL sketch of its numbers and an HLL sketch of its
distinct values. All of it merges, so a new day costs a scan of that day, and any set of
days has a profile without a scan. Counts, least, greatest, mean and deviation are exact; quantiles are
within RANK of their rank, cardinalities within a few times CARDINALITY (a standard error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import moments
from .profile import QUANTILES

#: Size of the KLL sketches and what they promise of ranks; registers of the HLL sketches and their relative error.
KLL, RANK = 1000, 0.01
HLL, CARDINALITY = 12, 0.02
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
KIND = (
    "column string, rows long, nulls long, dropped long, n long, mean double, m2 double, min double, max double, kll binary, hll binary"
)
_NAMES = [x.split()[0] for x in KIND.split(", ")]


def _number(df: DataFrame, c: str, numeric: list[str]) -> Column:
    kind = dict(df.dtypes)[c]
    if kind in NUMBERS or kind.startswith("decimal") or c in numeric:
        v = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return F.lit(None).cast("double")


def _value(df: DataFrame, c: str) -> Column:
    kind, v = dict(df.dtypes)[c], F.col(f"`{c}`")
    if kind.startswith(("struct", "map", "array")):
        v = F.when(v.isNotNull(), F.to_json(F.struct(v)))
    return F.when(v.isNotNull(), F.xxhash64(v))


def sketch(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, numeric: tuple[str, ...] = ()) -> DataFrame:
    """A row for each column (and group): one scan, one small row a task and column.

    ``numeric`` names text columns that are read as numbers; ``dropped`` counts values that aren't finite numbers.
    """
    keys, rows = by or [], []
    columns = columns or [c for c in df.columns if c not in keys]
    for c in columns:
        v, there = _number(df, c, list(numeric)), F.col(f"`{c}`").isNotNull()
        n, asked = F.count(v), dict(df.dtypes)[c] in NUMBERS or dict(df.dtypes)[c].startswith("decimal") or c in numeric
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(~there).alias("nulls"),
                (F.count_if(there & v.isNull()) if asked else F.lit(0).cast("long")).alias("dropped"), n.alias("n"), F.avg(v).alias("mean"),
                (F.var_pop(v) * n).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
                (F.kll_sketch_agg_double(v, F.lit(KLL)) if asked else F.lit(None).cast("binary")).alias("kll"),
                F.hll_sketch_agg(_value(df, c), F.lit(HLL)).alias("hll")
            )
        )
    one = df.groupBy(*keys).agg(F.array(*rows).alias("r"))
    return one.select(*keys, F.explode("r").alias("r")).select(*keys, "r.*").where("rows > 0")


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The parts' rows as rows of their union; merging merged rows again gives the same."""
    keys = [*(by or []), "column"]
    numbers = moments.merged(parts.where("n > 0"), by)
    rest = parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("dropped").alias("dropped"),
        F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll")
    )
    return rest.join(numbers, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def profile(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """column_name, rows, nulls, null_fraction, dropped, cardinality, n, min, max, mean, stddev, p25 ... p99."""
    out = merged(parts, by)
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(q)))
    return out.select(
        *(by or []), F.col("column").alias("column_name"), "rows", "nulls", F.round(F.col("nulls") / F.col("rows"), 6).alias("null_fraction"), "dropped",
        F.hll_sketch_estimate("hll").alias("cardinality"), "n", "min", "max", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("stddev"),
        *[at(q).alias(f"p{int(q * 100)}") for q in QUANTILES]
    )


class Store:
    """Sketches of a table's parts in a folder. A part that is taken again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def take(self, part: str, df: DataFrame, columns: list[str] | None = None, numeric: tuple[str, ...] = ()) -> None:
        """Profile one part: only ``df`` is read."""
        sketch(df, columns, numeric=numeric).select(_NAMES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/part={part}")

    def parts(self) -> DataFrame:
        """Rows of all parts, with the part's name."""
        return self.spark.read.schema(f"{KIND}, part string").parquet(self.path)

    def profile(self, *parts: str) -> DataFrame:
        """The profile of the parts named, or of all: no part's data are read."""
        found = self.parts()
        return profile((found.where(F.col("part").isin(*parts)) if parts else found).drop("part"))
