"""Mixing sources to target weights by entropy balancing.

A document of q words is given a rate r; the mix takes p = q r of its words. Of
all rates of at most CAP that meet the constraints, those wanted have the least
relative entropy of p to q. The constraints are

* for every source, its words sum to its target;
* for every moment (a column over ``size``, standardised over all words), the
  mix keeps the corpus' mean, to within RIDGE times its multiplier.

The rates are exponentially tilted, ``r = min(CAP, exp(lambda[source] + mu phi))``,
where lambda and mu are the optimum of a convex dual. Documents of one source and
size have one rate, so the dual is summed over a table of (source, size, count),
and Newton's iterations read that only. Sources are disjoint, so the Hessian is
an arrow: its diagonal stays a column by source, and only the Schur complement of
the moments, a matrix of their number, reaches the driver. Steps are halved as far
as the dual asks; ``residual`` is the largest relative violation that is left.

Rates become whole copies: each document gets floor(r), and the rest of a
source's target goes to the documents whose hash, divided by the fraction of
their rate, is least (order sampling: a document's chance is its fraction). FILL
more documents, each the largest that still fits, close most of what is missing.
So the copies of a document follow from its own row and its source's line alone:
no row is numbered, and texts aren't shuffled. Only the one hash bucket in which
a source's rest runs out is sorted, so a source of any share is spread out.

Targets stop at CAP times a source's size; the excess goes to the others by
weight. Null and blank texts have size 0 and take 0; a null source is a source,
the last in order. Rows equal in doc_id, source and text are taken alike. Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, ship

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton's iterations end when every constraint is met to this share of it.
TOLERANCE = 1e-8
ITERATIONS = 100
#: What a unit of a moment's multiplier costs, in means of the standardised moment.
RIDGE = 0.01
STEPS = (1.0, 0.5, 0.25, 0.125, 1 / 64, 1 / 1024)
FILL = 4
#: Sources up to this number are broadcast; of more, those of most rows are, and the rest is joined by shuffle.
FEW = 100_000
_NONE = 1e-9


def size_of(text: str | Column) -> Column:
    """Words: runs of characters other than space and \\t to \\r."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def log_size(size: Column) -> Column:
    return F.log1p(size.cast("double"))


def _few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``rank`` (from 0), by code point, null last: ranges are ranked, and moved on by the rows before them."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranged = cut(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    count = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}  # a row for each partition
    before, total = [0] * parts, 0
    for k in range(parts):
        before[k], total = total, total + count.get(k, 0)
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("rank", within + F.element_at(F.lit(before).cast("array<bigint>"), F.col("part") + 1)).drop("part")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size (other columns stay) -> also weight and target. One row for each source.

    Water level: source i gets min(cap * size, weight * level). The level rises
    from round to round, as sources that it fills leave the rest to the others.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    s = cut(_ranked(sources).withColumn("weight", w).withColumn("limit", F.col("source_size") * float(cap)).drop("rank"))
    total, level = s.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        full = F.col("limit") <= F.col("weight") * level
        held, rest = s.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (total - (held or 0.0)) / rest if rest else level
        if higher <= level:
            break
        level = higher
    return s.withColumn("target", F.least("limit", F.col("weight") * level)).drop("limit")


@dataclass
class Rates:
    """Multipliers of sources (goals: source, source_size, target, lam) and of moments."""

    goals: DataFrame
    mu: list[float]
    moments: list
    mean: list[float]
    spread: list[float]
    cap: int
    residual: float

    def phi(self, size: Column) -> list[Column]:
        return [(m(size) - F.lit(a)) / F.lit(s) for m, a, s in zip(self.moments, self.mean, self.spread, strict=True)]

    def rate(self, size: Column) -> Column:
        """Of a row with its source's goals; full sources have no multiplier."""
        tilt = F.col("lam")
        for m, f in zip(self.mu, self.phi(size), strict=True):
            tilt = tilt + F.lit(m) * f
        open_rate = F.least(F.lit(float(self.cap)), F.exp(tilt))
        return F.when(F.coalesce("target", F.lit(0.0)) <= 0, 0.0).otherwise(F.coalesce(open_rate, F.lit(float(self.cap))))


def entropy_rates(counted: DataFrame, goals: DataFrame, moments: tuple = (log_size,), cap: int = CAP) -> Rates:
    """Newton's iterations on the dual. counted: source, size, n; goals: source, source_size, target."""
    k, top = len(moments), float(np.log(cap))
    words = F.col("size") * F.col("n")
    stats = counted.agg(
        F.sum(words), *[F.sum(words * m(F.col("size"))) for m in moments],
        *[F.sum(words * m(F.col("size")) ** 2) for m in moments]
    ).first()
    total = float(stats[0] or 0) or 1.0
    mean = [(stats[1 + j] or 0.0) / total for j in range(k)]
    spread = [float(np.sqrt(max((stats[1 + k + j] or 0.0) / total - mean[j] ** 2, 0))) for j in range(k)]
    spread = [s if s > 1e-9 else 1.0 for s in spread]
    free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - _NONE))
    state = cut(goals.withColumn("lam", F.when(free, F.log(F.col("target") / F.col("source_size")))))
    out = Rates(state, [0.0] * k, list(moments), mean, spread, cap, 0.0)
    few = _few(state)
    flat = counted.select(F.col("source").alias("of"), "size", "n")

    def over(now: DataFrame) -> DataFrame:
        return flat.join(F.broadcast(now) if few else now, F.col("of").eqNullSafe(F.col("source"))).withColumn("q", words.cast("double"))

    phi = out.phi(F.col("size"))
    for _ in range(ITERATIONS):
        eta = F.col("lam")
        for j in range(k):
            eta = eta + F.lit(out.mu[j]) * phi[j]
        p = F.col("q") * out.rate(F.col("size"))
        bent = F.when(eta < top, p).otherwise(0.0)
        sums = [F.sum(p).alias("given"), F.sum(bent).alias("h")]
        sums += [F.sum(p * phi[j]).alias(f"m{j}") for j in range(k)] + [F.sum(bent * phi[j]).alias(f"b{j}") for j in range(k)]
        sums += [F.sum(bent * phi[i] * phi[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]
        seen = cut(over(state).groupBy("source", "source_size", "target", "lam").agg(*sums))
        open_, miss = F.col("lam").isNotNull(), F.col("given") - F.col("target")
        h = F.greatest(F.col("h"), F.col("source_size") * 1e-6)
        got = seen.agg(
            F.max(F.when(open_, F.abs(miss) / F.col("target"))), *[F.sum(f"m{j}") for j in range(k)], *[
                F.sum(F.when(open_, F.col(f"b{j}") * miss / h)) for j in range(k)
            ],
            *[
                F.sum(
                    F.col(f"c{i}_{j}") - F.when(open_, F.col(f"b{i}") * F.col(f"b{j}") / h).otherwise(0.0)
                ) for i in range(k) for j in range(k)
            ],
        ).first()
        at = lambda a, n, got=got: np.array([x or 0.0 for x in got[a : a + n]])
        mu = np.array(out.mu)
        slope = at(1, k) + RIDGE * total * mu
        out.residual = max([got[0] or 0.0, *(np.abs(slope) / total)])
        if out.residual <= TOLERANCE:
            out.goals = state
            return out
        d_mu = -np.linalg.solve(at(1 + 2 * k, k * k).reshape(k, k) + RIDGE * total * np.eye(k), slope - at(1 + k, k)) if k else np.zeros(0)
        pull = miss
        for j in range(k):
            pull = pull + F.col(f"b{j}") * float(d_mu[j])
        steps = seen.withColumn(
            "step", F.when(open_, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), -pull / h)))
        ).select("source", "source_size", "target", "lam", "step")
        # the dual at each length of the step, all in one pass
        duals = []
        for a in STEPS:
            e = F.col("lam") + a * F.col("step")
            for j in range(k):
                e = e + F.lit(float(mu[j] + a * d_mu[j])) * phi[j]
            duals.append(
                F.sum(
                    F.col("q") * (
                        F.when(e < top, F.exp(e)).otherwise(cap * (1 + e - top)) - (
                            F.col("lam") + a * F.col("step")
                        ) * F.col("target") / F.col("source_size")
                    )
                )
            )
        full = [F.sum(F.when(~open_, F.col("q") * out.cap * phi[j])) for j in range(k)]
        tried = over(steps).agg(*duals, *full).first()
        value = [
            (tried[i] or 0.0) + RIDGE * total / 2 * float(((mu + a * d_mu) ** 2).sum()) + float(
                ((mu + a * d_mu) * np.array([x or 0.0 for x in tried[len(STEPS) :]])).sum()
            ) for i,
            a in enumerate(STEPS)
        ]
        best = STEPS[int(np.argmin(value))]
        out.mu = [float(x) for x in mu + best * d_mu]
        state = cut(steps.select("source", "source_size", "target", (F.col("lam") + best * F.col("step")).alias("lam")))
    raise ArithmeticError(f"constraints are not met after {ITERATIONS} iterations: {out.residual}")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.xxhash64("text"))


def _rank() -> Column:
    """A document's place in the order of its source's rest: its hash over the fraction of its rate."""
    u = (F.shiftrightunsigned("key", 11).cast("double") + 0.5) / float(1 << 53)
    return F.when(F.col("part") > _NONE, u / F.col("part"))


def _with_rates(df: DataFrame, goals: DataFrame, rates: Rates) -> DataFrame:
    """df (source, size, key) with its source's goals, rate, whole copies, the rate's fraction and the rank."""
    one = lambda d, g: d.join(g, d.source.eqNullSafe(F.col("s"))).drop("s")
    goals = goals.withColumnRenamed("source", "s")
    if _few(goals):
        df = one(df, F.broadcast(goals))
    else:
        large = cut(goals.orderBy(F.desc("rows"), "s").limit(FEW))
        name = F.broadcast(large.select("s"))
        small = goals.join(large.select(F.col("s").alias("t")), F.col("s").eqNullSafe(F.col("t")), "left_anti")
        df = one(df, F.broadcast(large)).unionByName(one(df.join(name, df.source.eqNullSafe(F.col("s")), "left_anti"), small))
    df = df.withColumn("rate", rates.rate(F.col("size"))).withColumn("whole", F.floor(F.col("rate") + _NONE)).withColumn(
        "part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))
    )
    return df.withColumn("v", _rank())


def _fill():
    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        """Of a source's free documents, the largest of each size apart: those that fit what is missing."""
        gap, chosen = float(t["gap"].iloc[0]), []
        t = t.sort_values("size", ignore_index=True)
        size, keys = t["size"].to_numpy(), t["key"].to_numpy()
        left = np.ones(len(t), bool)
        for turn in range(FILL + 1):
            fits = np.flatnonzero(left & (size <= gap if turn < FILL else size < 2 * gap))
            if not len(fits):
                continue
            i = fits[np.argmin(np.abs(size[fits] - gap))]
            chosen.append(int(keys[i]))
            left[i] = False
            gap -= size[i]
        return pd.DataFrame({"source": [t["source"].iloc[0]], "chosen": [chosen]})

    return run


def plan(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, moments: tuple = (log_size,)) -> tuple[DataFrame, Rates]:
    """For each source what its documents need to know: target, multiplier, last rank of the rest, and the documents that fill up.

    sized (source, size, key) is read several times: it has to be stored.
    """
    ship(sized.sparkSession)
    counted = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    goals = cut(targets(sources, weights, cap).select("source", "source_size", "rows", "target"))
    rates = entropy_rates(counted.where("size > 0"), goals.drop("rows"), moments, cap)
    goals = goals.drop("source_size", "target").withColumnRenamed("source", "s").join(
        rates.goals, F.col("s").eqNullSafe(F.col("source"))
    ).drop("s")
    whole = counted.withColumnRenamed("source", "of").join(goals, F.col("of").eqNullSafe(F.col("source")))
    whole = whole.withColumn("rate", rates.rate(F.col("size"))).groupBy("source").agg(
        F.sum(F.floor(F.col("rate") + _NONE) * F.col("size") * F.col("n")).alias("sure")
    )
    goals = goals.withColumnRenamed("source", "s").join(whole, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn(
        "more", F.greatest(F.lit(0.0), F.col("target") - F.col("sure"))
    ).drop("sure")
    goals = cut(goals)

    every = _with_rates(sized.where("size > 0"), goals, rates)
    bucket = F.when(F.col("v") < 2, F.floor(F.col("v") * 2048)).otherwise(4096 + F.floor(F.log2("v") * 16)).cast("int")
    ranked = every.where("v is not null").select("source", "more", "size", "key", "v", bucket.alias("bucket"))
    filled = ranked.groupBy("source", "more", "bucket").agg(F.sum("size").alias("words"), F.max("v").alias("v"))
    run = Window.partitionBy("source").orderBy("bucket")
    filled = cut(filled.withColumn("upto", F.sum("words").over(run)))
    # buckets that fit wholly, then the documents of the next one
    sure = filled.where("upto <= more").groupBy("source").agg(
        F.max("bucket").alias("b"), F.max("v").alias("last"), F.max("upto").alias("got")
    )
    edge = filled.where("upto > more").groupBy("source").agg(F.min("bucket").alias("edge")).withColumnRenamed("source", "s")
    at = filled.select("source", "bucket", (F.col("upto") - F.col("words")).alias("before")).withColumnRenamed("source", "s2")
    edge = cut(edge.join(at, F.col("s").eqNullSafe(F.col("s2")) & (F.col("edge") == F.col("bucket"))).select("s", "edge", "before"))
    edge = F.broadcast(edge) if _few(edge) else edge
    inside = ranked.join(
        edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge"))
    ).groupBy("source", "more", "before", "v").agg(F.sum("size").alias("words"))
    inside = inside.withColumn(
        "upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("v"))
    ).where("upto <= more")
    last = sure.select("source", "last", "got").unionByName(
        inside.groupBy("source").agg(F.max("v").alias("last"), F.max("upto").alias("got"))
    )
    last = last.groupBy("source").agg(F.max("last").alias("last"), F.max("got").alias("got")).withColumnRenamed("source", "s")
    goals = cut(
        goals.join(
            last, F.col("source").eqNullSafe(F.col("s")), "left"
        ).drop("s").withColumn("gap", F.col("more") - F.coalesce("got", F.lit(0))).drop("got")
    )

    # documents that may still get one more copy: those of each size with the least key
    open_ = _with_rates(sized.where("size > 0"), goals, rates).where(
        f"gap > 0 and size < 2 * gap and whole < {cap} and target > 0 and (v is null or last is null or v > last)"
    )
    alone = open_.groupBy("source", "gap", "size", "key").count().where("count = 1")
    each = alone.groupBy("source", "gap", "size").agg(F.min("key").alias("key"))
    kind = sized.schema["source"].dataType.simpleString()
    filling = each.groupBy("source").applyInPandas(_fill(), f"source {kind}, chosen array<bigint>").withColumnRenamed("source", "s")
    goals = cut(goals.drop("more", "gap").join(filling, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    return goals, rates


def _copies(df: DataFrame, goals: DataFrame, rates: Rates) -> DataFrame:
    """df with ``copies``: each row's, by its source's line."""
    out = _with_rates(df, goals, rates)
    more = F.coalesce(F.col("v") <= F.col("last"), F.lit(False)) | F.coalesce(F.array_contains("chosen", F.col("key")), F.lit(False))
    whole = F.when(F.col("size") > 0, F.least(F.lit(rates.cap), F.col("whole") + more.cast("long"))).otherwise(0)
    return out.withColumn("copies", whole.cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, moments: tuple = (log_size,)) -> DataFrame:
    """doc_id, size, source_size, target, taken (and rate, copies) for each row."""
    sized = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), _key().alias("key"))
    )
    out = _copies(sized, *plan(sized.drop("doc_id"), weights, cap, moments))
    return out.select(
        "doc_id", "size", F.col("source_size").cast("long"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "rate", "copies"
    )


def take(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, moments: tuple = (log_size,)) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), "source", size_of(F.col("text")).alias("size"),
        _key().alias("key")
    )
    goals, rates = plan(cut(rows.drop("doc")), weights, cap, moments)
    chosen = _copies(rows, goals, rates).where("copies > 0")
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
