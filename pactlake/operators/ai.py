"""Checks of AI data: texts to embed, prompt envelopes, output rates, embedding drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift

#: Fixed limits of a prompt envelope: least and most characters of its keys.
PROMPT_LIMITS = {"doc_id": (8, 64), "source_path": (1, None), "content_preview": (0, 8000)}
PREVIEW = 8000
FALLBACK = 4000


def embedding_texts(
    df: DataFrame, facts: str = "extracted_facts",
    fallbacks: tuple = ("document_name", "source_path", "notes", "strategy_sequence")
) -> DataFrame:
    """Trimmed texts of facts; for rows without any, the fallback columns, lists as JSON cut to FALLBACK characters."""
    kinds = dict(df.dtypes)
    said = lambda c: F.when(
        F.size(c) > 0, F.substring(F.to_json(c), 1, FALLBACK)
    ) if kinds[c].startswith("array") else F.trim(F.col(c).cast("string"))
    texts = F.filter(
        F.transform(F.coalesce(F.col(facts), F.array()), lambda f: F.trim(f["text"])),
        lambda t: F.coalesce(t != "", F.lit(False))
    )
    other = F.filter(F.array(*[said(c) for c in fallbacks if c in df.columns]), lambda t: F.coalesce(t != "", F.lit(False)))
    return df.select(F.explode(F.when(F.size(texts) > 0, texts).otherwise(other)).alias("text"))


def prompt_envelopes(df: DataFrame) -> DataFrame:
    """doc_id, source_path and a preview: the name, else the source, else the row as JSON."""
    said = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    preview = F.coalesce(said("document_name"), said("source_path"), F.to_json(F.struct(*df.columns)))
    return df.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.coalesce(said("source_path"), F.lit("(unknown)")).alias("source_path"),
        F.substring(preview, 1, PREVIEW).alias("content_preview")
    )


def prompt_errors(extra: Column | None = None) -> Column:
    """The first rule a prompt envelope breaks, or null."""
    error = F.lit(None).cast("string")
    if extra is not None:
        error = F.when(F.size(extra) > 0, F.concat(F.lit("unknown key "), extra[0])).otherwise(error)
    for k, (lo, hi) in reversed(PROMPT_LIMITS.items()):
        n = F.char_length(k)
        if hi is not None:
            error = F.when(n > hi, f"{k} is too long").otherwise(error)
        error = F.when(n < lo, f"{k} is too short").otherwise(error)
        error = F.when(F.col(k).isNull(), f"{k} is missing").otherwise(error)
    return error


def validate_prompts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with ``error``): all keys are there, of their lengths, and no others."""
    extra = sorted(set(df.columns) - set(PROMPT_LIMITS))
    there = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in extra]), lambda c: c.isNotNull()) if extra else None
    marked = df.withColumn("error", prompt_errors(there))
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def metric_field(df: DataFrame) -> str:
    """``recommendation`` if enough rows have one, else ``event_type``."""
    if "recommendation" not in df.columns:
        return "event_type"
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count("recommendation").alias("k")).first()
    return "recommendation" if r.k >= max(3, min(r.n, r.n // 4 or 1)) else "event_type"


def embedding_drift(vectors: DataFrame, column: str, baseline: list[float] | None, threshold: float = 0.15, least: int = 10) -> DataFrame:
    """status, drift, n, centroid: one row. Without a baseline the centroid becomes it; too few vectors decide nothing."""
    n = vectors.agg(F.count(column).alias("n"))
    now = drift.centroid(vectors, column)
    j = n.crossJoin(F.broadcast(now)) if baseline is None else n.crossJoin(F.broadcast(now)).withColumn(
        "base", F.array(*[F.lit(float(x)) for x in baseline])
    )
    enough = F.col("n") >= least
    if baseline is None:
        return j.select(
            F.when(enough, "BASELINE_SET").otherwise("INSUFFICIENT_DATA").alias("status"), F.lit(0.0).alias("drift"),
            "n", "centroid"
        )
    d = 1 - drift.cosine(F.col("centroid"), F.col("base"))
    status = F.when(~enough, "INSUFFICIENT_DATA").when(
        F.size("centroid") != F.size("base"), "WARN"
    ).when(d > threshold, "FAIL").otherwise("PASS")
    return j.select(status.alias("status"), F.when(F.size("centroid") == F.size("base"), d).alias("drift"), "n", "centroid")


def local_vectors(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """(key, vector): the offline embedding, a histogram of a text's first 50,000 bytes to length 1 (see drift.byte_histogram)."""
    name = key or "__k"
    rows = df if key else df.withColumn("__k", F.monotonically_increasing_id())
    h = drift.byte_histogram(rows, name, text, 50_000).groupBy(name).agg(F.map_from_entries(F.collect_list(F.struct("byte", "share"))).alias("m"))
    bins = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    return h.select(*([name] if key else []), bins.alias("vector"))


#: Providers of embeddings: name -> function of (DataFrame, text column) that adds ``vector``. Others are registered by the caller.
PROVIDERS = {"local": local_vectors}


def vectors(df: DataFrame, text: str = "text", backend: str = "auto") -> tuple[DataFrame, str]:
    """Vectors of texts and the backend that made them. ``auto`` takes a registered provider before the local one."""
    if backend == "auto":
        backend = next((k for k in PROVIDERS if k != "local"), "local")
    if backend not in PROVIDERS:
        raise KeyError(f"no provider of embeddings named {backend!r}")
    return PROVIDERS[backend](df, text), backend


def embedding_check(
    df: DataFrame, baseline: list[float] | None, backend: str = "auto", sample: int = 200, threshold: float = 0.15
) -> DataFrame:
    """Embedding drift of a table's texts, end to end: texts, a sample by hash, vectors, distance of centroids."""
    texts = embedding_texts(df)
    chosen = texts.orderBy(F.xxhash64("text"), "text").limit(sample)
    made, used = vectors(chosen, "text", backend)
    return embedding_drift(made, "vector", baseline, threshold).withColumn("backend", F.lit(used))


def annotated(columns: DataFrame, provider=None) -> DataFrame:
    """Column names and types with ``annotation`` from a provider (names and types -> texts, on the driver); null without one.

    No value leaves the data.
    """
    if provider is None:
        return columns.withColumn("annotation", F.lit(None).cast("string"))
    rows = [(r.column_name, r.dtype) for r in columns.select("column_name", "dtype").collect()]  # a row for each column of a table
    said = provider(rows)
    table = columns.sparkSession.createDataFrame([(k, said.get(k)) for k, _ in rows], "column_name string, annotation string")
    return columns.join(F.broadcast(table), "column_name", "left")


def log_rows(checks: DataFrame, at: Column) -> DataFrame:
    """Entries of the violation log for AI checks (check, status, detail) that call for one."""
    return checks.where(should_log(F.col("status"))).select(at.alias("logged_at"), "check", F.upper("status").alias("status"), "detail")


def should_log(status: Column) -> Column:
    return F.upper(status).isin("FAIL", "WARN", "ERROR")
