"""From failing checks to a violation log: consumers hit, lineage reached, commits to look at.

Every step carries the check: what one check's seeds reach says nothing of another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_time
from . import lineage, registry

#: Fixed limits of an entry's lists.
CAP_NODES, CAP_PIPELINES, CAP_BLAME, CAP_TARGETS = 40, 16, 5, 5


def seeds_with_fallback(checks: DataFrame, seeds: DataFrame, contract_seeds: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(check_id, node): a check's own seeds; without any, the contract's; without these, the first edge targets."""
    found = seeds.join(checks.select("check_id").distinct(), "check_id", "left_semi").select("check_id", "node").distinct()
    for other in (
        contract_seeds,
        edges.select(F.col("target").alias("node")).where("node is not null").distinct().orderBy("node").limit(CAP_TARGETS)
    ):
        if other is None:
            continue
        bare = checks.select("check_id").distinct().join(found.select("check_id").distinct(), "check_id", "left_anti")
        # a handful of stand-ins for each check without seeds
        few = other.select("node").distinct().orderBy("node").limit(CAP_NODES)
        found = found.unionByName(bare.crossJoin(F.broadcast(few)).select("check_id", "node"))
    return found


def first_nodes(reached: DataFrame, keep: Column, name: str, cap: int) -> DataFrame:
    """For each check the first ``cap`` nodes by hops, as a list."""
    w = Window.partitionBy("check_id").orderBy("hops", "node")
    first = reached.where(keep).withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    return first.groupBy("check_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias(name))


def violations(
    results: DataFrame, contract_id: str, subscriptions: DataFrame, edges: DataFrame, seeds: DataFrame,
    commits: DataFrame, depth: int = 2, contract_seeds: DataFrame | None = None
) -> DataFrame:
    """One row for each failing check.

    seeds: (check_id, node); a check without any starts at the nodes that its contract names (``contract_seeds``), else at
    the first targets of edges. commits: (node, path, committed, detected), and commit_hash and author
    where they are known, which the chain then names. The
    subscribers are the blast radius, lineage only enriches it; upstream nodes
    give candidates for blame, nearer and more recent commits first.
    """
    fails = results.where(F.col("status").isin("FAIL", "WARN", "ERROR")).select(
        F.lit(contract_id).alias("contract_id"), "check_id", "column_name", "severity", "records_failing"
    )
    hits = registry.blast_radius(fails.select("contract_id", "check_id", "column_name"), subscriptions)
    consumers = hits.groupBy("check_id").agg(F.array_sort(F.collect_set("subscriber_id")).alias("subscribers"))
    starts = seeds_with_fallback(fails, seeds, contract_seeds, edges)
    down = lineage.reach(starts, lineage.forward_edges(edges), depth, by=("check_id",)).where("hops > 0")
    up = lineage.reach(starts, lineage.reverse_edges(edges), depth, by=("check_id",))
    named = [c for c in ("commit_hash", "author") if c in commits.columns]
    ranked = lineage.rank_blame(up.join(commits, "node"), "check_id", "detected", "committed", "hops", "path", CAP_BLAME)
    ranked = ranked.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score", *named))).alias("blame_chain"))
    direct = first_nodes(down, F.col("hops") == 1, "direct_nodes", CAP_NODES)
    transitive = first_nodes(down, F.lit(True), "transitive_nodes", CAP_NODES)
    pipelines = first_nodes(down, F.startswith("node", F.lit("pipeline::")), "pipelines", CAP_PIPELINES)
    deepest = down.groupBy("check_id").agg(F.max("hops").alias("deepest"))
    out = fails
    for part in (consumers, ranked, direct, transitive, pipelines, deepest):
        out = out.join(part, "check_id", "left")
    none = F.array().cast("array<string>")
    for name in ("direct_nodes", "transitive_nodes", "pipelines"):
        out = out.withColumn(name, F.coalesce(name, none))
    out = out.withColumn("contamination_depth", F.coalesce("deepest", F.lit(0))).drop("deepest")
    return blame_summary(out.withColumn("registry_warning", F.when(F.col("subscribers").isNull(), "NO_SUBSCRIBERS_REGISTERED")))


def commits_of(nodes: DataFrame, log: DataFrame, detected: Column) -> DataFrame:
    """Commits of the files that nodes name, as ``violations`` takes them: log is ``sources.git.log``."""
    files = nodes.select(F.col("node"), lineage.repo_path(F.col("node")).alias("path")).where("path is not null").distinct()
    found = log.select("path", "commit_hash", "author", parse_time(F.col("commit_time")).alias("committed"))
    return files.join(found, "path").withColumn("detected", detected)


def blame_summary(violations_: DataFrame) -> DataFrame:
    """One line for each entry: the likeliest change, and how much likelier than the next one."""
    top, after = F.try_element_at("blame_chain", F.lit(1)), F.try_element_at("blame_chain", F.lit(2))
    said = F.format_string("Most likely %s (score %.2f", top["path"], top["score"])
    less = F.when(after.isNotNull(), F.format_string("; next %s, %.2f less)", after["path"], top["score"] - after["score"])).otherwise(")")
    return violations_.withColumn("blame_summary", F.when(top.isNull(), "No commit is known upstream.").otherwise(F.concat(said, less)))
