"""Lineage graphs: adjacency, bounded searches, consumers, blame."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import recency_score
from ..session import cut

FORWARD = ("PRODUCES", "WRITES", "CONSUMES")
RELATIONSHIPS = ("IMPORTS", "CALLS", "READS", "WRITES", "PRODUCES", "CONSUMES")


def forward_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relationship").isin(*FORWARD)).select("source", "target").distinct()


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relationship").isin(*RELATIONSHIPS)).select(
        F.col("target").alias("source"), F.col("source").alias("target")
    ).distinct()


def reach(seeds: DataFrame, edges: DataFrame, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, hops) within ``depth`` steps of seeds (*by, node), each with its fewest hops; cycles end.

    One join for each step: a frontier only goes on with nodes not seen before.
    It is stored after each step, so the plan stays as small whatever the depth.
    """
    keys = [*by, "node"]
    frontier = cut(seeds.select(*keys, F.lit(0).alias("hops")).where("node is not null").distinct())
    seen = frontier
    for d in range(1, depth + 1):
        step = frontier.join(
            edges, F.col("node") == F.col("source")
        ).select(*by, F.col("target").alias("node")).where("node is not null").distinct()
        known = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        frontier = cut(
            step.join(seen.select(*[F.col(k).alias(f"__{k}") for k in keys]), known, "left_anti").select(*keys, F.lit(d).alias("hops"))
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _classes(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys with equal sets of nodes as one class: (key, class), (class, node) once for each class, and (class, n, pipelines).

    A class is known by its set's size and two sums of hashes. Where different sets met in one class, it would
    hold more nodes than its size says, so that is checked and not left to chance.
    """
    rows = cut(rows.select(key, "node").where("node is not null").distinct())
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("y")]
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *marks)
    found = cut(found.select(key, F.struct("n", "x", "y").alias("class")))
    held = cut(rows.join(found, key).select("class", "node").distinct())
    sizes = cut(held.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.startswith("node", F.lit("pipeline::"))).alias("pipelines")))
    if not sizes.where("n <> class.n").isEmpty():
        raise ValueError("different sets of nodes have the same hashes")
    return found, held, sizes


def counts_below(seeds: DataFrame, edges: DataFrame, depth: int, by: str) -> DataFrame:
    """(by, n_nodes, n_pipelines, hops): how much ``reach`` would find beyond the seeds (by, node), without a row for each of it.

    What a set of nodes leads to in one step depends on the set alone, so seeds that lead to the same set are one class from
    there on: a hub's successors are listed once, not once for each seed above it. A step's nodes that an earlier step
    had are subtracted: only nodes found in several steps are looked up for that. Work and memory grow with the distinct sets'
    sizes; where no two seeds ever lead to the same set, that is as much as ``reach``.
    """
    start, held, _ = _classes(seeds, by)
    levels, onward, sizes = [held], [], []
    for _ in range(depth):
        step = levels[-1].join(edges, F.col("node") == F.col("source")).select("class", F.col("target").alias("node"))
        following, held, size = _classes(step.withColumnRenamed("class", "before"), "before")
        if held.isEmpty():
            break
        levels.append(held)
        onward.append(following)
        sizes.append(size)
    places = [h.select("node").distinct().select("node", F.lit(k).alias("step")) for k, h in enumerate(levels)]
    several = cut(functools.reduce(DataFrame.unionByName, places).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"))
    again = not several.isEmpty()
    if not sizes:
        return start.select(by, F.lit(0).cast("long").alias("n_nodes"), F.lit(0).cast("long").alias("n_pipelines"), F.lit(0).alias("hops")).limit(0)
    # (class, step, n, pipelines): what is found from a class on, the last step's classes first; seeds have rows of their own only if nodes come again
    total = None
    for j in reversed(range(0 if again else 1, len(levels))):
        parts = [sizes[j - 1].select("class", F.lit(j).alias("step"), "n", "pipelines")] if j else []
        if total is not None:
            parts.append(onward[j].join(total, "class").select(F.col("before").alias("class"), "step", "n", "pipelines"))
        met, chain = [], levels[j].join(several, "node", "left_semi").withColumn("at", F.col("class"))
        for k in range(j + 1, len(levels) if again else 0):
            chain = chain.join(onward[k - 1].select(F.col("before").alias("at"), F.col("class").alias("next")), "at").drop("at").withColumnRenamed("next", "at")
            met.append(chain.join(levels[k].select(F.col("class").alias("at"), "node"), ["at", "node"], "left_semi").select("class", "node", F.lit(k).alias("step")))
        if met:  # a node that comes again is no new one at its next time
            first = functools.reduce(DataFrame.unionByName, met).groupBy("class", "node").agg(F.min("step").alias("step"))
            parts.append(first.select("class", "step", F.lit(-1).alias("n"), F.when(F.startswith("node", F.lit("pipeline::")), -1).otherwise(0).alias("pipelines")))
        total = functools.reduce(DataFrame.unionByName, parts).groupBy("class", "step").agg(F.sum("n").alias("n"), F.sum("pipelines").alias("pipelines"))
        total = cut(total) if again else total
    found = total.groupBy("class").agg(
        F.sum("n").alias("n_nodes"), F.sum("pipelines").alias("n_pipelines"), F.max(F.when(F.col("n") > 0, F.col("step"))).alias("hops")
    ).where("n_nodes > 0")
    if not again:
        found = onward[0].join(found, "class").drop("class").withColumnRenamed("before", "class")
    return start.join(found, "class").select(by, "n_nodes", "n_pipelines", "hops")


def table_consumers(edges: DataFrame) -> DataFrame:
    e = edges.where((F.col("relationship") == "CONSUMES") & F.startswith("source", F.lit("table::")))
    return e.select(F.col("source").alias("table"), F.col("target").alias("pipeline")).distinct().orderBy("table", "pipeline")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge with an unknown end, and once more if its relationship is unknown."""
    ids = nodes.select(F.col("node_id").alias("__id")).distinct()
    bad = None
    for end in ("source", "target"):
        miss = edges.join(ids, F.col(end).eqNullSafe(F.col("__id")), "left_anti").select("source", "target", "relationship")
        bad = miss if bad is None else bad.unionByName(miss)
    bad = bad.distinct().withColumn("problem", F.lit("endpoint"))
    odd = edges.where(
        ~F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False))
    ).select("source", "target", "relationship").withColumn("problem", F.lit("relationship"))
    return bad.unionByName(odd)


def rank_blame(candidates: DataFrame, per: str, detected: str, committed: str, hops: str, path: str, cap: int = 5) -> DataFrame:
    """Commits scored by recency and distance; the best few of each violation, with the next one's score."""
    s = candidates.withColumn("score", F.round(recency_score(F.col(detected), F.col(committed), F.col(hops)), 6))
    w = Window.partitionBy(per).orderBy(F.desc("score"), path)
    return s.withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w)).where(F.col("rank") <= cap)


def parse_git_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``hash|author|email|time|subject`` lines as commits."""
    p = F.split(column, r"\|", 5)
    return lines.where(F.size(p) == 5).select(
        p[0].alias("commit_hash"), p[1].alias("author"), p[2].alias("email"), p[3].alias("commit_time"),
        p[4].alias("subject")
    )


def nearest(reached: DataFrame, cap: int = 80) -> DataFrame:
    """The ``cap`` nodes with the fewest hops, for reports with a limit."""
    return reached.orderBy("hops", "node").limit(cap)


#: Letters of the pieces by which keywords find nodes.
GRAM = 3


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct pieces of n letters of a text; a shorter text is one piece."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def containing(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Pairs of rows of ``texts`` and ``words`` where the text contains the word, whatever stands around it.

    No text is compared with every word: a word is looked up by that one of its pieces that the fewest texts hold, an
    equality, and what shares it is confirmed on the whole word. Pieces are of GRAM letters; shorter words
    have an index of their own length. Words come once, empty and null ones not at all.
    """
    out = None
    lengths = {n: F.char_length(word) == n for n in range(1, GRAM)} | {GRAM: F.char_length(word) >= GRAM}
    for n, fits in lengths.items():
        asked = words.where(fits).select(F.col(word).alias("__w")).distinct().select("__w", F.explode(grams(F.col("__w"), n)).alias("__g"))
        indexed = texts.select(F.explode(grams(F.col(text), n)).alias("__g"))
        # pieces that no text holds aren't counted: their words are in no text
        held = indexed.join(asked.select("__g").distinct(), "__g", "left_semi").groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
        rarest = asked.join(held, "__g", "left").groupBy("__w").agg(
            F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g")
        )
        hit = texts.withColumn("__g", F.explode(grams(F.col(text), n))).join(rarest, "__g").where(F.contains(F.col(text), F.col("__w")))
        found = hit.drop("__g").join(words.withColumnRenamed(word, "__w"), "__w").withColumnRenamed("__w", word)
        out = found if out is None else out.unionByName(found)
    return out


def keyword_seeds(failures: DataFrame, nodes: DataFrame, topics: DataFrame, cap: int = 24, named: DataFrame | None = None) -> DataFrame:
    """(check_id, node): nodes whose id holds a keyword of a topic that the failure's names touch.

    topics: (trigger, keyword). A keyword may stand anywhere in the id, within other words too. Where no node fits,
    the nodes that the contract names (``named``) stand in; without these, files and extraction nodes, the first eight by id.
    """
    said = F.lower(F.concat_ws(" ", "check_id", "column_name"))
    asked = failures.select("check_id", said.alias("said")).distinct()
    touched = containing(asked, "said", topics.select(F.lower("trigger").alias("trigger"), F.lower("keyword").alias("keyword")), "trigger")
    words = touched.select("check_id", "keyword").distinct()
    known = nodes.select(F.col("node_id").alias("node"), F.lower("node_id").alias("low")).where("node is not null").distinct()
    hit = containing(known, "low", words, "keyword").select("check_id", "node").distinct()
    hit = hit.withColumn("k", F.row_number().over(Window.partitionBy("check_id").orderBy("node"))).where(F.col("k") <= cap).drop("k")
    other = known.where(
        F.startswith("node", F.lit("file::")) | F.contains("low", F.lit("extract"))
    ).select("node").distinct().orderBy("node").limit(8)
    every = failures.select("check_id").distinct()
    for few in ([] if named is None else [named.select("node").where("node is not null").distinct().orderBy("node").limit(cap)]) + [other]:
        bare = every.join(hit.select("check_id").distinct(), "check_id", "left_anti")
        # at most ``cap`` stand-ins for each check that found none
        hit = hit.unionByName(bare.crossJoin(F.broadcast(few)).select("check_id", "node"))
    return hit


def repo_path(node: Column) -> Column:
    """The path that a ``file::`` or ``pipeline::`` node names; null for other kinds."""
    p = F.split(node, "::", 2)
    return F.when((F.size(p) == 2) & p[0].isin("file", "pipeline"), F.nullif(F.try_element_at(p, F.lit(2)), F.lit("")))


def commit_scores(files: DataFrame, commits: DataFrame, detected: Column, snapshot_rev: str | None = None) -> DataFrame:
    """files (check_id, path, hops) with their commits (path, commit_hash, author, commit_time); the snapshot's revision if a file has none."""
    rev = F.lit(snapshot_rev).cast("string")
    rev = F.when(rev.rlike("(?i)^[0-9a-f]{7,40}$"), rev)
    j = files.join(commits, "path", "left").withColumn("commit_hash", F.coalesce("commit_hash", rev)).where("commit_hash is not null")
    return j.withColumn(
        "score", F.round(recency_score(detected, F.col("commit_time"), F.col("hops")), 6)
    ).dropDuplicates(["check_id", "commit_hash", "path"])


#: Fixed limits of lists of consumers: of one table, and of a whole graph.
CAP_CONSUMERS, CAP_GENERIC = 25, 15


def pipeline_targets(edges: DataFrame) -> DataFrame:
    """Distinct pipelines that something feeds, in order."""
    return edges.where(F.startswith("target", F.lit("pipeline::"))).select(F.col("target").alias("pipeline")).distinct().orderBy("pipeline")


def downstream_of(edges: DataFrame, table: str, cap: int = CAP_CONSUMERS) -> DataFrame:
    """The first consumers of a table."""
    return table_consumers(edges).where(F.col("table") == table).select("pipeline").limit(cap)


def downstream_generic(edges: DataFrame, cap: int = CAP_GENERIC) -> DataFrame:
    """The first consumers of anything, for contracts that lineage has no table of."""
    return edges.where("relationship = 'CONSUMES'").select(F.col("target").alias("pipeline")).distinct().orderBy("pipeline").limit(cap)


def lineage_section(consumers: DataFrame, instruction: str | None = None) -> dict:
    """A contract's lineage part: its consumers (a bounded list), and a word on what to do with them."""
    out = {"downstream": [{"id": r.pipeline} for r in consumers.limit(CAP_CONSUMERS).collect()]}
    return out | ({"instruction": instruction} if instruction else {})


def contract_seeds(contract: dict, edges: DataFrame) -> DataFrame:
    """Nodes that a contract itself names: those of its lineage that the graph has."""
    spark = edges.sparkSession
    part = contract.get("lineage") or {}
    named = [str(x.get("id")) for x in [*(part.get("downstream") or []), *(part.get("upstream") or [])]]
    names = spark.createDataFrame([(n,) for n in named], "node string")
    every = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return every.join(F.broadcast(names), "node", "left_semi")
