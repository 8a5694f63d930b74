"""Near-duplicates by chosen-path set similarity join.

Documents are sets of five-word shingles. A pool of ``POOL`` minwise tokens is
drawn for each distinct set. Independent trees branch on selected tokens: a
root branches on one coordinate of the pool, an inner node on ``BRANCHES``
coordinates chosen by the node's own path, so that sets with a common token
follow the same branch. Nodes of at most ``LEAF`` sets are compared
exhaustively by their pools; larger ones branch again, unless SAME of their sets
are like their smallest one: these, and those still large at the last level, are
joined whole. ``TREES`` trees bring the recall of a pair
at similarity 0.75 above 0.999 (a pair of sets survives a root with
probability equal to its similarity).

The pools only say which sets to confirm: sets that they join form a family,
and within a family every pair not yet connected is compared on the full sets.
A family too large for one task is dealt into chunks that all hold its smallest
member; sets that don't connect to it in their chunk are compared with every
chunk. So memory stays bounded and no confirmed link is lost.

Equal sets are one class, held by its smallest doc_id. Null or blank texts have
no shingles and are linked with nothing. Rows with a null doc_id are linked with
nothing, either: their component is null, and they are kept. Rows that share a
doc_id are one vertex. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, key_groups, map_arrow, raw, release, slices, texts
from ._bytes import shingle_sets
from .components import components

POOL, TREES, BRANCHES, LEAF, LEVELS = 64, 10, 3, 64, 4
SAME, PROBE = 0.8, 16
#: Pools agree in at least this share of coordinates, five deviations below 0.75.
PLAUSIBLE = 0.45
#: Sets and shingles of a chunk of a family.
CHUNK_SETS, CHUNK_SHINGLES = 1024, 2_000_000
SLICE = 1 << 20
#: Links: 100 * common >= PERCENT * union.
PERCENT = 75

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 31, POOL, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, POOL, dtype=np.uint32)
_ROOTS = [int(x) for x in _rng.permutation(POOL)[:TREES]]


def pool_of(s: np.ndarray) -> np.ndarray:
    """Minima of POOL hash functions over a set of 64-bit hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(POOL, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, ((x[None, i : i + 4096] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=out)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw(texts(batch))
        n, digest, pool = [], [], []
        for i, j in slices(offs, SLICE):
            for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                pool.append(pool_of(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(pool, pa.binary())],
            ["doc_id", "n", "digest", "pool"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw(texts(batch))
        out = []
        for i, j in slices(offs, SLICE):
            out += [s.tobytes() for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(out, pa.binary())],
            [*names, "shingles"]
        )


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _compare_pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves, sorted by node: an edge from each set to the one that reached it first."""
    out = []
    for t in key_groups(batches, "node"):
        ids = t.column("doc").to_numpy()
        pools = np.frombuffer(b"".join(t.column("pool").to_pylist()), np.uint32).reshape(-1, POOL)
        left, queue = np.arange(len(ids)), []
        while len(left):
            k = queue.pop() if queue else None
            if k is None:
                k, left = left[0], left[1:]
            near = (pools[left] == pools[k]).sum(1) >= PLAUSIBLE * POOL
            if near.any():
                got = left[near]
                out.append((np.full(len(got), ids[k]), ids[got]))
                queue += got.tolist()
                left = left[~near]
        if len(out) > 4096:
            yield _edges(out)
            out = []
    yield _edges(out)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sets, sorted by part: who is connected by links on the full sets, as edges from the smallest id."""
    out = []
    for t in key_groups(batches, "part"):
        ids = t.column("doc").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        left = np.flatnonzero(size > 0)
        while len(left):
            queue, left = [left[0]], left[1:]
            found = [queue[0]]
            while queue and len(left):
                s = sets[queue.pop()]
                n = size[left]
                fit = left[100 * np.minimum(n, len(s)) >= PERCENT * np.maximum(n, len(s))]
                if not len(fit):
                    continue
                every = np.concatenate([sets[i] for i in fit])
                at = np.searchsorted(s, every)
                hit = s[np.minimum(at, len(s) - 1)] == every
                common = np.add.reduceat(hit, np.cumsum(size[fit]) - size[fit], dtype=np.int64)
                got = fit[100 * common >= PERCENT * (size[fit] + len(s) - common)]
                if len(got):
                    queue += got.tolist()
                    found += got.tolist()
                    left = np.setdiff1d(left, got, assume_unique=True)
            if len(found) > 1:
                mine = np.unique(ids[found])
                out.append((np.full(len(mine) - 1, mine[0]), mine[1:]))
        if len(out) > 4096:
            yield _edges(out)
            out = []
    yield _edges(out)


def _trees(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (node, doc) and edges of nodes that stay large."""
    token = lambda c: F.expr(f"substring(pool, {4 * c + 1}, 4)")
    nodes = reps.select(F.col("doc"), F.explode(F.array(*[F.xxhash64(F.lit(t), token(c)) for t, c in enumerate(_ROOTS)])).alias("node"))
    leaves, rest = [], []
    alike = F.expr(
        f"aggregate(sequence(0, {PROBE - 1}), 0, (n, i) -> n + cast(substring(pool, 4 * i + 1, 4) = substring(least_pool, "
        f"4 * i + 1, 4) as int)) >= {PLAUSIBLE * PROBE}"
    )
    for level in range(LEVELS):
        size = nodes.groupBy("node").agg(
            F.count("*").alias("n"), F.min("doc").alias("least"),
            F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("members")
        )
        size = cut(size.where("n > 1"))
        # trees often find the same members; one node for each set of members is enough
        small = size.where(F.col("n") <= LEAF).groupBy("n", "members").agg(F.min("node").alias("node"))
        leaves.append(cut(nodes.join(small.select("node"), "node").select("node", "doc")))
        big = size.where(F.col("n") > LEAF).select("node", "least")
        if big.isEmpty():
            break
        large = nodes.join(big, "node")
        if level < LEVELS - 1:
            least = big.join(
                reps.select(F.col("doc").alias("least"), F.col("pool").alias("least_pool")), "least"
            ).select("node", "least_pool")
            large = cut(
                large.join(reps.select("doc", "pool"), "doc").join(least, "node").select(
                    "node", "doc", "least", "pool", alike.alias("alike")
                )
            )
            one = cut(
                large.groupBy("node").agg(F.avg(F.col("alike").cast("int")).alias("share")).where(F.col("share") >= SAME).select("node")
            )
            rest.append(large.join(one, "node", "left_semi").select("least", "doc"))
            child = F.explode(
                F.array(
                    *[
                        F.xxhash64(
                            F.col("node"), F.lit(i),
                            F.expr(f"substring(pool, 4 * cast(pmod(xxhash64(node, {i}), {POOL}) as int) + 1, 4)")
                        ) for i in range(BRANCHES)
                    ]
                )
            )
            nodes = cut(large.join(one, "node", "left_anti").select("doc", child.alias("node")))
        else:
            rest.append(large.select("least", "doc"))
        release(reps.sparkSession)
    every = functools.reduce(DataFrame.unionByName, leaves)
    joined = functools.reduce(DataFrame.unionByName, rest) if rest else reps.select(F.col("doc").alias("least"), "doc").limit(0)
    return every, joined.where("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = cut(map_arrow(docs, _signatures, "doc_id long, n long, digest binary, pool binary"))
    classes = cut(
        sig.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "pool")).alias("r")).select(
            "digest", F.col("r.doc_id").alias("doc"), F.col("r.n").alias("n"), F.col("r.pool").alias("pool")
        )
    )
    reps = classes.select("doc", "n", "pool")
    leaves, rest = _trees(reps)
    sorted_leaves = leaves.join(reps.select("doc", "pool"), "doc").repartition(parts, "node").sortWithinPartitions("node", "doc")
    plausible = map_arrow(sorted_leaves.select("node", "doc", "pool"), _compare_pools, "a long, b long").unionByName(rest)
    families = components(plausible).withColumnsRenamed({"id": "doc", "component": "family"})
    sizes = families.join(reps.select("doc", "n"), "doc").groupBy("family").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    sizes = sizes.select(
        "family",
        F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks")
    )
    members = cut(families.join(sizes, "family").distinct())
    several = members.where("chunks > 1").limit(1).count() > 0
    # a doc_id may stand for several texts; then, and after chunks, components of groups can meet
    shared = reps.groupBy("doc").count().where("count > 1").limit(1).count() > 0

    full = docs.join(members, docs.doc_id == members.doc).select("text", "doc", "family", "chunks")
    full = map_arrow(full, _sets, "doc long, family long, chunks int, shingles binary")
    if several:
        full = cut(full)
    own = F.pmod(F.xxhash64("doc"), F.col("chunks").cast("long")).cast("int")
    dealt = full.withColumn(
        "chunk",
        F.explode(F.when(F.col("doc") == F.col("family"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own)))
    )

    def confirm(parted: DataFrame) -> DataFrame:
        return map_arrow(
            parted.select("part", "doc", "shingles").repartition(parts, "part").sortWithinPartitions("part", "doc"),
            _confirm, "a long, b long"
        )

    release(spark)
    links = confirm(dealt.withColumn("part", F.xxhash64("family", "chunk")))
    if several:
        links = cut(links)
        found = components(links)
        big = members.where("chunks > 1").select("doc", "family")
        label = big.join(found, big.doc == found.id, "left").select("doc", "family", F.coalesce("component", "doc").alias("label"))
        apart = label.where("label <> family").select("doc", "family")
        turns = apart.groupBy("family").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("turns"))
        odd = full.join(apart.select("doc"), "doc", "left_semi").join(turns, "family").withColumn(
            "turn", F.pmod(F.xxhash64("doc"), F.col("turns").cast("long")).cast("int")
        )
        odd = odd.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        against = dealt.where("chunks > 1").join(turns, "family").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        cols = ["family", "chunk", "turn", "doc", "shingles"]
        links = links.unionByName(
            confirm(
                odd.select(cols).unionByName(against.select(cols)).dropDuplicates(["family", "chunk", "turn", "doc"]).withColumn(
                    "part", F.xxhash64("family", "chunk", "turn")
                )
            )
        )
    final = components(links) if several or shared else links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    rep = classes.select("digest", "doc")
    out = sig.join(rep, "digest", "left").join(final, F.col("doc") == F.col("id"), "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
        F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of alike texts, the one of the smallest doc_id, with all columns; rows with a null doc_id stay.

    Rows are linked by a hash of doc_id and text, so a doc_id shared by unlike texts drops none.
    Texts without shingles are like no other; only repeats of one under its doc_id go.
    """
    cols = docs.columns
    at, nth = "__row", "__nth"
    while at in cols or nth in cols:
        at, nth = at + "_", nth + "_"
    rows = docs.where("doc_id is not null").withColumn(at, F.xxhash64("doc_id", "text"))
    found = near_duplicates(rows.select(F.col(at).alias("doc_id"), "text")).select(
        F.col("doc_id").alias(at), F.col("component_id").alias("of")
    ).distinct()
    ids = rows.groupBy(at).agg(F.min("doc_id").alias("id"))
    kept = found.join(ids, at).groupBy("of").agg(F.min(F.struct("id", at)).alias("r")).select(f"r.{at}")
    one = rows.join(kept, at, "left_semi").withColumn(
        nth, F.row_number().over(Window.partitionBy(at).orderBy("text"))
    ).where(F.col(nth) == 1).select(cols)
    return one.unionByName(docs.where("doc_id is null"))
