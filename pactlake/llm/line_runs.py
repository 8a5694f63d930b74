"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without white space at its ends, A-Z in lower case; keys
of fewer than ``CHARS`` code points are never dropped. A key found in at least
``DOCUMENTS`` documents is *common*: it keeps its lines in the document with the
largest id that holds it, and loses all others.

1. One scan cuts the texts into lines and stores the hashes of those long enough,
   with document and position, by batch. A document (all rows of a doc_id) is in one batch.
2. ``Runs`` takes batch after batch. A batch is summed to one entry a key (documents,
   largest id), combined before every shuffle, so a line that a third of all
   documents hold is one row a task. Its entries are merge-anti-joined with every run:
   keys that a run knows as common, and whose last document it holds, need no counting any
   more. What is left becomes a sorted run of level 0. Two runs of a level are merged
   into one of the next, so n batches leave log2(n) runs at most. Runs are bucketed and
   sorted by hash alike, so neither joins nor merges move them.
3. At last all runs become one; its common keys and the stored lines give the positions
   that each document loses.

Keys are told apart by 96 bits of two hash functions. Rows that share a doc_id are one document; rows without one are together one
document that comes before all others. Null and empty texts are one empty line.
Rows equal in doc_id and text give equal results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, shared_dir

#: Shortest key in code points, and in how many documents it is common.
CHARS, DOCUMENTS = 40, 5
#: Batches that ``drop_lines`` deals documents out to.
BATCHES = 6
SPACE = "\t\n\x0b\f\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["hash", "check"]


def line_key(line: Column) -> Column:
    """Stripped, A-Z in lower case. Where all is ASCII the two ways of lowering agree, and one is quick."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, least: int = CHARS) -> DataFrame:
    """(doc_id, content, pos, hash, check) of the lines with a key of at least ``least`` code points.

    ``content`` is a hash of the whole text, which tells rows of one doc_id apart.
    """
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.where(F.octet_length("line") >= least).select("doc_id", "content", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= least).select(
        "doc_id", "content", "pos", F.xxhash64("key").alias("hash"), F.hash("key").alias("check")
    )


class Runs:
    """Levelled sorted runs of (hash, check, documents, last), in the shared folder; a level holds one run at most.

    Each document may be in one added batch only; batches may come in any order.
    """

    def __init__(self, spark: SparkSession, common: int = DOCUMENTS):
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        self.spark, self.common = spark, common
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), most)
        self.levels: dict[int, tuple[str, DataFrame]] = {}

    def _write(self, entries: DataFrame) -> tuple[str, DataFrame]:
        """A run: its buckets are a catalog's table only while it is opened; then its files stand for themselves."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("compression", "zstd").option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        run.schema  # noqa: B018  resolved before the name goes
        self.spark.sql(f"DROP TABLE {name}")
        return path, run

    def runs(self) -> list[DataFrame]:
        return [self.levels[k][1] for k in sorted(self.levels)]

    def unknown(self, entries: DataFrame) -> DataFrame:
        """Entries that no run makes needless: one does where it knows the key as common in a later document."""
        for run in self.runs():
            known = run.where(F.col("documents") >= self.common).select(*KEY, F.col("last").alias("known_last"))
            entries = entries.join(known, [*(entries[k] == known[k] for k in KEY), entries["last"] < known["known_last"]], "left_anti")
        return entries

    def add(self, lines: DataFrame) -> None:
        """Take a batch of (doc_id, hash, check): join it against the runs, keep what is left as a run, compact."""
        # once for each document, then a row for each key
        own = lines.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("last")
        )
        self._put(0, self._write(self.unknown(own)))

    def _put(self, level: int, run: tuple[str, DataFrame]) -> None:
        """Where the level has a run, merge the two into the next level."""
        while held := self.levels.pop(level, None):
            merged = self._write(self._merged(held[1], run[1]))
            remove(self.spark, held[0], run[0])
            level, run = level + 1, merged
        self.levels[level] = run

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """A key is in a run once, so a merge join adds the runs up, bucket by bucket."""
        b = b.select(*KEY, F.col("documents").alias("more"), F.col("last").alias("other"))
        sums = F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))
        return a.join(b, KEY, "full").select(*KEY, sums.alias("documents"), F.greatest("last", "other").alias("last"))

    def common_keys(self) -> DataFrame:
        """(hash, check, last) of the keys found in enough documents so far; all runs become one."""
        while len(self.levels) > 1:
            low, high = sorted(self.levels)[:2]
            self._put(high, self.levels.pop(low))
        every = self.runs()
        if not every:
            return self.spark.createDataFrame([], "hash long, check int, last long")
        return every[0].where(F.col("documents") >= self.common).select(*KEY, "last")

    def close(self) -> None:
        remove(self.spark, *[path for path, _ in self.levels.values()])
        self.levels = {}


def dropped_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, content, dropped): the positions that documents lose."""
    lost = lines.join(common, KEY).where("doc_id is null or doc_id < last")
    return lost.groupBy("doc_id", "content").agg(F.collect_set("pos").alias("dropped"))


def drop_lines(docs: DataFrame, least: int = CHARS, common: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """Each row's doc_id, text (what is left), n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    top = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    line_hashes(docs, least).select("*", batch).write.option("compression", "zstd").partitionBy("batch").parquet(f"{top}/lines")
    kind = "doc_id long, content long, pos int, hash long, check int, batch int"
    lines = spark.read.schema(kind).parquet(f"{top}/lines")
    runs = Runs(spark, common)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("doc_id", *KEY))
    runs.common_keys().write.parquet(f"{top}/common")
    runs.close()
    lost = dropped_lines(lines.drop("batch"), spark.read.schema("hash long, check int, last long").parquet(f"{top}/common"))
    mine = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("whole"), F.coalesce("text", F.lit("")).alias("text")
    )
    both = mine.join(lost, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("whole") == F.col("content")), "left")
    every = split_lines(F.col("text"))
    # array_except keeps the order of its first argument and looks positions up by hash
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("dropped"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("every"), i)), "\n")
    return both.withColumn("every", every).select(
        F.col("id").alias("doc_id"), F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size("every").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the digest of what is left of each text."""
    kept = F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", kept)
