"""WARC archives of pages, and reading them back by boundary chains.

Writing: pages with equal payloads of MIN_DUPLICATE bytes or more share one
``response`` record, that of the smallest page_id; the others become ``revisit``
records without a body. Records are written by Spark's own text writer, one to a
row with the record end as row end, so any store that Spark writes to will do.

Reading: splits of the files are cut at every magic ``WARC/1.1`` line, also at
those inside payloads. Each piece is a candidate record with a byte offset (a
prefix sum over the splits of its file) and, from its length header, the offset
of its successor. Pointer jumping from offset 0 of each file keeps the
candidates that are reached; all other pieces are parts of payloads. Files of at
most JUMPED candidates (pairs of numbers) are jumped through in one task each,
larger ones by rounds of joins. The digest of a piece that is as long as it says
is taken where it is read, so only payloads that hold a magic are put together:
a second read finds their pieces by content, as its splits may be others.

Pages are known by their digest and page_id, so no row is numbered: a scan that is
dealt out otherwise finds the same ones. Only rows that repeat a first page
whole are told apart, within the job that writes them.

Null html counts as empty. A null page_id writes a record without one and reads
back as null; it ranks after all others as the first of equal payloads. Of rows
with the same page_id and payload one is the response. Control characters and
spaces of an url are percent-encoded in headers; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import cut, release, shared_dir, ship, stored

MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
MIN_DUPLICATE = 100
#: Rows of a file at most; bounds files, not what is read.
FILE_RECORDS = 10_000
#: Revisits, or pieces of payloads, that are broadcast (pairs of numbers); more are joined by shuffle.
FEW = 100_000
#: Candidates of a file that one task jumps through.
JUMPED = 500_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header(*lines: Column | str) -> Column:
    parts: list[Column] = [F.lit(MAGIC)]
    for x in lines:
        parts += [F.lit(x) if isinstance(x, str) else x, F.lit("\r\n")]
    return F.concat(*parts, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Archive files of every row of pages (page_id, url, html)."""
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html")
    )
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    p = p.withColumn("bare", F.col("page_id").isNull()).withColumn("at", F.coalesce("page_id", F.lit(0)))
    key = ["digest", "bare", "at"]
    # only digests are shuffled, combined before; the rows that revisit another are joined back, by broadcast if they are few
    known = cut(p.where(F.col("bytes") >= MIN_DUPLICATE).groupBy(*key).agg(F.count("*").alias("rows")))
    first = known.groupBy("digest").agg(F.sum("rows").alias("n"), F.min(F.struct("bare", "at", "rows")).alias("first")).where("n > 1")
    found = cut(known.join(first, "digest").where("bare <> first.bare or at <> first.at or first.rows > 1"))
    own = (F.col("bare") == F.col("first.bare")) & (F.col("at") == F.col("first.at"))
    again = found.select(*key, F.when(~F.col("first.bare"), F.col("first.at")).alias("first_id"), own.alias("own"))
    few = again.limit(FEW + 1).count() <= FEW
    p = p.join(F.broadcast(again) if few else again, key, "left")
    if not found.where(own).isEmpty():
        p = p.where("own is null or not own").unionByName(_but_one(p.where("own"), key))
    p = p.withColumn("again", F.col("own")).withColumn("row", F.monotonically_increasing_id())  # the row is only in the record's name
    revisit = F.col("again").isNotNull()
    uri = F.coalesce("url", F.lit("about:blank"))
    for c in [*range(33), 127]:
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    opt = lambda name, v: F.coalesce(F.concat(F.lit(name + ": "), v.cast("string"), F.lit("\r\n")), F.lit(""))
    head = _header(
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(
            F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"),
            F.col("row").cast("string"), F.lit(">")
        ),
        "WARC-Date: 2020-01-01T00:00:00Z",
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(
            opt("WARC-Page-ID", F.col("page_id")), opt("WARC-Refers-To-Page-ID", F.when(revisit, F.col("first_id"))),
            F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")
        ),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    rows = p.select(F.concat(head, body).alias("value"))
    rows.write.mode("overwrite").option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _but_one(same: DataFrame, key: list[str]) -> DataFrame:
    """Rows equal in their key, of which one is a first (``own`` null) and the others revisit it.

    One of each task is chosen, then one of these, so a row that repeats often is spread over its tasks.
    """
    here = same.withColumn("part", F.spark_partition_id())
    here = here.withColumn("k", F.row_number().over(Window.partitionBy(*key, "part").orderBy("url")))
    one = here.where("k = 1").withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("url", "part")))
    every = one.unionByName(here.where("k > 1"))
    return every.withColumn("own", F.when(F.col("k") > 1, True)).select(same.columns)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1), F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in the order of the file. The piece before a file's first magic is empty."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value"
    )


def _content() -> list[Column]:
    """What names a piece by its content: 128 bits of hashes."""
    return [F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2")]


def _body(head_and_end: Column, value: str, end: int) -> Column:
    return F.substring(value, head_and_end + 1, F.length(value) - head_and_end - end)


def _headers() -> list[Column]:
    return [
        _field("WARC-Page-ID").try_cast("bigint").alias("page_id"), _field("WARC-Type").alias("record_type"), F.regexp_replace(
            _field("WARC-Payload-Digest"), "^sha256:", ""
        ).alias("digest"),
        _field("WARC-Payload-Length").try_cast("bigint").alias("declared_bytes"), _field("WARC-Refers-To-Page-ID").try_cast("bigint").alias("refers_to"),
    ]


def _payload() -> list[Column]:
    """Bytes and digest of the payload of a whole record in ``value`` with headers ``head``."""
    body = _body(F.length("head") + len(RECORD_END) + len(HTTP), "value", len(RECORD_END))
    is_response = _field("WARC-Type") == "response"
    return [F.when(is_response, F.octet_length(body).cast("long")).alias("n"), F.when(is_response, F.sha2(body, 256)).alias("sha")]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: page_id, record_type, digest and declared_bytes (from its headers), refers_to, n and sha (of the stored payload; of responses)."""
    head = F.expr(f"case when {_instr()} > 0 then substring(value, 1, {_instr()} - 1) end")
    size = F.octet_length("value").cast("long")
    length = F.regexp_extract("head", "(?:^|\r\n)Content-Length: ([0-9]{1,15})(?:\r|$)", 1).try_cast("bigint")
    span = F.octet_length("head") + 2 * len(RECORD_END) + length
    read = _pieces(spark, path).withColumn("head", head)
    whole = F.coalesce(span == size, F.lit(False))
    n, sha = (F.when(whole, c).alias(name) for c, name in zip(_payload(), ("n", "sha"), strict=True))
    narrow = stored(
        read.select("file", "split", "nth", *_content(), size.alias("size"), span.alias("span"), whole.alias("whole"), n, sha, *_headers()),
        "pieces"
    )
    # a piece's own magic stands before it
    in_split = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    splits = narrow.groupBy("file", "split").agg((F.sum("size") + F.count("*") * len(MAGIC)).alias("all"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("base", F.coalesce(F.sum("all").over(earlier), F.lit(0)) - len(MAGIC)).drop("all")
    before = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(in_split), F.lit(0))
    placed = narrow.withColumn("before", before).join(splits, ["file", "split"]).withColumn(
        "at", F.col("base") + F.col("before")
    ).where("at >= 0")
    placed = stored(
        placed.drop("before", "base", "split", "nth", "size").withColumn("next", F.col("at") + len(MAGIC) + F.col("span")).drop("span"),
        "placed"
    )
    release(spark)
    reached = _reached(placed.select("file", "at", "next"))
    records = placed.join(reached.hint("merge"), ["file", "at"])
    broken = records.where("not whole").select("file", F.col("at").alias("record"))
    done = records.where("whole").drop("file", "h1", "h2", "whole", "at", "next")
    if broken.isEmpty():
        return done
    # pieces of one payload: a record's own and the unreached ones after it; files hold a bounded number of records
    owner = F.max(F.when(F.col("real"), F.col("at"))).over(Window.partitionBy("file").orderBy("at"))
    marked = placed.select("file", "h1", "h2", "at").join(
        reached.withColumn("real", F.lit(True)), ["file", "at"], "left"
    ).withColumn("record", owner)
    parts = cut(marked.join(broken, ["file", "record"], "left_semi").select("file", "h1", "h2", "at", "record"))
    wanted = parts.select("h1", "h2").distinct()
    few = wanted.limit(FEW + 1).count() <= FEW
    pieces = _pieces(spark, path).select(*_content(), "value").join(F.broadcast(wanted) if few else wanted, ["h1", "h2"], "left_semi")
    found = parts.join(pieces.groupBy("h1", "h2").agg(F.first("value").alias("value")), ["h1", "h2"])
    joined = found.groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), MAGIC).alias("value")
    )
    again = joined.withColumn("head", head)
    return done.unionByName(again.select(*_headers(), *_payload()))


def _instr() -> str:
    return "instr(value, '\\r\\n\\r\\n')"


def jump(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The places reachable from place 0 over their successors, by pointer jumping."""
    order = np.argsort(at, kind="stable")
    at, after = at[order], after[order]
    n = len(at)
    to = np.searchsorted(at, after)
    to[(to == n) | (at[np.minimum(to, n - 1)] != after)] = n
    to = np.append(to, n)
    known = np.append(at == 0, False)
    while (to < n).any():
        known[to[known]] = True
        known[n] = False
        to = to[to]
    return at[known[:n]]


def _jump_file(key: tuple, t: pa.Table) -> pa.Table:
    found = jump(t.column("at").to_numpy(), t.column("next").to_numpy())
    return pa.table({"file": pa.array([key[0].as_py()] * len(found), pa.string()), "at": pa.array(found)})


def _reached(chain: DataFrame) -> DataFrame:
    """(file, at) reachable from offset 0 over successors."""
    ship(chain.sparkSession)
    chain = chain.withColumn("next", F.coalesce("next", F.lit(-1)))
    large = chain.groupBy("file").count().where(F.col("count") > JUMPED).select("file")
    if large.isEmpty():
        return stored(chain.groupBy("file").applyInArrow(_jump_file, "file string, at long"), "reached")
    near = chain.join(large, "file", "left_anti").groupBy("file").applyInArrow(_jump_file, "file string, at long")
    return stored(near.unionByName(_reached_by_joins(chain.join(large, "file", "left_semi"))), "reached")


def _reached_by_joins(chain: DataFrame) -> DataFrame:
    """As _reached: each round doubles the length of the jumps and adds what the reached ones
    jump to, so the rounds grow as the logarithm of the records of a file.
    """
    far = cut(chain.select("file", "at", "next"))
    known = far.where("at = 0").select("file", "at")
    count = known.count()
    while True:
        onward = known.join(far, ["file", "at"]).select("file", F.col("next").alias("at"))
        known = cut(known.unionByName(onward).distinct())  # with the end of the file, where no record is
        second = far.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        far = cut(far.join(second, ["file", "next"]).select("file", "at", F.col("far").alias("next")))
        release(chain.sparkSession)
        now = known.count()
        if now == count:
            return known
        count = now


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and resolve revisits."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    release(spark)
    back = stored(read_warc(spark, path), "records")
    # a revisit has what its response holds: equal digests of equal payloads
    held = back.where((F.col("record_type") == "response") & (F.col("n") >= MIN_DUPLICATE)).groupBy("sha").agg(F.max("n").alias("held"))
    out = back.join(held.withColumnRenamed("sha", "digest").hint("merge"), "digest", "left")
    return out.select(
        "page_id", F.coalesce("n", "held").alias("payload_bytes"), F.coalesce(
            F.col("sha"), F.when(F.col("held").isNotNull(), F.col("digest"))
        ).alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"),
    )
