"""What jobs need of a session: a folder that all executors see, cutting lineage in it, and clearing it; Arrow batches of bounded size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one; only where it
    is unset and the master is local, as in tests, a folder of this machine is used.
    All lies below one folder of the application, which is removed when the driver's JVM ends.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        at = found.get()
        if sc.applicationId not in _CLEARED:
            _files(spark, at).deleteOnExit(sc._jvm.org.apache.hadoop.fs.Path(at))
            _CLEARED.add(sc.applicationId)
        return at
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: no folder is shared with the executors")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pactlake-"))
    return shared_dir(spark)


#: Applications whose folder is marked for removal.
_CLEARED: set[str] = set()


def _files(spark: SparkSession, path: str):
    """The file system of a path, whichever it is."""
    sc = spark.sparkContext
    return sc._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables whose readers are done."""
    for p in paths:
        _files(spark, p).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p), True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one Arrow batch sent to a Python worker; keeps two workers of a
#: 3 GB executor well inside its memory whatever the length of the texts.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096


def bounded_batches(spark: SparkSession) -> None:
    """Limit the size of Arrow batches; a smaller setting of the session stays."""
    for key, most in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
    ):
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
