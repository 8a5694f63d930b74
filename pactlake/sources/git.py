"""Git histories as tables: a Python data source whose partitions are repositories and runs of their paths.

Tasks call git, so repositories have to lie where executors see them. Rows come as git gives them, line by line; no
history passes through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

LOG = "repo string, path string, nth int, commit_hash string, author string, email string, commit_time string, subject string"
BLAME = "repo string, path string, line int, commit_hash string, author string, email string, commit_time string"
#: Paths that one task reads.
PATHS = 50
#: Commits of a path at most, and days within which they are looked for first; fixed limits.
MOST, DAYS = 10, 14


def register(spark: SparkSession) -> None:
    """Make the format ``git`` known to the session. Options: what (log, blame), asked (JSON: [[repo, [path, ...]], ...]), most, days, seconds."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    schemas = {"log": LOG, "blame": BLAME}

    class Part(InputPartition):
        def __init__(self, repo, paths):
            self.repo, self.paths = repo, paths

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.what, self.asked = options.get("what", "log"), json.loads(options.get("asked", "[]"))
            self.most, self.days, self.seconds = (int(options.get(k, v)) for k, v in (("most", MOST), ("days", DAYS), ("seconds", 60)))

        def partitions(self):
            return [Part(r, paths[i : i + PATHS]) for r, paths in self.asked for i in range(0, len(paths), PATHS)] or [Part("", [])]

        def read(self, partition):
            for path in partition.paths:
                yield from (self.log if self.what == "log" else self.blame)(partition.repo, path)

        def git(self, repo, *args):
            """Lines of a command; none where git, the repository or the path isn't there."""
            import subprocess

            try:
                run = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=self.seconds)
            except (OSError, subprocess.TimeoutExpired):
                return []
            return run.stdout.decode(errors="replace").split("\n") if run.returncode == 0 else []

        def log(self, repo, path):
            """The newest commits of the last days; of all time where there is none."""
            form = "--format=%H%x1f%an%x1f%ae%x1f%cI%x1f%s"
            for window in ([f"--since={self.days} days ago"], []):
                found = [x.split("\x1f") for x in self.git(repo, "log", "--follow", f"-{self.most}", form, *window, "--", path) if x.count("\x1f") == 4]
                if found:
                    for nth, row in enumerate(found):
                        yield (repo, path, nth, *row)
                    return

        def blame(self, repo, path):
            """Every line with its last commit."""
            from datetime import datetime, timezone

            about, line = {}, 0
            for x in self.git(repo, "blame", "--line-porcelain", "--", path):
                head = x.split(" ")
                if x.startswith("\t"):
                    at = datetime.fromtimestamp(int(about["committer-time"]), timezone.utc).isoformat()
                    yield (repo, path, line, about["hash"], about.get("author"), about.get("author-mail", "").strip("<>"), at)
                elif len(head) >= 3 and len(head[0]) == 40 and head[1].isdigit():
                    about, line = {"hash": head[0]}, int(head[2])
                else:
                    about[head[0]] = x[len(head[0]) + 1 :]

    class Git(DataSource):  # local, so that executors needn't have this package
        @classmethod
        def name(cls):
            return "git"

        def schema(self):
            return schemas[self.options.get("what", "log")]

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Git)


def _read(spark: SparkSession, what: str, asked: dict[str, list[str]], **options: int) -> DataFrame:
    register(spark)
    reader = spark.read.format("git").option("what", what).option("asked", json.dumps([[r, list(p)] for r, p in asked.items()]))
    return reader.options(**{k: str(v) for k, v in options.items()}).load()


def log(spark: SparkSession, asked: dict[str, list[str]], **options: int) -> DataFrame:
    """Commits of paths (repository -> paths), the newest first by ``nth``."""
    return _read(spark, "log", asked, **options)


def blame(spark: SparkSession, asked: dict[str, list[str]], **options: int) -> DataFrame:
    """The last commit of every line of files; ranges of lines are a filter."""
    return _read(spark, "blame", asked, **options)
