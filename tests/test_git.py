"""Histories of a repository made here, and blame from a failing check to its commit."""

import subprocess

import pytest
from pyspark.sql import functions as F

from pactlake.model import RESULT
from pactlake.operators import attribution
from pactlake.sources import git


@pytest.fixture
def repo(tmp_path):
    def run(*args, author="Ann", day=1):
        at = f"2024-01-{day:02d}T00:00:00+00:00"
        env = {"GIT_AUTHOR_NAME": author, "GIT_AUTHOR_EMAIL": f"{author.lower()}@x.org", "GIT_COMMITTER_NAME": author, "GIT_COMMITTER_EMAIL": "c@x.org",
               "GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "HOME": str(tmp_path), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, env=env)

    run("init", "-q")
    for day, author, text in ((1, "Ann", "a = 1\nb = 2\n"), (5, "Bob", "a = 1\nb = 3\nc = 4\n")):
        (tmp_path / "load.py").write_text(text)
        (tmp_path / "other.py").write_text("x\n")
        run("add", "-A")
        run("commit", "-qm", f"Change | {author}", author=author, day=day)
    return str(tmp_path)


def test_log_and_blame_are_tables(spark, repo):
    got = git.log(spark, {repo: ["load.py", "other.py", "none.py"], "/nowhere": ["x"]}).orderBy("path", "nth").collect()
    assert [(r.path, r.nth, r.author, r.subject, r.commit_time[:10]) for r in got] == [
        ("load.py", 0, "Bob", "Change | Bob", "2024-01-05"), ("load.py", 1, "Ann", "Change | Ann", "2024-01-01"), ("other.py", 0, "Ann", "Change | Ann", "2024-01-01")
    ]
    assert git.log(spark, {repo: ["load.py"]}, most=1).count() == 1 and git.log(spark, {}).count() == 0
    lines = git.blame(spark, {repo: ["load.py", "none.py"]})
    assert [(r.line, r.author) for r in lines.orderBy("line").collect()] == [(1, "Ann"), (2, "Bob"), (3, "Bob")]
    assert {r.author for r in lines.where("line between 2 and 3").collect()} == {"Bob"}
    many = git.log(spark, {repo: [f"p{i}" for i in range(120)]})
    assert many.rdd.getNumPartitions() == 3


def test_a_failing_check_leads_to_its_commit(spark, repo):
    edges = spark.createDataFrame([("file::load.py", "table::t", "WRITES"), ("table::t", "pipeline::p", "CONSUMES")], "source string, target string, relationship string")
    fails = spark.createDataFrame([(c, c, "not_null", "FAIL", "", "", "CRITICAL", 1, [], "") for c in ("t.a.required", "t.b.required")], RESULT)
    seeds = spark.createDataFrame([("t.a.required", "table::t")], "check_id string, node string")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node"))
    commits = attribution.commits_of(nodes, git.log(spark, {repo: ["load.py"]}), F.lit("2024-01-06 00:00:00").cast("timestamp"))
    none = spark.createDataFrame([], "contract_id string, subscriber_id string, breaking_fields array<struct<field:string,reason:string>>")
    run = lambda **more: {r.check_id: r for r in attribution.violations(fails, "t-1", none, edges, seeds, commits, 2, **more).collect()}
    got = run()
    chain = got["t.a.required"].blame_chain
    assert [(c.path, c.author, c.score) for c in chain] == [("load.py", "Bob", 0.7), ("load.py", "Ann", 0.3)] and len(chain[0].commit_hash) == 40
    assert "load.py" in got["t.a.required"].blame_summary
    # without seeds of its own: the first targets of edges; or what the contract names
    assert got["t.b.required"].direct_nodes == [] and [c.path for c in got["t.b.required"].blame_chain] == ["load.py", "load.py"]
    assert run(contract_seeds=spark.createDataFrame([("file::load.py",)], "node string"))["t.b.required"].direct_nodes == ["table::t"]
