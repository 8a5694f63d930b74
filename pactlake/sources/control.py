"""Control-plane data: contracts, registries, snapshots, settings. Kilobytes, on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields, replace
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

REGISTRY = (
    "contract_id string, subscriber_id string, subscriber_team string, fields_consumed array<string>, breaking_fields "
    "array<struct<field:string,reason:string>>, "
    "validation_mode string, mode_upgraded_at string, registered_at string, contact string"
)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file by Spark, so from any store it reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_yaml(spark: SparkSession, path: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(read_text(spark, path)) or {}


def registry(spark: SparkSession, path: str) -> DataFrame:
    rows = []
    for s in read_yaml(spark, path).get("subscriptions", []):
        text = lambda k, s=s: None if s.get(k) is None else str(s[k])
        rows.append(
            (
                text("contract_id"), text("subscriber_id"), text("subscriber_team"),
                [str(x) for x in s.get("fields_consumed") or []],
                [(str(b.get("field")), str(b.get("reason", ""))) for b in s.get("breaking_fields") or []],
                text("validation_mode"), text("mode_upgraded_at"), text("registered_at"), text("contact")
            )
        )
    return spark.createDataFrame(rows, REGISTRY)


def since(arg: str, now: datetime | None = None) -> datetime:
    """``7 days ago``, ``3 hours ago`` or an ISO time, in UTC."""
    now = now or datetime.now(timezone.utc)
    if m := re.fullmatch(r"\s*(\d+)\s+(minute|hour|day|week)s?\s+ago\s*", arg):
        return now - timedelta(**{m[2] + "s": int(m[1])})
    t = datetime.fromisoformat(arg.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class Settings:
    drift_threshold: float = 0.15
    min_sample: int = 10
    warn_rate: float = 0.05
    rising: float = 1.5
    falling: float = 0.5


def settings(config: str | None = None, environ: dict[str, str] | None = None, prefix: str = "PACTLAKE_", **given: Any) -> Settings:
    """Defaults, then a JSON text, then the environment, then arguments."""
    s, kinds = Settings(), {f.name: type(f.default) for f in fields(Settings)}
    environ = os.environ if environ is None else environ
    layers = [json.loads(config) if config else {}, {k: environ[prefix + k.upper()] for k in kinds if prefix + k.upper() in environ}, given]
    for layer in layers:
        s = replace(s, **{k: kinds[k](v) for k, v in layer.items() if k in kinds and v is not None})
    return s


def resolve(spark: SparkSession, *candidates: str | None) -> str:
    """The first candidate that exists on its file system: an argument, then a contract's server, then defaults."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for c in candidates:
        if c:
            p = jvm.org.apache.hadoop.fs.Path(c)
            if p.getFileSystem(conf).exists(p):
                return c
    raise FileNotFoundError(f"none of these exists: {', '.join(c for c in candidates if c)}")


def report_name(contract_id: str, when: datetime) -> str:
    """``<slug of the contract>_<UTC time>.json``"""
    return f"{re.sub('[^a-z0-9]+', '_', contract_id.lower()).strip('_')}_{when.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}.json"


def git_log(repo: str, paths: list[str], days: int = 14, most: int = 10, timeout: int = 60) -> list[tuple[str, str]]:
    """(path, ``hash|author|email|time|subject``) of recent commits, of all time where a path has none; [] without git."""
    import subprocess

    out = []
    for path in paths:
        for window in ([f"--since={days} days ago"], []):
            try:
                r = subprocess.run(
                    ["git", "-C", repo, "log", f"-{most}", "--format=%H|%an|%ae|%aI|%s", *window, "--", path],
                    capture_output=True, text=True, timeout=timeout, check=True
                )
            except (OSError, subprocess.SubprocessError):
                break
            if lines := r.stdout.splitlines():
                out += [(path, line) for line in lines]
                break
    return out


#: Most lines of a file that are blamed at once.
BLAME_LINES = 200


def line_range(first: int | None, last: int | None, lines: int) -> tuple[int, int]:
    """A range of lines within a file, of BLAME_LINES at most; the file's first lines without one."""
    a = min(max(1, first or 1), max(1, lines))
    b = min(max(a, last or lines), max(1, lines))
    return a, min(b, a + BLAME_LINES - 1)


def git_blame(repo: str, path: str, first: int, last: int, timeout: int = 45) -> list[tuple[str, int]]:
    """(commit, lines) that wrote a range of a file, those of most lines first; [] without git."""
    import collections
    import subprocess

    call = ["git", "-C", repo, "blame", "--porcelain", "-L", f"{first},{last}", "--", path]
    try:
        r = subprocess.run(call, capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return []
    heads = [m[1] for line in r.stdout.splitlines() if (m := re.match(r"([0-9a-f]{40}) \d+ \d+", line))]
    return sorted(collections.Counter(heads).items(), key=lambda x: (-x[1], x[0]))


def git_commit(repo: str, revision: str, timeout: int = 30) -> str | None:
    """``hash|author|email|time|subject`` of a revision; None if there is none."""
    import subprocess

    if not re.fullmatch("[0-9a-fA-F]{7,40}", revision or ""):
        return None
    call = ["git", "-C", repo, "show", "-s", "--format=%H|%an|%ae|%aI|%s", revision]
    try:
        return subprocess.run(call, capture_output=True, text=True, timeout=timeout, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def repository_of(path: str, repositories: list[str]) -> tuple[str, str] | None:
    """(repository, path within it): the deepest of the repositories that holds the path."""
    inside = [r for r in repositories if os.path.normpath(path).startswith(os.path.normpath(r) + os.sep)]
    best = max(inside, key=len, default=None)
    return None if best is None else (best, os.path.relpath(path, best))


def slug_of(text: str, most: int = 48) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")[:most] or "contract"


def report_prefix(contract_file: str, contract_id: str = "") -> str:
    """How reports of a contract begin: its id up to the first hyphen if it has a number, else the file's name."""
    head = contract_id.lower().split("-", 1)[0]
    return head if re.fullmatch(r"[a-z]+\d+", head) else slug_of(os.path.splitext(os.path.basename(contract_file))[0])


def report_path(contract_file: str, contract_id: str, when: datetime) -> str:
    """``<prefix>_<UTC minute>.json``"""
    return f"{report_prefix(contract_file, contract_id)}_{when.astimezone(timezone.utc):%Y%m%d_%H%M}.json"


def stakeholder_stem(contract_id: str | None, run_timestamp: str | None, now: datetime) -> str:
    """``stakeholder__<contract>__<UTC second>``; the time of the run, or now if it isn't one."""
    name = re.sub("_+", "_", re.sub("[^a-zA-Z0-9_.-]+", "_", (contract_id or "").strip())).strip("_")[:120]
    try:
        t = datetime.fromisoformat((run_timestamp or "").replace("Z", "+00:00"))
        t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    except ValueError:
        t = now
    return f"stakeholder__{name or 'unknown_contract'}__{t.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}"


def report_version(names: list[str], stem: str) -> int:
    """The number after the highest ``<stem>_v<n>`` of the names; 1 for the first."""
    found = [int(m[1]) for n in names if (m := re.search(rf"{re.escape(stem)}_v(\d+)", n))]
    return max(found, default=0) + 1
