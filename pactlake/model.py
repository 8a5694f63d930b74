"""Types shared by all parts: check results, clauses, and their vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One row of every validation.
RESULT = T.StructType(
    [
        T.StructField("check_id", T.StringType()), T.StructField(
            "column_name", T.StringType()
        ), T.StructField("check_type", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("actual_value", T.StringType()), T.StructField("expected", T.StringType()), T.StructField("severity", T.StringType()), T.StructField(
            "records_failing", T.LongType()
        ),
        T.StructField("sample_failing", T.ArrayType(T.StringType())), T.StructField("message", T.StringType()),
    ]
)

#: Samples of a failing check, in row order.
SAMPLES = 5
#: Fixed ranks of severities in reports; others come last.
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "WARNING": 2, "WARN": 2, "LOW": 3, "ERROR": 4}
OTHER_RANK = 99
#: Fixed patterns.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX40 = "(?i)^[a-f0-9]{40}$"
HEX64 = "(?i)^[a-f0-9]{64}$"
ISO_DATE_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def prefix_of(contract_id: str) -> str:
    """Check ids begin with the contract id up to its first hyphen."""
    return contract_id.split("-", 1)[0]


def severity_rank(col: Column) -> Column:
    rank = F.lit(OTHER_RANK)
    for name, n in SEVERITY_RANK.items():
        rank = F.when(col == name, n).otherwise(rank)
    return rank


@dataclass(frozen=True)
class Clause:
    """A predicate that rows must meet; ``bad`` marks rows that don't, ``applies`` those it looks at.

    ``kind`` says how it runs: ``row`` clauses are fused in one aggregation, the
    others (``unique``, ``sequence``, ``reference``, ``aggregate``) have plans
    of their own. ``said`` names the count of what fails and what is said when
    nothing does; ``{n}`` in ``message`` is that count.
    """

    check_id: str
    column: str
    check_type: str
    expected: str
    severity: str = "CRITICAL"
    kind: str = "row"
    bad: Column | None = None
    applies: Column | None = None
    sample: Column | None = None
    empty: str = "PASS"  # status when no row applies; NONE: no result row
    on_fail: str = "FAIL"
    said: tuple[str, str] = ("failing", "ok")
    message: str = ""
    expected_ok: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
