"""Every query with SQL gives the rows that DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pytest

from pactlake import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(rows):
    same = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(same(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert norm(tuple(r) for r in got.select(cols).collect()) == norm(want)
