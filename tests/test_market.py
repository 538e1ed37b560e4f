"""All registered market queries against their SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import tickloom.plans.features  # noqa: F401
import tickloom.plans.market  # noqa: F401
import tickloom.plans.research  # noqa: F401
import tickloom.plans.strategy  # noqa: F401
import tickloom.plans.streams  # noqa: F401
import tickloom.plans.tenders  # noqa: F401
import tickloom.plans.training  # noqa: F401
from tickloom.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    return None if isinstance(x, float) and math.isnan(x) else x


def rows(frame):
    """Rows in an order that the last digits of numbers don't change."""
    found = [tuple(map(plain, r)) for r in frame]
    return sorted(found, key=lambda r: [f"{x:.6g}" if isinstance(x, float) else f"{float(x):.6g}{x}" if isinstance(x, int) else str(x) for x in r])


def equal(a, b):
    """Integers and all that is no number exactly, floats to nine digits."""
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, int):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b or str(a) == str(b)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = want.columns
    found, expected = rows(got.select(*columns).collect()), rows(want.fetchall())
    assert len(found) == len(expected)
    assert not [(x, y) for x, y in zip(found, expected, strict=True) if not all(map(equal, x, y))][:3]
