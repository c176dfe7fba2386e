"""Every query with SQL agrees with DuckDB; the problems' queries survive awkward tables."""

import pytest

from helpers import awkward, same
from textrel import queries_ops, queries_sql  # noqa: F401
from textrel.queries import ORACLES, QUERIES

OWN = [q for q in QUERIES if q[0] == "p" and q[1].isdigit()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    same(QUERIES[name](spark, data), data, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.count()


@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
@pytest.mark.parametrize("name", OWN)
def test_awkward_tables(spark, data, tmp_path, name, kind):
    folder = awkward(data, str(tmp_path / kind), kind)
    rows = QUERIES[name](spark, folder).collect()
    if kind == "empty":
        assert rows == []
    if kind == "clash":
        assert len(rows) == QUERIES[name](spark, data).count()
