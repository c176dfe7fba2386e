"""The problems' queries agree with SQL where there is one and survive awkward tables."""

import pytest

from helpers import awkward, same
from textrel.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    same(QUERIES[name](spark, data), data, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_tables(spark, data, tmp_path, name, kind):
    folder = awkward(data, str(tmp_path / kind), kind)
    rows = QUERIES[name](spark, folder).collect()
    if kind == "empty" and name.endswith("_found"):
        assert rows == []
    if kind == "clash":
        assert len(rows) == QUERIES[name](spark, data).count()


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "textrel").rglob("*.py"):
        if "llm" not in p.parts:
            assert "textrel.llm" not in p.read_text(), p


def test_mix_of_budget_draws_more_than_the_exact_mix(spark, data):
    drawn = lambda n: QUERIES[n](spark, data).selectExpr("sum(n_tokens * repeats)").first()[0]
    assert drawn("p9_mix") > drawn("p9_mix_exact")
