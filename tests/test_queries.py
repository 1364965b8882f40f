"""Every query runs; those with SQL give the rows of their SQL."""

import re

import pytest

from quern.plans.queries import QUERIES
from quern.plans.sql import SQL
from sql_compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf_dir, name):
    compare(spark, con, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["shop", "name", "price", "url", "in_stock", "fit", "last_seen_at"]


def test_nothing_else_needs_llm():
    """Nothing outside the subpackage imports it, so that the rest works without it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "quern"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?m)^\s*(?:from|import)\s.*\bllm\b", p.read_text()), p
