"""Every registered query next to its SQL on the smallest tables."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()
# these have their own tests in tests/llm
OWN = re.compile(r"op\d+_|pipeline$")
NAMES = [n for n in queries() if not OWN.match(n)]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_matches_sql(spark, duck, name):
    problem = compare(queries()[name](spark, FOLDER), duck, SQL[name])
    assert problem is None


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SQL])
def test_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(queries())
