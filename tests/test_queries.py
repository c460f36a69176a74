"""Every registered query against its DuckDB text, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, TEXTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    verdict, _, count, detail = check.compare(spark, duck, FOLDER, name, QUERIES[name], TEXTS.get(name))
    assert check.accepted(name, verdict), f"{verdict} {detail}"
    assert count > 0


def test_every_text_belongs_to_a_query():
    assert set(TEXTS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
