"""The registered queries: a fast sample against SQL, the rest through tests/oracle.py."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SAMPLE = ["link_prior", "redirect_clean", "linked_text", "wiki_candidates", "word_vocab", "nearest", "analogy"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, folder, name):
    problem, rows = compare(spark, connect(folder), folder, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and rows > 0
