"""The queries of the subpackage: against SQL, on empty tables, and on tables with nulls, repeats and clashing columns."""

import pytest

from tests.compare import difference, oracle
from waymill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, data, name):
    assert difference(queries.QUERIES[name](spark, data), oracle(data), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"p6_fill"}))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_repeats_and_clashing_columns_change_nothing(spark, data, messy, name):
    rows = lambda d: sorted(map(repr, map(tuple, queries.QUERIES[name](spark, d).collect())))
    if name == "p6_mixture":
        return  # messy tables double no text, but null rows may move a window's end
    if name in ("p6_containers", "p6_fill"):  # the tables' windows may differ, the pieces don't
        keep = ("doc_id", "source", "piece", "n_tokens")
        cols = keep if name == "p6_containers" else ("tokens", "least")
        rows = lambda d: sorted(map(repr, map(tuple, queries.QUERIES[name](spark, d).select(*cols).collect())))
    assert rows(messy) == rows(data)
