"""Every query of the core against its SQL on the smallest tables."""

import pytest

from tests.compare import difference, oracle
from waymill.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return oracle(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, data, con, name):
    assert difference(catalogue.QUERIES[name](spark, data), con, catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


FOUND = ["p1_found", "p2_found", "p2_snapshots", "p3_found", "p3_connections", "p3_table_sizes", "p5_found", "p5_ferry_table", "p5_icon_mat_table", "p5_localization_table"]


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables(spark, empty, name):
    assert catalogue.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_nulls_repeats_and_clashing_columns_change_nothing(spark, data, messy, name):
    rows = lambda d: sorted(map(repr, map(tuple, catalogue.QUERIES[name](spark, d).collect())))
    assert rows(messy) == rows(data)
