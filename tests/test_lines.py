"""Queries of lines and routes on small tables of odd rows against their SQL."""

import pytest

from tests.compare import difference, oracle
from waymill.operators import blocks, spatial
from waymill.plans import catalogue


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory) -> str:
    """Keys whose positions repeat, null keys and nations, a nation of one stop and one of none, doubled customers."""
    d = str(tmp_path_factory.mktemp("odd"))
    stops = [(i * 37 % 400 + 10_007 * (i % 3), i % 4) for i in range(120)] + [(None, 1), (None, 1), (5, None), (9000, 5)]
    places = [(i * 11 + 10_007 * (i % 5), i % 7) for i in range(600)] + [(None, 1), (None, 6), (77, None), (11, 5)]
    spark.createDataFrame(stops, "s_suppkey bigint, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame(places + places[:50], "c_custkey bigint, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k,) for k, _ in places] + [(11,), (22,)], "p_partkey bigint").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("rows", [4096, 16])
def test_waypoint_best(spark, monkeypatch, odd, rows):
    assert "CoGroup" in check(spark, monkeypatch, odd, rows, "waypoint_best")  # pairs are reduced where they meet


@pytest.mark.parametrize("rows", [4096, 16])
def test_line_proximity(spark, monkeypatch, odd, rows):
    assert "SQRT" not in check(spark, monkeypatch, odd, rows, "line_proximity")  # no row for a pair of a point and a segment


@pytest.mark.parametrize("rows", [4096, 16])
def test_chunked_boxes(spark, monkeypatch, odd, rows):
    assert "x0" not in check(spark, monkeypatch, odd, rows, "chunked_boxes")  # no row for a pair of a part and a box


def check(spark, monkeypatch, odd, rows, name) -> str:
    """Blocks of whole keys and blocks that cut them give the SQL's rows; the plan is returned."""
    monkeypatch.setattr(blocks, "BLOCK", rows)
    monkeypatch.setattr(blocks, "PAIRS", 50 if rows < 100 else 250_000)
    df = catalogue.QUERIES[name](spark, odd)
    assert difference(df, oracle(odd), catalogue.ORACLES[name]) == ""
    return df._jdf.queryExecution().toString()


def test_touching_segments_as_in_the_sql(spark):
    """Two segments touch a point; by the SQL's order of operations only the later one's distance is 0, not 2.5e-16."""
    line = spark.createDataFrame([(None, 1, 42.0, 1.0), (None, 2, 47.0, 11.0), (None, 3, 43.0, 3.0), (None, 4, 44.0, 3.0)], "line int, ord int, x double, y double")
    places = spark.createDataFrame([(1, 43.0, 3.0), (2, 43.0, 3.0), (2, 46.0, 60.0), (3, 900.0, 3.0), (4, 46.0, 12.0), (4, 43.0, 90.0)], "id int, x double, y double")
    got = {(r.line, r.id): (round(r.d, 3), round(r.location, 2)) for r in spatial.near_lines(places, line, 5.0).collect()}
    assert got == {(None, 1): (0.0, 20.12), (None, 2): (0.0, 20.12), (None, 4): (1.414, 11.18)}
