import json

import pytest

from waymill.functions.values import cast_exactly
from waymill.operators import drift


def rows(spark, files):
    data = [("ferry", path, version, json.dumps(p) if isinstance(p, dict) else p) for path, version, p in files]
    return spark.createDataFrame(data, "file_kind string, file_path string, game_version string, payload string")


def found(spark, files):
    return sorted(tuple(r) for r in drift.shape_changes(rows(spark, files)).collect())


def test_kinds_of_change(spark):
    f = lambda **k: {"ferryData": {"a": k, "b": k}}
    files = [
        ("p", "1.9", f(name="x", price=1)),
        ("p", "1.10", f(title="x", price=1)),
        ("p", "1.20", f(title="x", price="1")),
        ("p", "2.0", f(title={"default": "x"}, price="1", stops=[{"pier": 1}])),
        ("p", "2.1", f(title={"default": "y"}, price="1", stops=[{"pier": 2}])),
        ("q", "1.9", {"a": 1}),
    ]
    assert found(spark, files) == [
        ("p", "1.10", "renamed", "ferryData/*/name", "ferryData/*/title"),
        ("p", "1.20", "type_changed", "ferryData/*/price", "ferryData/*/price"),
        ("p", "2.0", "added", "", "ferryData/*/stops"),
        ("p", "2.0", "type_changed", "ferryData/*/title", "ferryData/*/title"),
    ]


def test_nothing_below_a_change_and_nulls_are_no_fields(spark):
    files = [("p", "1", {"a": {"b": {"c": 1}}, "n": None}), ("p", "2", {"z": {"b": {"c": 2}}}), ("p", "3", {"z": {"b": None}, "n": 1})]
    assert found(spark, files) == [("p", "2", "added", "", "z"), ("p", "2", "removed", "a", ""), ("p", "3", "added", "", "n"), ("p", "3", "removed", "z/b", "")]


def test_odd_rows(spark):
    files = [("p", "1", None), ("p", "2", "{"), ("p", "3", {"a": 1}), ("p", "3", {"a": 1}), (None, "1", {"a": 1}), ("p", None, {"a": 1}), ("p", "4", {"a": True})]
    assert found(spark, files) == [("p", "4", "type_changed", "a", "a")]


def test_one_file_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = [("hot", f"1.{i}", {f"k{i // 3}": i // 3}) for i in range(60)] + [(f"p{i}", "1", {"a": i}) for i in range(30)]
        got = found(spark, files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(got) == sorted(x for i in range(1, 20) for x in (("hot", f"1.{3 * i}", "added", "", f"k{i}"), ("hot", f"1.{3 * i}", "removed", f"k{i - 1}", "")))


def test_partitions_dont_matter(spark):
    """Ties of one version on either side of a cut: the payload that sorts first counts, whatever the partitions."""
    files = [("p", "1", {"a": 1}), ("p", "1", {"b": 1}), ("p", "2", {"a": 1}), ("p", "3", {"c": 1}), ("q", "1", {"a": 1})] + [(f"r{i}", str(v), {f"k{v}": v}) for i in range(9) for v in range(4)]
    got = [sorted(map(tuple, drift.shape_changes(rows(spark, files), n).collect())) for n in (1, 3, 50)]
    assert got[0] == got[1] == got[2]
    assert [x for x in got[0] if x[0] == "p"] == [("p", "3", "renamed", "a", "c")]


def test_payloads_that_are_no_json(spark):
    files = [("p", "1", {"a": 1}), ("p", "2", '{"a": Infinity}'), ("p", "3", '{"a": NaN}'), ("p", "4", {"a": "x"})]
    assert found(spark, files) == [("p", "4", "type_changed", "a", "a")]
    assert drift.ingest(rows(spark, [("p", "1", '{"ferryData": {"a": {"price": Infinity}}}')]), "ferry").count() == 0


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [(12.7, "bigint", None), (12.0, "bigint", 12), ("1_0", "bigint", None), (" 5", "bigint", None), ("-5", "bigint", -5), (2**70, "bigint", None), (True, "bigint", None), ("1e3", "double", 1000.0), ("inf", "double", None), (2**53 + 1, "double", None), (10**400, "double", None), (7, "string", None), ("7", "string", "7"), (float("inf"), "bigint", None), (None, "double", None)],
)
def test_casts_lose_nothing(value, kind, want):
    assert cast_exactly(value, kind) == want


def test_approvals_follow_renamings(spark):
    f = lambda **k: {"ferryData": {"a": k}}
    files = rows(spark, [("p", "1", f(ferryName="x", price=1)), ("p", "2", f(name="x", price=1)), ("p", "3", f(label="x", price=1)), ("q", "1", f(other="y")), ("q", "2", f(thing="y"))])
    assert drift.approvals(drift.shape_changes(files), "ferry") == {"ferry_name": ("name", "label"), "ferry_name_localized": (), "price": (), "transit": ()}


def test_rescue_and_promotion(spark):
    files = rows(spark, [("p", "1", {"ferryData": {"a": {"ferryName": "A", "price": "12 EUR", "transit": 5}, "b": {"name": "B", "price": 3}}}), ("p", "2", {"ferryData": [{"token": "c", "ferryName": {"default": "C"}, "extra": [1]}]})])
    table = drift.ingest(files, "ferry")
    got = {r.row_key: r for r in table.collect()}
    assert (got["a"].ferry_name, got["a"].price, got["a"].transit, json.loads(got["a"].rescued)) == ("A", None, 5, {"price": "12 EUR"})
    assert got["b"].ferry_name is None
    again = {r.row_key: r for r in drift.promote(table, "ferry", {"ferry_name": ("name",)}).collect()}
    assert (again["b"].ferry_name, again["b"].price, again["b"].rescued) == ("B", 3.0, None)
    assert (again["c"].ferry_name, json.loads(again["c"].rescued)) == ("C", {"extra": [1]})
    assert json.loads(again["a"].rescued) == {"price": "12 EUR"}
