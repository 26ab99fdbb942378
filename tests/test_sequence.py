"""Ordered operations on small tables of odd events, against their SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.compare import difference, oracle
from waymill.plans import catalogue

AT = dt.datetime(2024, 3, 30, 23, 30)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])  # the clock there changes within the two days
def test_ttl_last_value(spark, tmp_path, zone):
    day, us = dt.timedelta(days=1), dt.timedelta(microseconds=1)
    rows = [
        (1, AT + 2 * day, 7, "view"), (2, AT, 8, "view"), (3, AT - us, 9, "view"), (4, AT + day, 8, "click"), (5, AT + day, 8, "click"),
        (6, AT - day, 7, "view"), (7, None, 7, "click"), (8, AT + day, None, None), (None, AT + day, 7, "signup"),
    ]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = catalogue.QUERIES["ttl_last_value"](spark, str(tmp_path))
        assert difference(df, oracle(str(tmp_path)), catalogue.ORACLES["ttl_last_value"]) == ""
        assert sorted(r.event_id or 0 for r in df.collect()) == [0, 1, 2, 5, 8]
        spark.createDataFrame([], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        assert catalogue.QUERIES["ttl_last_value"](spark, str(tmp_path)).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_ttl_last_value_times_with_zone(spark, tmp_path, zone):
    day, us = dt.timedelta(days=1), dt.timedelta(microseconds=1)
    rows = [(1, AT + 2 * day, 1, "view"), (2, AT, 2, "view"), (3, AT - us, 3, "view"), (4, None, 4, "view")]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")  # the session is in UTC here
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = catalogue.QUERIES["ttl_last_value"](spark, str(tmp_path))
        assert difference(df, oracle(str(tmp_path)), catalogue.ORACLES["ttl_last_value"]) == ""
        assert sorted(r.event_id for r in df.collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
