import pytest
from pyspark.sql import functions as F

from waymill.functions.keys import token, uid, uid_of_rank, uid_rank

SPELLINGS = [("0x00AB", "ab"), (" 1f ", "1f"), ("0", "0"), ("0x0", "0"), ("0000", "0"), ("FFFFFFFFFFFFFFFF", "f" * 16), ("", None), (None, None), ("  ", None), ("nonsense", "nonsense"), ("0" * 20 + "7", "7"), ("1" * 17, "1" * 17)]


@pytest.mark.parametrize(("text", "want"), SPELLINGS)
def test_uid(spark, text, want):
    assert spark.createDataFrame([(text,)], "u string").select(uid("u")).first()[0] == want


def test_rank_orders_unsigned(spark):
    uids = ["0", "1", "7fffffffffffffff", "8000000000000000", "ffffffffffffffff"]
    df = spark.createDataFrame([(u,) for u in reversed(uids)], "u string").withColumn("r", uid_rank("u"))
    assert [r.u for r in df.orderBy("r").collect()] == uids
    assert [r[0] for r in df.orderBy("r").select(uid_of_rank("r")).collect()] == uids


def test_token(spark):
    df = spark.createDataFrame([("\t FWY_A \n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(token(F.col("t"))).collect()] == ["fwy_a", None, None]
