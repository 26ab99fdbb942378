from __future__ import annotations

import os

import pytest

from waymill.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data() -> str:
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def tables(folder: str) -> list[str]:
    return sorted(f.removesuffix(".parquet") for f in os.listdir(folder) if f.endswith(".parquet"))


@pytest.fixture(scope="session")
def empty(spark, data, tmp_path_factory) -> str:
    """All tables without a row."""
    out = str(tmp_path_factory.mktemp("empty"))
    for t in tables(data):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="session")
def messy(spark, data, tmp_path_factory) -> str:
    """All tables with every row twice, a row of nulls, and further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    out = str(tmp_path_factory.mktemp("messy"))
    extra = ("world", "id", "a", "b", "w", "salt", "cx", "relation", "self", "batch", "grp", "piece", "lang2", "n", "vkey", "region", "ref_key", "src_table")
    for t in tables(data):
        df = spark.read.parquet(f"{data}/{t}.parquet")
        nulls = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        df = df.unionByName(df).unionByName(nulls)
        names = {c.lower() for c in df.columns}
        df.withColumns({c: F.lit("x") for c in extra if c not in names}).write.parquet(f"{out}/{t}.parquet")
    return out
