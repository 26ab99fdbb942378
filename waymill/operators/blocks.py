"""Two tables that meet in tasks, block by block, where every row of a key meets every other side's row of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymill.session import BROADCAST_ROWS, Scratch

#: Rows of either side in a block, and pairs that are computed at a time within one.
BLOCK, PAIRS = 4096, 250_000


def met(left: DataFrame, right: DataFrame, keys: list[str], f: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """f(left rows, right rows) of all rows equal in the keys (null equals nothing), in blocks of about BLOCK rows a side.

    A key with more rows is cut into hashed blocks and each of one side meets each of the other, so what f returns of
    several blocks has still to be combined. Every row is copied as often as the other side has blocks.
    """
    spark = left.sparkSession
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    size = lambda df, n: df.filter(some).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    sizes = Scratch(spark, "blocks").write(size(left, "_nl").join(size(right, "_nr"), keys), "sizes")
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    # a given number of partitions: the work grows with the pairs, so a join of few bytes must not end in one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def side(df: DataFrame, mine: str, theirs: str, n_mine: str, n_theirs: str) -> DataFrame:
        own = df.join(sizes, keys).withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(n_mine)).cast("int"))
        own = own.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(n_theirs) - 1)))
        return own.select(*df.columns, "_l", "_r").repartition(parts, *keys, "_l", "_r").groupBy(*keys, "_l", "_r")

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        if l.num_rows and r.num_rows:
            return f(l, r)
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema).empty_table()

    return side(left, "_l", "_r", "_nl", "_nr").cogroup(side(right, "_r", "_l", "_nr", "_nl")).applyInArrow(run, schema)


def numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as doubles, NaN for null."""
    return [t[c].to_numpy().astype(float) for c in names]


def slices(rows: int, others: int) -> list[slice]:
    """Stretches of rows that give at most about PAIRS pairs with all the others."""
    step = max(1, PAIRS // max(1, others))
    return [slice(i, i + step) for i in range(0, rows, step)]
