"""Writers: JSON tables, graphs with rounded distances, feature collections, subsets, and dense numbers for exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from waymill.session import BROADCAST_ROWS, Scratch


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, many files; null fields are left out."""
    df.write.mode("overwrite").json(path)


def rounded(df: DataFrame, name: str = "distance", places: int = 2) -> DataFrame:
    """Every field of that name, however deeply nested, rounded."""

    def fix(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            inner = [(F.round(c[f.name], places) if f.name == name and isinstance(f.dataType, T.DoubleType) else fix(c[f.name], f.dataType)).alias(f.name) for f in t]
            return F.when(c.isNotNull(), F.struct(*inner))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda v: fix(v, t.elementType))
        return c

    return df.select(*[(F.round(f.name, places) if f.name == name and isinstance(f.dataType, T.DoubleType) else fix(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema])


def feature(geometry: str, coordinates: Column, **properties: Column) -> Column:
    """A feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))


def write_features(df: DataFrame, column: str, path: str) -> None:
    """Features one a line, many files (a sequence of features)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, column: str, path: str) -> None:
    """A feature collection in one file of a folder, streamed through one task; null features are left out."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = '{"type":"FeatureCollection","features":['
        for pdf in batches:
            for text in pdf["value"]:
                yield pd.DataFrame({"value": [before + text]})
                before = ","
        yield pd.DataFrame({"value": [("" if before == "," else before) + "]}"]})

    lines = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").repartition(1)
    lines.mapInPandas(joined, "value string").write.mode("overwrite").text(path)


def write_subset(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows with dense numbers from 0 in the order given, without bringing them into one partition.

    A range sort orders the rows, each partition counts its own, and the counts before it are added.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    at = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_id", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    before = scratch.write(before, "before")  # one row for each partition
    small = F.broadcast(before) if before.count() <= BROADCAST_ROWS else before
    out = at.withColumn("_part", part).join(small, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(2**33 - 1))).drop("_id", "_part", "_before")
