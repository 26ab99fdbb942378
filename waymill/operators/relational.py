"""Relational building blocks: focus, overrides, guards, prioritized lookups, overlays and duplicate rules.

Everything is declared with built-in expressions and equi-joins, so Catalyst prunes, pushes down and picks the joins;
no side is broadcast by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymill.functions.geometry import distance


def focus(df: DataFrame, centre: tuple[float, float] | None, radius: float, padding: float = 0.0) -> DataFrame:
    """Rows within a radius (edge included) of a centre; without a centre no row."""
    if centre is None:
        return df.limit(0)
    return df.filter(distance(F.col("x"), F.col("y"), F.lit(float(centre[0])), F.lit(float(centre[1]))) <= radius + padding)


def force(df: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """Rows whose key is in `keys` get the given values before anything is filtered."""
    marked = df.join(keys.select(key).distinct().withColumn("_forced", F.lit(True)), key, "left")
    return marked.withColumns({c: F.when(F.col("_forced"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_forced")


def without_hidden(df: DataFrame, exempt: DataFrame, key: str) -> DataFrame:
    """Rows that aren't hidden, and hidden ones whose key is exempt."""
    marked = df.join(exempt.select(key).distinct().withColumn("_exempt", F.lit(True)), key, "left")
    return marked.filter(~F.coalesce("is_hidden", F.lit(False)) | F.coalesce("_exempt", F.lit(False))).drop("_exempt")


def enabled(required: Column, selected: list) -> Column:
    """Whether everything a guard requires is selected; nothing required is enabled, null isn't."""
    return F.coalesce(F.size(F.array_except(required, F.array(*map(F.lit, selected)))) == 0, F.lit(False))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def first_of(df: DataFrame, key: str, *tables: tuple[str, DataFrame]) -> DataFrame:
    """Each row with the first of several tables (name, keys) that knows its key, as `found_in`; null if none does."""
    known = reduce(DataFrame.unionByName, [t.select(key).distinct().withColumns({"_rank": F.lit(i), "found_in": F.lit(n)}) for i, (n, t) in enumerate(tables)])
    best = known.groupBy(key).agg(F.min_by("found_in", "_rank").alias("found_in"))
    return df.join(best, key, "left")


def overlay(base: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the values of meta laid over: a value that is set wins, null included; keys only in meta are appended.

    meta holds for each column c the columns c and c_set.
    """
    m = meta.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"{c}_set").alias(f"_{c}_set") for c in columns])
    both = base.join(m, key, "full")
    return both.select(key, *[F.when(F.col(f"_{c}_set"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns if c != key])


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a maximum, aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return best.select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])


def keep_first_pair(df: DataFrame, a: str, b: str, order: list[str]) -> DataFrame:
    """One row for each unordered pair, the first in order."""
    pair = [F.least(a, b).alias("pair_a"), F.greatest(a, b).alias("pair_b")]
    best = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*pair).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("v"))
    return best.select("v.*")


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def disambiguated(df: DataFrame, scope: list[str], label: str, suffix: Column) -> Column:
    """The label, with a suffix where several rows of a scope share it."""
    return F.when(F.count(F.lit(1)).over(W.partitionBy(*scope, label)) > 1, F.concat(F.col(label), F.lit(" "), suffix)).otherwise(F.col(label))


def histogram(df: DataFrame, by: list[str], value: Column, first: float, factor: float, count: int) -> DataFrame:
    """Cumulative exponential buckets (by, le, n) and their total as le = infinity."""
    bounds = [first * factor**i for i in range(count)]
    aggs = [F.sum((value <= b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*aggs, F.count(value).alias("total"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return wide.select(*by, F.inline(rows))


def dangling(refs: DataFrame, key: str, parents: DataFrame) -> DataFrame:
    """References whose key no parent has."""
    return refs.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")
