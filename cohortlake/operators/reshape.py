"""Pivot, unpivot and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def widen(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[object], agg: Column, fill: object = 0) -> DataFrame:
    """Long to wide with a fixed list of columns, so that the schema is known."""
    out = df.groupBy(*keys).pivot(column, list(values)).agg(agg)
    return out if fill is None else out.na.fill(fill)


def lengthen(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def transposed(wide: DataFrame, key: str, columns: Sequence[str], keys: Sequence[object], name: str = "metric") -> DataFrame:
    """Columns as rows and the given keys as columns (a bounded table)."""
    return lengthen(wide, [key], columns, name).groupBy(name).pivot(key, list(keys)).agg(F.sum("value"))


def union_filled(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order (turn the order round for the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def set_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def set_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def same_members(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    return set_difference(a, b, keys).isEmpty() and set_difference(b, a, keys).isEmpty()


def signed_matrix(triggered: DataFrame, row: str, targets: str, weight: Column, columns: Sequence[str], low: float = -1, high: float = 1) -> DataFrame:
    """Rules by target: weights summed, clipped and pivoted."""
    long = triggered.select(row, F.explode(targets).alias("target"), weight.alias("w")).groupBy(row, "target").agg(F.greatest(F.lit(low), F.least(F.lit(high), F.sum("w"))).alias("w"))
    return widen(long, [row], "target", columns, F.first("w"), 0)
