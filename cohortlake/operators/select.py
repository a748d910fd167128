"""Ranks, capped and greedy selections as window plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_known(value: Column, partition: Sequence[str], order: Sequence[Column]) -> Column:
    """1 for the best; rows without the value get no rank."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return F.when(value.isNotNull(), F.row_number().over(w))


def best_per_key(df: DataFrame, keys: Sequence[str], prefer: Sequence[Column], last: Sequence[Column], tie: str = "tied") -> DataFrame:
    """The preferred row of each key; ``tie`` says whether the runner-up equals it on ``prefer``."""
    w = Window.partitionBy(*keys).orderBy(*prefer, *last)
    same = Window.partitionBy(*keys).orderBy(*prefer)
    out = df.withColumn("_r", F.row_number().over(w)).withColumn("_same", F.rank().over(same))
    firsts = F.sum(F.when(F.col("_same") == 1, 1).otherwise(0)).over(Window.partitionBy(*keys))
    return out.withColumn(tie, firsts > 1).where("_r = 1").drop("_r", "_same")


def capped_priority(df: DataFrame, group: str, priority: DataFrame, order: Sequence[Column], cap: int, most: int, least: int) -> DataFrame:
    """Up to ``cap`` rows of each priority group in priority order, ``most`` in all; if that
    gives fewer than ``least``, the best others fill up to ``least`` within the caps.

    priority: (group, priority) with 0 the first.
    """
    ranked = df.join(priority, group, "left").withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    within = ranked.where(F.col("_r") <= cap)
    wanted = within.where(F.col("priority").isNotNull()).withColumn("_n", F.row_number().over(Window.orderBy("priority", "_r"))).where(F.col("_n") <= most)
    chosen = wanted.select(*df.columns, F.lit("priority").alias("chosen_by"))
    have = wanted.count()
    if have >= least:
        return chosen
    rest = within.where(F.col("priority").isNull()).orderBy(*order).limit(min(least, most) - have)
    return chosen.unionByName(rest.select(*df.columns, F.lit("filler").alias("chosen_by")))


def diverse_top(df: DataFrame, group: str, priority: Sequence[str], order: Sequence[Column], cap: int, most: int) -> DataFrame:
    """The best row of each priority group, then the best rows overall with at most
    ``cap`` per group and ``most`` in all."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cap)
    first = (F.col("_r") == 1) & F.col(group).isin(list(priority))
    overall = Window.orderBy(F.when(first, 0).otherwise(1), *order)
    return ranked.withColumn("selection_rank", F.row_number().over(overall)).where(F.col("selection_rank") <= most).drop("_r")


def proportional_allocation(counts: DataFrame, total: int, size: str = "n", key: str = "stratum") -> DataFrame:
    """One for each stratum, then the floor of its share of the rest, then the largest remainders."""
    w = Window.partitionBy()
    extra = F.lit(total) - F.count(F.lit(1)).over(w)
    share = extra * (F.col(size) - 1) / F.when(F.sum(F.col(size) - 1).over(w) > 0, F.sum(F.col(size) - 1).over(w))
    out = counts.withColumn("_share", F.coalesce(share, F.lit(0.0))).withColumn("_floor", F.floor("_share"))
    left = extra - F.sum("_floor").over(w)
    out = out.withColumn("_left", left).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_floor")), key)))
    return out.withColumn("allocated", F.least(F.col(size), 1 + F.col("_floor") + (F.col("_r") <= F.col("_left")).cast("bigint")).cast("bigint")).drop("_share", "_floor", "_left", "_r")


def half_split(df: DataFrame, stratum: str, order: Column) -> DataFrame:
    """Deterministic halves per stratum: at least one row calibrates."""
    w = Window.partitionBy(stratum)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("calibration", F.row_number().over(w.orderBy(order)) <= F.greatest(F.lit(1), F.floor(n / 2)))


def replacement(current: DataFrame, candidates: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """As many best candidates per group as the current selection has there."""
    sizes = current.groupBy(group).agg(F.count(F.lit(1)).alias("_want"))
    ranked = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.join(sizes, group).where(F.col("_r") <= F.col("_want")).drop("_r", "_want")


def margin(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[Column]) -> DataFrame:
    """Best label's score, and its lead over the second (0 where there is none)."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    top = lambda i: F.max(F.when(F.col("_r") == i, F.col(score)))
    return ranked.groupBy(*keys).agg(top(1).alias("top1_score"), (top(1) - F.coalesce(top(2), F.lit(0.0))).alias("margin"))
