"""Exact quantiles of groups of any size, in bounded buffers.

``percentile`` holds all distinct values of a group in one buffer. Here the place
of each wanted rank is narrowed: a mergeable sketch of what is left gives a grid
of values, exact counts say between which of them the rank lies, and only those
rows are looked at next, until few are left. The sketch's error costs rounds,
never exactness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import written

#: Grid of a round; rows of a bracket that are listed at once.
GRID, FEW = 128, 10_000


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "quantiles")


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """(*keys, n, quantiles): for each group the quantiles at ``shares``, in their order,
    between neighbouring values by straight lines; null for groups without values.

    Nulls and NaN are no values. Keys may be null. A group's rows are never
    together: a bracket is listed once it holds at most ``few`` rows, or is one
    value. Each round is two aggregations, and narrows a bracket some
    ``GRID / 4`` times.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must be between 0 and 1")
    keys = list(keys)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    own = list(names.values())
    x = F.col(value).cast("double")
    rows = _kept(df.where(~F.isnan(F.coalesce(x, F.lit(float("nan"))))).select(*[F.col(k).alias(n) for k, n in names.items()], (x + 0.0).alias("_x")))  # -0 is 0
    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    place = F.explode(F.array(*[F.lit(float(s)) for s in sorted(set(shares))])).alias("_s")
    at = sizes.select("*", place).withColumn("_h", (F.col("_n") - 1) * F.col("_s"))
    ranks = at.select(*own, "_n", "_low", "_high", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_rank")).distinct()
    open_ = _kept(ranks.select(*own, "_rank", "_low", "_high", F.lit(False).alias("_open"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside")))
    done = []
    while True:
        small = (F.col("_inside") <= few) | (F.col("_low") == F.col("_high"))
        ready, rest = open_.where(small), open_.where(~small)
        done.append(_picked(rows, ready, own))
        if rest.isEmpty():
            break
        open_ = _kept(_narrowed(rows, rest, own))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    ends = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))  # two for each share
    per = sizes.alias("a").join(ends.alias("b"), _same(own, "a", "b"), "left").select("a.*", "b._at")

    def quantile(s: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(s))
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.ceil(h)]
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    out = per.select(*[F.col(n).alias(k) for k, n in names.items()], F.col("_n").alias("n"), F.array(*[quantile(s) for s in shares]).alias("quantiles"))
    if not keys:
        return out
    every = df.select(*keys).distinct()
    return every.alias("a").join(out.alias("b"), _same(keys, "a", "b"), "left").select("a.*", F.coalesce("b.n", F.lit(0)).alias("n"), "b.quantiles")


def _inside(rows: DataFrame, brackets: DataFrame, own: list[str]) -> DataFrame:
    """Rows of each bracket, without those of its lower end if it is open; the brackets are few."""
    above = (F.col("r._x") > F.col("b._low")) | ((F.col("r._x") == F.col("b._low")) & ~F.col("b._open"))
    within = above & (F.col("r._x") <= F.col("b._high"))
    return rows.alias("r").join(brackets.alias("b"), _same(own, "r", "b") & within).select("b.*", "r._x")


def _picked(rows: DataFrame, ready: DataFrame, own: list[str]) -> DataFrame:
    """(*own, _rank, _value) of brackets that are small or one value."""
    one = ready.where("_low = _high").select(*own, "_rank", F.col("_low").alias("_value"))
    few = _inside(rows, ready.where("_low < _high"), own).groupBy(*own, "_rank", "_below").agg(F.array_sort(F.collect_list("_x")).alias("_list"))
    return one.unionByName(few.select(*own, "_rank", F.get("_list", (F.col("_rank") - F.col("_below")).cast("int")).alias("_value")))


def _narrowed(rows: DataFrame, rest: DataFrame, own: list[str]) -> DataFrame:
    """Brackets around the grid values next to each rank, with exact counts."""
    grid = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    sketch = _inside(rows, rest, own).groupBy(*own, "_rank", "_low", "_high", "_open", "_below").agg(F.percentile_approx("_x", grid, F.lit(100 * GRID)).alias("_grid"), F.count(F.lit(1)).alias("_inside"))
    sketched = _kept(sketch.withColumn("_grid", F.array_distinct(F.concat(F.array("_low"), F.col("_grid"), F.array("_high")))))
    # rows up to each grid value, exactly: a histogram, at most GRID + 1 bins a bracket
    binned = _inside(rows, sketched, own).withColumn("_bin", F.size(F.filter("_grid", lambda g: g < F.col("_x"))))
    equal = F.sum((F.col("_x") == F.get("_grid", F.col("_bin"))).cast("long"))
    counts = binned.groupBy(*own, "_rank", "_below", "_bin").agg(F.count(F.lit(1)).alias("_m"), equal.alias("_e"), F.first("_grid").alias("_grid"))
    bins = F.array_sort(F.collect_list(F.struct("_bin", "_m", "_e")))
    of = counts.groupBy(*own, "_rank", "_below").agg(bins.alias("_bins"), F.first("_grid").alias("_grid"))
    start = F.struct(F.col("_below").alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("inside"))

    def step(state: Column, b: Column) -> Column:
        # a bin holds what lies above the grid value before it, up to its own grid value, which _e rows equal: they are an answer
        own_value, before = F.get("_grid", b["_bin"]), F.get("_grid", b["_bin"] - 1)
        open_rows, at = b["_m"] - b["_e"], state["at"]
        hit = state["low"].isNull() & (F.col("_rank") < at + b["_m"])
        exact = hit & (F.col("_rank") >= at + open_rows)
        low = F.when(exact, own_value).when(hit, before).otherwise(state["low"])
        high = F.when(hit, own_value).otherwise(state["high"])
        below = F.when(exact, at + open_rows).when(hit, at).otherwise(state["below"])
        inside = F.when(exact, b["_e"]).when(hit, b["_m"]).otherwise(state["inside"])
        return F.struct((at + b["_m"]).alias("at"), low.alias("low"), high.alias("high"), below.alias("below"), inside.alias("inside"))

    found = of.withColumn("_f", F.aggregate("_bins", start, step))
    return found.select(*own, "_rank", F.col("_f.low").alias("_low"), F.col("_f.high").alias("_high"), (F.col("_f.low") < F.col("_f.high")).alias("_open"), F.col("_f.below").alias("_below"), F.col("_f.inside").alias("_inside"))
