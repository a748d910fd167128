"""Joins: cardinality-checked, key-harmonising, as-of interval, coalescing, nearest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    pass


#: Rows of a table that a task is dealt at most, of a table whose keys are spread evenly.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` over as many tasks as these need, so
    that a task's memory doesn't grow with the table; as it is where Spark's own number is enough."""
    wanted = -(-rows // TASK_ROWS)
    return df.repartition(wanted, *keys) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """Raise with up to five keys if any occurs twice; one combined aggregation."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys).limit(5).collect()
    if twice:
        raise CardinalityError(f"{label}: repeated keys {[tuple(r) for r in twice]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """An equi-join whose 'one' sides are checked first."""
    one_left, one_right = validate.split("_to_")[0] == "one", validate.split("_to_")[1] == "one"
    if one_left:
        assert_unique(left, on, "left side")
    if one_right:
        assert_unique(right, on, "right side")
    return left.join(right, list(on), how)


def left_join_filled(base: DataFrame, update: DataFrame, on: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Every row of the base; missing update values take the given defaults."""
    return base.join(update, list(on), "left").fillna(fill)


def outer_with_indicator(left: DataFrame, right: DataFrame, on: Sequence[str], name: str = "found_in") -> DataFrame:
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(on), "full_outer")
    side = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left_only").otherwise("right_only")
    return joined.withColumn(name, side).drop("_l", "_r")


def coalesced_join(df: DataFrame, preferred: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every row of ``df``; the named columns come from the preferred side where it has a value."""
    other = preferred.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(other, list(on), "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns})
    return out.drop(*[f"_{c}" for c in columns])


def keep_update(base: DataFrame, update: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of the update, with the base's columns where it has the key."""
    return base.join(update, list(on), "right")


def looked_up(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the table has, once; a key that the table repeats raises."""
    return df.join(assert_unique(table, on, "lookup table"), list(on))


def missing_members(expected: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.join(found, list(on), "left_anti")


def only_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(members.select(*on), list(on), "left_semi")


def harmonise_keys(table: DataFrame, universe: DataFrame, key: str, full: str, levels: Sequence[tuple[Column, Column, str]]) -> DataFrame:
    """Resolve ``key`` of a table to the universe's ``full`` keys.

    levels: (key of the table, key of the universe, name) tried in order; at
    each level only universe keys that stand for one full key count. Adds
    ``resolved`` and ``match_level`` (null where no level fits).
    """
    out = table
    names = []
    for i, (mine, theirs, _) in enumerate(levels):
        unique = universe.select(theirs.alias(f"_k{i}"), F.col(full).alias("_f")).where(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min("_f").alias(f"_f{i}"), F.max("_f").alias("_m")).where(F.col(f"_f{i}") == F.col("_m")).drop("_m")
        out = out.withColumn(f"_k{i}", mine).join(unique, f"_k{i}", "left")
        names += [f"_k{i}", f"_f{i}"]
    resolved = F.coalesce(*[F.col(f"_f{i}") for i in range(len(levels))])
    level = F.lit(None).cast("string")
    for i in reversed(range(len(levels))):
        level = F.when(F.col(f"_f{i}").isNotNull(), levels[i][2]).otherwise(level)
    return out.withColumn("resolved", resolved).withColumn("match_level", level).drop(*names)


def asof_interval(points: DataFrame, segments: DataFrame, keys: Sequence[str], at: str, start: str, end: str, values: Sequence[str], slices: int = 32) -> DataFrame:
    """Each point with the last segment of its key that starts at or before it,
    if that one also reaches it (both ends count); equal starts: the largest end.

    The two sides are merged and read in one pass per key and slice of the
    axis; what an earlier slice hands on is computed from one row per key and
    slice, so a key with very many points is not one task. Null positions keep
    their row, unmatched.
    """
    held = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *[F.col(v) for v in values])
    inside = points.where(F.col(at).isNotNull())
    edge = inside.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    lo, hi = edge.first() or (None, None)
    width = max((float(hi) - float(lo)) / slices, 1e-9) if lo is not None else 1.0
    cut = lambda c: F.greatest(F.lit(-1), F.least(F.lit(slices), F.floor((c.cast("double") - F.lit(float(lo or 0))) / width))).cast("int")
    p = inside.withColumns({"_pos": F.col(at).cast("double"), "_point": F.lit(1), "_end": F.lit(None).cast("double"), "_row": F.struct(*points.columns), "_slice": cut(F.col(at))})
    s = segments.where(F.col(start).isNotNull()).withColumns({"_pos": F.col(start).cast("double"), "_point": F.lit(0), "_end": F.col(end).cast("double"), "_seg": held, "_slice": cut(F.col(start))})
    carry = s.groupBy(*keys, "_slice").agg(F.max_by("_seg", F.struct("_pos", "_end")).alias("_last"))
    carry = p.select(*keys, "_slice").distinct().withColumn("_ask", F.lit(0)).unionByName(carry.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_slice", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = carry.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).where("_ask = 0").select(*keys, "_slice", "_carry")
    near = Window.partitionBy(*keys, "_slice").orderBy("_pos", "_point", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shape = [*keys, "_slice", "_pos", "_point", "_end"]
    both = p.select(*shape, "_row").unionByName(s.select(*shape, "_seg"), allowMissingColumns=True)
    seen = both.withColumn("_near", F.last("_seg", ignorenulls=True).over(near)).where("_point = 1").join(carry, [*keys, "_slice"], "left")
    seg = F.coalesce("_near", "_carry")
    hit = F.col("_pos") <= seg["e"]
    out = seen.select("_row.*", *[F.when(hit, seg[v]).alias(v) for v in values], F.coalesce(hit, F.lit(False)).alias("matched"))
    lost = points.where(F.col(at).isNull()).select(*points.columns, *[F.lit(None).cast(segments.schema[v].dataType).alias(v) for v in values], F.lit(False).alias("matched"))
    return out.unionByName(lost)


def first_non_missing(update: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """One row per key with each column's first non-null value in the given order."""
    return update.groupBy(*keys).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def coalesce_merge(base: DataFrame, updates: Sequence[tuple[str, DataFrame]], keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """Fill only the null cells of the base from each update in turn; every update
    that knows a key is named in ``sources``, whether or not a value was taken."""
    out = base.withColumn("sources", F.lit(""))
    for name, update in updates:
        one = first_non_missing(update, keys, values, order)
        one = one.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(name).alias("_from"))
        out = out.join(one, list(keys), "left")
        out = out.withColumns({v: F.coalesce(F.col(v), F.col(f"_{v}")) for v in values}).withColumn("sources", F.concat_ws(";", F.when(F.col("sources") != "", F.col("sources")), "_from")).drop("_from", *[f"_{v}" for v in values])
    return out


def unordered_pairs(small: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b"), on: Sequence[str] = ()) -> DataFrame:
    """All pairs within ``on`` (bounded relations such as projects)."""
    a = small.select(*[F.col(c).alias(c if c in on else c + suffixes[0]) for c in small.columns])
    b = small.select(*[F.col(c).alias(c if c in on else c + suffixes[1]) for c in small.columns])
    condition = F.col(key + suffixes[0]) < F.col(key + suffixes[1])
    return a.join(b, list(on)).where(condition) if on else a.join(b, condition)


def mapped(df: DataFrame, dimension: DataFrame, on: str, value: str, default: object = None) -> DataFrame:
    """Dictionary lookup with a default."""
    out = df.join(dimension.select(on, value), on, "left")
    return out if default is None else out.fillna({value: default})


def aligned(df: DataFrame, key: str, order: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The rows of ``df`` in the places of ``order`` (key, ordinal): one for each place, in which
    a key that ``df`` lacks leaves nulls and rows of other keys have none. A repeated key of
    ``df`` raises; a key may have several places."""
    assert_unique(df, [key], "aligned table")
    return order.select(ordinal, key).join(df, key, "left").select(ordinal, *df.columns)
