"""Grouped summaries: prevalence, medians, fractions, confusion, quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fraction(condition: Column) -> Column:
    """Share of rows that satisfy it; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def distinct_with_null(c: Column) -> Column:
    """Distinct count in which null is a value."""
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def prevalence(events: DataFrame, expected: DataFrame, group: str, entity: str, feature: str, hit: Column) -> DataFrame:
    """Share of a group's entities (with any record) that have a hit per feature;
    expected groups without records give no rows of their own features.

    Records are counted in two steps, by group, entity and feature and then by
    group and feature, so that all of it combines before it is shuffled.
    """
    seen = events.groupBy(group, entity, feature).agg(F.max(F.when(hit, 1).otherwise(0)).alias("_h"))
    first = F.row_number().over(Window.partitionBy(group, entity).orderBy(feature)) == 1  # one row for each entity
    counts = seen.withColumn("_first", first.cast("int")).groupBy(group, feature).agg(F.sum("_h").alias("n_hits"), F.sum("_first").alias("_n"))  # groups by features
    totals, hits = counts.groupBy(group).agg(F.sum("_n").alias("n_entities")), counts.where(F.col(feature).isNotNull()).select(group, feature, "n_hits")
    grid = expected.select(group).distinct().join(hits.select(feature).distinct(), how="cross")
    out = grid.join(hits, [group, feature], "left").join(totals, group, "left").fillna(0, ["n_hits", "n_entities"])
    return out.withColumn("prevalence", F.coalesce(F.col("n_hits") / F.when(F.col("n_entities") > 0, F.col("n_entities")), F.lit(0.0)))


def value_counts_text(df: DataFrame, keys: Sequence[str], value: str, limit: int | None = None, name: str = "counts") -> DataFrame:
    """'value:count;...' by descending count, ties by value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), value)))
    ranked = ranked.where(F.col("_r") <= limit) if limit else ranked
    rows = F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", F.col(value).cast("string"), F.col("_n").cast("string")).alias("t"))))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), ";").alias(name))


def exploded_counts(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    return df.select(F.explode(F.split(column, sep)).alias("item")).where("item <> ''").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def weighted_fraction(df: DataFrame, keys: Sequence[str], start: str, end: str, value: str, least: float = 0.2) -> DataFrame:
    """Length share of intervals whose absolute value reaches ``least``."""
    length = F.greatest(F.lit(0), F.col(end) - F.col(start) + 1).cast("double")
    part = F.sum(F.when(F.abs(F.col(value)) >= least, length).otherwise(F.when(F.col(value).isNotNull(), 0.0)))
    whole = F.sum(F.when(F.col(value).isNotNull(), length))
    return df.groupBy(*keys).agg((part / F.when(whole > 0, whole)).alias("altered_fraction"), F.count(F.lit(1)).alias("n_segments"), F.max(F.abs(F.col(value))).alias("largest"))


def entropy(df: DataFrame, keys: Sequence[str], weight: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy of the positive weights, divided by the log of their number; 0 for one or none."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    p = df.where(F.col(weight) > 0).withColumn("_p", F.col(weight) / total)
    return p.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.count(F.lit(1)))).otherwise(0.0).alias(name))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts with shares of the true label's rows."""
    counted = df.groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("row_fraction", F.col("n") / F.sum("n").over(Window.partitionBy(true)))


def crosstab(df: DataFrame, true: str, predicted: str, order: Sequence[object]) -> DataFrame:
    """One row per true label, one column per label of the fixed order."""
    return df.groupBy(true).pivot(predicted, list(order)).agg(F.count(F.lit(1))).na.fill(0)


def binary_performance(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    counts = df.groupBy(*keys).agg(count_if(predicted & actual).alias("tp"), count_if(predicted & ~actual).alias("fp"), count_if(~predicted & ~actual).alias("tn"), count_if(~predicted & actual).alias("fn"))
    share = lambda a, b: F.col(a) / F.when(F.col(a) + F.col(b) > 0, F.col(a) + F.col(b))
    return counts.withColumns({"sensitivity": share("tp", "fn"), "specificity": share("tn", "fp"), "ppv": share("tp", "fp"), "npv": share("tn", "fn")})


def fixed_bins(value: Column, edges: Sequence[float]) -> Column:
    """Left-closed bin number; below the first edge 0."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return F.when(value.isNotNull(), out)


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct exact quantile edges."""
    got = df.agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]
    return sorted(set(got or []))


def quantile_bins(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins, the lowest value included."""
    out = F.lit(1)
    for e in edges[1:-1]:
        out = out + (value > e).cast("int")
    return F.when(value.isNotNull(), out)


def key_values(rows: DataFrame, section: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(qc_section, metric, value text) of a one-row table."""
    columns = list(columns or rows.columns)
    texts = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns])
    return texts.unpivot([], columns, "metric", "value").select(F.lit(section).alias("qc_section"), "metric", "value")


def quality_rows(df: DataFrame, by: str, measures: dict[str, Column], overall: str = "global", within: str = "per_project", every: str = "ALL") -> DataFrame:
    """(qc_section, by, metric, value text): all measures (aggregates) over the whole table and
    per group, from one pass by grouping sets; a null group is a group of its own, written NA.
    No rows give no rows."""
    both = df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("_whole"), *[m.alias(f"_m{i}") for i, m in enumerate(measures.values())])
    texts = both.select(F.when(F.col("_whole") == 1, overall).otherwise(within).alias("qc_section"), F.when(F.col("_whole") == 1, every).otherwise(F.coalesce(F.col(by).cast("string"), F.lit("NA"))).alias(by), *[F.coalesce(F.col(f"_m{i}").cast("string"), F.lit("NA")).alias(n) for i, n in enumerate(measures)])
    return texts.unpivot(["qc_section", by], list(measures), "metric", "value")


def empirical_percentile(reference: DataFrame, feature: str, value: float) -> DataFrame:
    return reference.where(F.col(feature).isNotNull()).agg((100 * F.avg((F.col(feature) <= value).cast("double"))).alias("percentile"))


def robustness(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, least, most and spread over scenarios."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("spread"), F.count(value).alias("n"))


def scenario_differences(df: DataFrame, keys: Sequence[str], scenario: str, value: str, base: str, others: Sequence[str]) -> DataFrame:
    """Scenarios side by side, and each other one less the base."""
    wide = df.groupBy(*keys).pivot(scenario, [base, *others]).agg(F.max(value))
    return wide.withColumns({f"{o}_minus_{base}": F.col(o) - F.col(base) for o in others})
