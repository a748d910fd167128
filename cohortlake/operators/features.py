"""Feature names, kinds and catalogues, and the preparation of feature tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Source layer and modality of each feature class.
LAYERS = {
    "mutation_count_proxy": ("somatic_mutation", "WES"),
    "driver_mutation_binary": ("somatic_mutation", "WES"),
    "driver_mutation_count": ("somatic_mutation", "WES"),
    "purity_ploidy": ("purity_ploidy", "WES"),
    "copy_number_aneuploidy": ("aneuploidy_arm_level_copy_number", "WES"),
    "expression_pathway_score": ("expression_pathway", "WTS"),
    "expression_pca": ("expression_pca", "WTS"),
}
#: Features that are counts though their class is not.
COUNTS = ["arm_gain_count", "arm_loss_count", "total_arm_alteration_count"]
#: Project-level categories, by pattern; the first that fits.
CATEGORIES = [
    ("mutation_count_proxy", r"^tmb_proxy_"),
    ("driver_mutation_prevalence", r"^mutation_prevalence_"),
    ("copy_number_purity_ploidy", r"^median_(purity|ploidy|aneuploidy_score|fraction_genome_altered|arm_gain_count|arm_loss_count|total_arm_alteration_count|copy_number_complexity_score)$"),
    ("expression", r"^median_.*score$|^median_lineage_or_tissue_PC"),
]


def driver_names(gene: Column) -> tuple[Column, Column]:
    """Names of a gene's binary and count features."""
    return F.concat(F.lit("driver_mutation_"), gene), F.concat(F.lit("driver_mutation_count_"), gene)


def category(name: Column) -> Column:
    """The project-level category of a feature name."""
    return S.first_match([(name.rlike(pattern), label) for label, pattern in CATEGORIES], "other")


def described(features: DataFrame) -> DataFrame:
    """features (name, feature_class) with type, source layer and modality; an unknown class raises."""
    bad = features.where(~F.coalesce(F.col("feature_class").isin(list(LAYERS)), F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"features without a class: {[r['name'] for r in bad]}")
    kind = S.first_match([(F.col("feature_class") == "driver_mutation_binary", "binary"), (F.col("feature_class").isin("driver_mutation_count", "mutation_count_proxy") | F.col("name").isin(COUNTS), "count")], "continuous")
    of = lambda i: S.first_match([(F.col("feature_class") == c, v[i]) for c, v in LAYERS.items()], None)
    return features.withColumns({"feature_type": kind, "source_layer": of(0), "clinical_modality": of(1)})


def feature_catalogue(features: DataFrame, parameters: DataFrame) -> DataFrame:
    """Described features with the fitted parameters; ``retained`` where there are any."""
    return described(features).join(parameters.withColumn("retained", F.lit(True)), "name", "left").fillna(False, ["retained"])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (), every: bool = False) -> list[str]:
    """Columns in which any text (or, with ``every``, all text) reads as a finite
    number, found in one pass; sources and notes are never numeric."""
    names = [c for c in df.columns if c not in exclude and not c.endswith(("_source", "_notes"))]
    value = lambda c: S.number(F.col(f"`{c}`").cast("string")).isNotNull()
    given = lambda c: F.col(f"`{c}`").isNotNull()
    seen = df.agg(*[F.count(F.when(value(c), 1)).alias(f"n{i}") for i, c in enumerate(names)], *[F.count(F.when(given(c) & ~value(c), 1)).alias(f"t{i}") for i, c in enumerate(names)]).first() if names else {}
    return [c for i, c in enumerate(names) if seen[f"n{i}"] and not (every and seen[f"t{i}"])]


def by_number(columns: Sequence[str]) -> list[str]:
    """Names in the order of the number at their end; those without come last."""
    key = lambda c: (int(m[0]) if (m := re.search(r"\d+$", c)) else 10**9, c)
    return sorted(columns, key=key)


def project_features(table: DataFrame, keys: Sequence[str], support: str, name: str, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(features, support): all columns but the keys, the support and ``missingness_*``
    as prefixed numbers; the support column under the given name."""
    number = lambda c: S.number(F.col(f"`{c}`").cast("string"))
    rest = [c for c in table.columns if c not in keys and c != support and not c.startswith("missingness_")]
    return table.select(*keys, *[number(c).alias(prefix + c) for c in rest]), table.select(*keys, number(support).alias(name))


def replaced_columns(df: DataFrame, update: DataFrame, on: Sequence[str]) -> DataFrame:
    """The update's columns in place of those of the same names; keys it repeats give one row, the least."""
    values = [c for c in update.columns if c not in on]
    one = update.groupBy(*on).agg(F.min(F.struct(*values)).alias("_u"))
    return df.drop(*values).join(one, list(on), "left").select(*[c for c in df.columns if c not in values], *[F.col(f"_u.{c}").alias(c) for c in values])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns and missing values of the named columns as their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def member_groups(groups: DataFrame, available: DataFrame, sep: str = ";") -> DataFrame:
    """groups (group_name, candidates text) with the members that are available
    (``available``: member), in the candidates' order, and their number."""
    one = groups.select("group_name", F.posexplode_outer(F.split("candidates", sep)).alias("at", "member"))
    kept = one.join(available.select("member").distinct().withColumn("_there", F.lit(True)), "member", "left")
    members = F.array_sort(F.collect_list(F.when(F.col("_there"), F.struct("at", "member"))))
    return kept.groupBy("group_name").agg(F.array_join(F.transform(members, lambda m: m["member"]), sep).alias("included"), F.count("_there").alias("n_members"))


def cumulative_share(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Shares of the total and their running sum (bounded tables: components, labels)."""
    w = Window.partitionBy(*by)
    return df.withColumn("share", F.col(value) / F.sum(value).over(w)).withColumn("cumulative_share", F.sum(F.col(value)).over(w.orderBy(order)) / F.sum(value).over(w))


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's share of the whole column: one row of totals is joined to all."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(total, how="cross").withColumn(name, F.col(value) / F.when(F.col("_total") != 0, F.col("_total"))).drop("_total")


def definition_table(spark: SparkSession, groups: dict[str, Sequence[str]]) -> DataFrame:
    """{class: names} as (name, feature_class); a name in two classes raises."""
    rows = [(n, c) for c, names in groups.items() for n in names]
    twice = sorted({n for n, _ in rows if sum(m == n for m, _ in rows) > 1})
    if twice:
        raise ValueError(f"features of two classes: {twice}")
    return spark.createDataFrame(rows, "name string, feature_class string")
