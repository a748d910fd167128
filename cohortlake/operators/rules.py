"""Declarative three-valued rules over long case values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strengths in order, and comparison names.
STRENGTHS = ["weak", "moderate", "strong"]
COMPARISONS = ["gt", "ge", "lt", "le", "eq"]


def validate_rules(rules: Sequence[dict], features: Sequence[str], targets: Sequence[str]) -> None:
    """Unique ids; exactly one of all/any, not empty; known features, targets, comparisons and strengths."""
    seen: set[str] = set()
    for r in rules:
        modes = [m for m in ("all", "any") if m in r["condition"]]
        if r["rule_id"] in seen:
            raise ValueError(f"repeated rule {r['rule_id']}")
        seen.add(r["rule_id"])
        if len(modes) != 1 or not r["condition"][modes[0]]:
            raise ValueError(f"{r['rule_id']}: exactly one of all and any, with clauses")
        for c in r["condition"][modes[0]]:
            if c["feature"] not in features or c["operator"] not in COMPARISONS:
                raise ValueError(f"{r['rule_id']}: unknown feature or comparison in {c}")
        if r.get("strength", "weak") not in STRENGTHS or not {*r.get("supports", []), *r.get("argues_against", [])} <= set(targets):
            raise ValueError(f"{r['rule_id']}: unknown strength or target")


def clause_table(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    rows = [(r["rule_id"], m, c["feature"], c["operator"], float(c["threshold"])) for r in rules for m in ("all", "any") if m in r["condition"] for c in r["condition"][m]]
    return spark.createDataFrame(rows, "rule_id string, mode string, feature string, operator string, threshold double")


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    near = F.abs(value - threshold) <= 1e-8 + 1e-5 * F.abs(threshold)
    return F.when(operator == "gt", value > threshold).when(operator == "ge", value >= threshold).when(operator == "lt", value < threshold).when(operator == "le", value <= threshold).when(operator == "eq", near)


def evaluate(clauses: DataFrame, values: DataFrame, case: str = "case_id", cases: DataFrame | None = None) -> DataFrame:
    """(case, rule, evaluable, triggered). values: (case, feature, value, supplied).

    A clause on a value that wasn't supplied is unknown. 'all' with an unknown
    clause can't be evaluated, even if another is false; 'any' is true as soon
    as one is true, unknown if none is and some are unknown.
    """
    everyone = cases if cases is not None else values.select(case).distinct()
    grid = everyone.join(clauses, how="cross")  # the rules are a bounded contract
    joined = grid.join(values, [case, "feature"], "left")
    result = F.when(F.coalesce("supplied", F.lit(False)) & F.col("value").isNotNull(), compare(F.col("value"), F.col("operator"), F.col("threshold")))
    per = joined.withColumn("_is", result).groupBy(case, "rule_id", "mode").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_is"), 1).otherwise(0)).alias("_yes"), F.count("_is").alias("_known"))
    every = F.col("mode") == "all"
    evaluable = F.when(every, F.col("_known") == F.col("_n")).otherwise((F.col("_yes") > 0) | (F.col("_known") == F.col("_n")))
    triggered = F.when(every, F.col("_yes") == F.col("_n")).otherwise(F.col("_yes") > 0)
    return per.select(case, "rule_id", evaluable.alias("evaluable"), (evaluable & triggered).alias("triggered"))


def strongest(strength: Column) -> Column:
    """Aggregate: the highest strength."""
    order = F.lit(None).cast("int")
    for i, s in enumerate(STRENGTHS):
        order = F.when(strength == s, i).otherwise(order)
    return F.max_by(strength, order)


def evidence(evaluated: DataFrame, rules: DataFrame, weights: dict[str, float] | None = None, case: str = "case_id") -> DataFrame:
    """Triggered findings by target, for and against.

    rules: (rule_id, finding, strength, supports array[, argues_against array]).
    ``strength`` is the highest of the supporting rules (null without any);
    ``net`` adds the rules' weights, opposing ones negative, clipped to -1..1.
    """
    weights = weights or {s: (i + 1) / len(STRENGTHS) for i, s in enumerate(STRENGTHS)}
    against = F.col("argues_against") if "argues_against" in rules.columns else F.array().cast("array<string>")
    side = lambda targets, sign: F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: F.struct(t.alias("target"), F.lit(sign).alias("sign")))
    hit = evaluated.where("triggered").join(rules, "rule_id").withColumn("_t", F.explode(F.concat(side(F.col("supports"), 1), side(against, -1))))
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("strength") == name, w).otherwise(weight)
    is_for = F.col("_t.sign") > 0
    out = hit.groupBy(case, F.col("_t.target").alias("target")).agg(
        F.sum(F.when(is_for, 1).otherwise(0)).alias("n_rules"), F.sum(F.when(is_for, 0).otherwise(1)).alias("n_against"), strongest(F.when(is_for, F.col("strength"))).alias("strength"),
        F.sum(F.col("_t.sign") * weight).alias("net"), F.array_join(F.array_sort(F.collect_set(F.when(is_for, F.col("finding")))), "; ").alias("findings"), F.array_join(F.array_sort(F.collect_set(F.when(~is_for, F.col("finding")))), "; ").alias("findings_against"),
    )
    return out.withColumn("net", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "net")))
