"""Neighbour votes: label shares, ambiguity, validation, calibration, ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the ambiguity classes.
AMBIGUITY = {"coverage": 0.50, "low_top": 0.65, "low_margin": 0.25, "low_entropy": 0.60, "high_top": 0.40, "high_margin": 0.10, "high_entropy": 0.80, "many": 8, "meaningful": 0.05}


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def votes(neighbours: DataFrame, labels: DataFrame, query: str = "query_id", neighbour: str = "neighbour_id", id_col: str = "id", label: str = "label") -> DataFrame:
    """(query, label, weight, n, nearest, score, rank): shares of 1 / (1 + distance); ties by count, then label."""
    named = neighbours.join(labels.select(F.col(id_col).alias(neighbour), F.col(label).alias("label")), neighbour)
    per = named.groupBy(query, "label").agg(F.sum(similarity(F.col("distance"))).alias("weight"), F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"))
    scored = per.withColumn("score", F.col("weight") / F.sum("weight").over(Window.partitionBy(query)))
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 12)), F.desc("n"), "label")
    return scored.withColumn("rank", F.row_number().over(order))


def ambiguity(top1: Column, margin: Column, entropy: Column, meaningful: Column, coverage: Column, agree: Column, limits: dict[str, float] = AMBIGUITY) -> Column:
    """Uninterpretable before low, low before high, else moderate."""
    bad = (coverage < limits["coverage"]) | (top1 <= 0)
    low = (top1 >= limits["low_top"]) & (margin >= limits["low_margin"]) & (entropy <= limits["low_entropy"]) & agree
    high = (top1 < limits["high_top"]) | (margin < limits["high_margin"]) | (entropy >= limits["high_entropy"]) | (meaningful >= limits["many"])
    return F.when(bad, "uninterpretable_due_to_missing_features").when(low, "low_ambiguity").when(high, "high_ambiguity").otherwise("moderate_ambiguity")


def predictions(voted: DataFrame, truth: DataFrame, query: str = "query_id", id_col: str = "id", label: str = "label") -> DataFrame:
    """One row per query: predicted and true label, top score, margin, entropy, rank of the truth (labels + 1 if absent)."""
    true = truth.select(F.col(id_col).alias(query), F.col(label).alias("true_label"))
    top = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    n = F.count(F.lit(1))
    entropy = F.when(n > 1, -F.sum(F.col("score") * F.ln("score")) / F.ln(n)).otherwise(0.0)
    out = voted.join(true, query).groupBy(query, "true_label").agg(
        top(1, "label").alias("predicted"), top(1, "score").alias("top1_score"), (top(1, "score") - F.coalesce(top(2, "score"), F.lit(0.0))).alias("margin"), entropy.alias("entropy"),
        F.sum((F.col("score") >= AMBIGUITY["meaningful"]).cast("int")).alias("meaningful"), F.coalesce(F.max(F.when(F.col("label") == F.col("true_label"), F.col("rank"))), n + 1).alias("true_rank"))
    return out.withColumn("correct", F.col("true_rank") == 1)


def performance(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, top-1/3/5 accuracy, mean margin and entropy, per key or over all."""
    at = lambda k: F.avg((F.col("true_rank") <= k).cast("double"))
    return predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), at(1).alias("top1"), at(3).alias("top3"), at(5).alias("top5"), F.median("margin").alias("median_margin"), F.avg("entropy").alias("mean_entropy"))


def thresholds(df: DataFrame, metric: str, correct: str, higher: bool = True) -> dict[str, float]:
    """Cut-offs of a reliability metric by quantile search, from one aggregation per step.

    High: the first of the quantiles 0.60, 0.65 ... 0.95 whose upper tail reaches
    min(0.95, baseline + 0.2), else the most accurate; low: of 0.40, 0.35 ... 0.05
    the first whose lower tail falls to max(0.25, baseline - 0.2), else the least
    accurate. Tails need max(5, 2 %) rows; crossing cut-offs become terciles.
    """
    r = df.select((F.col(metric) if higher else -F.col(metric)).alias("r"), F.col(correct).cast("double").alias("c"))
    highs, lows = [0.60 + 0.05 * i for i in range(8)], [0.40 - 0.05 * i for i in range(8)]
    asked = highs + lows + [1 / 3, 0.5, 2 / 3]
    row = r.agg(F.count(F.lit(1)), F.avg("c"), F.percentile("r", F.array(*[F.lit(q) for q in asked]))).first()
    n, base, cuts = row[0], row[1], row[2]
    if not n:
        raise ValueError("no rows to calibrate on")
    tails = []
    for i, cut in enumerate(cuts[:16]):
        inside = (F.col("r") >= cut) if i < 8 else (F.col("r") <= cut)
        tails += [F.sum(inside.cast("int")), F.avg(F.when(inside, F.col("c")))]
    got = r.agg(*tails).first()
    least = max(5, -(-n * 2 // 100))
    found = [(i, cuts[i], got[2 * i + 1]) for i in range(16) if got[2 * i] >= least]
    up, down = [f for f in found if f[0] < 8], [f for f in found if f[0] >= 8]
    good = [f for f in up if f[2] >= min(0.95, base + 0.2)]
    poor = [f for f in down if f[2] <= max(0.25, base - 0.2)]
    high = (good or sorted(up, key=lambda f: (-f[2], f[0])))[0][1] if up else cuts[18]
    low = (poor or sorted(down, key=lambda f: (f[2], f[0])))[0][1] if down else cuts[16]
    if low >= high:
        low, high = cuts[16], cuts[18]
    return {"low": low, "middle": cuts[17], "high": high, "baseline": base, "sign": 1.0 if higher else -1.0}


def tier(metric: Column, cut: dict[str, float]) -> Column:
    """0, 1 or 2: low, moderate, high reliability."""
    r = metric * cut["sign"]
    return F.when(r >= cut["high"], 2).when(r <= cut["low"], 0).otherwise(1)


def combined_tier(tiers: Sequence[Column]) -> Column:
    total = sum(tiers[1:], tiers[0])
    return F.when(total <= 2, "low_confidence").when(total >= 6, "high_confidence").otherwise("moderate_confidence")
