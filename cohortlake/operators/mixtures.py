"""Gaussian mixtures of groups too large for one task, by EM over partial sums.

The local form (``cluster.mixture_labels``) holds a group's values; here each round
of EM is one pass over the values in which every task adds up, for each group and
number of components, what the next parameters need. Only those sums and the
parameters reach the driver. Starts, stopping, choice by BIC and labels are those
of the local form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import written
from . import cluster
from .quantiles import exact_quantiles

#: Rows from which a group is fitted over partial sums.
LARGE = 200_000
_SUMS = "g int, k int, n long, likelihood double, weight array<double>, first array<double>, second array<double>"


@dataclass
class Fit:
    """One mixture: shares, means and variances, and how far it is."""

    share: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    likelihood: float = -np.inf
    done: bool = False


def _responsible(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each value, shares of the components in it)."""
    logs = np.log(fit.share) - 0.5 * (np.log(2 * np.pi * fit.var) + (x[:, None] - fit.mean) ** 2 / fit.var)
    top = logs.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return total, np.exp(logs - total[:, None])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    g, x = batch.column("g").to_numpy(), batch.column("x").to_numpy()
    for one in np.unique(g).tolist():
        at = np.flatnonzero(g == one)
        yield one, at, x[at]


def _summed(values: DataFrame, fits: dict[tuple[int, int], Fit], centres: dict[int, float], labels: bool) -> dict[tuple[int, int], tuple]:
    """(n, likelihood, weights, first and second moments about the group's centre) of
    each open fit; with ``labels`` each value counts for its likeliest component alone."""
    of: dict[int, list[int]] = {}
    for g, k in fits:
        of.setdefault(g, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for g, _, x in _parts(batch):
                for k in of.get(g, ()):
                    total, r = _responsible(x, fits[g, k])
                    if labels:
                        r = np.eye(k)[r.argmax(1)]
                    d = (x - centres[g])[:, None]
                    new = [len(x), total.sum(), r.sum(0), (r * d).sum(0), (r * d * d).sum(0)]
                    old = sums.get((g, k))
                    sums[g, k] = new if old is None else [a + b for a, b in zip(old, new)]
        if sums:
            rows = [(g, k, int(n), float(like), *(v.tolist() for v in moments)) for (g, k), (n, like, *moments) in sums.items()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["g", "k", "n", "likelihood", "weight", "first", "second"])

    added = lambda c: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(max(k for _, k in fits))])
    got = values.mapInArrow(run, _SUMS).groupBy("g", "k").agg(F.sum("n"), F.sum("likelihood"), *[added(c) for c in ("weight", "first", "second")]).collect()
    return {(r[0], r[1]): (r[2], r[3], *(np.array(v[: r[1]], float) for v in r[4:])) for r in got}


def fitted(values: DataFrame, counts: dict[int, int], most: int = 6, min_size: int = 10, tolerance: float = 10.0, rounds: int = 300) -> dict[int, tuple[Fit, np.ndarray]]:
    """(fit, cluster number of each component) of each group of ``values`` (g int, x
    double): the simplest mixture within ``tolerance`` of the best BIC whose clusters
    all hold ``min_size`` values; clusters are numbered from the greatest mean down."""
    ks = {g: range(1, max(1, min(most, n // min_size)) + 1) for g, n in counts.items()}
    asked = sorted({(i + 0.5) / k for k in range(1, most + 1) for i in range(k)})
    starts = {r["g"]: dict(zip(asked, r["quantiles"])) for r in exact_quantiles(values, ["g"], "x", asked).collect()}
    spread = {r["g"]: (r["mean"], r["var"]) for r in values.groupBy("g").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).collect()}
    centres = {g: m for g, (m, _) in spread.items()}
    fits = {}
    for g, some in ks.items():
        for k in some:
            fits[g, k] = Fit(np.full(k, 1 / k), np.array([starts[g][(i + 0.5) / k] for i in range(k)]), np.full(k, spread[g][1] / k + 1e-6))
    for _ in range(rounds):
        live = {key: f for key, f in fits.items() if not f.done}
        if not live:
            break
        for (g, k), (n, like, weight, first, second) in _summed(values, live, centres, False).items():
            f, weight = fits[g, k], weight + 1e-12
            at = first / weight
            f.done = abs(like - f.likelihood) < 1e-6 * n
            f.mean, f.share, f.likelihood = centres[g] + at, weight / weight.sum(), like
            f.var = np.maximum(second / weight - at * at, 0) + 1e-6
    sizes = _summed(values, fits, centres, True)
    out = {}
    for g, some in ks.items():
        valid = [(-2 * fits[g, k].likelihood + (3 * k - 1) * math.log(counts[g]), k) for k in some if sizes[g, k][2].min() >= min_size]
        k = min(k for bic, k in valid if bic <= min(valid)[0] + tolerance)  # one component always is valid
        _, _, weight, first, _ = sizes[g, k]
        order = np.argsort(-first / weight)
        number = np.empty(k, int)
        number[order] = np.arange(1, k + 1)
        out[g] = (fits[g, k], number)
    return out


def mixtures(df: DataFrame, group: str, key: str, value: str, large: int = LARGE, least: int = 50, most: int = 6, min_size: int = 10, tolerance: float = 10.0) -> DataFrame:
    """(group, key, value, cluster, method): one mixture per group. Groups of up to
    ``large`` values are fitted in a task each, others over partial sums, with the
    same result but for rounding. Null and NaN values are left out; a null group is a group.
    """
    spark = df.sparkSession
    if large < max(least, min_size):
        raise ValueError("groups fitted over partial sums must have enough values for one component")
    names = ("_group", "_key", "_value")
    plain = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip((group, key, value), names)])  # names of the caller can't clash with ours
    known = plain.where(~F.isnan(F.coalesce(F.col("_value").cast("double"), F.lit(float("nan")))))
    sizes = known.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).collect()  # at most rows / large
    settings = {"least": least, "most": most, "min_size": min_size, "tolerance": tolerance}
    columns = [group, key, value, "cluster", "method"]
    if not sizes:
        return cluster.mixtures(known, *names, **settings).toDF(*columns)
    kind = known.schema["_group"].dataType.simpleString()
    named = spark.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], f"_of {kind}, g int")
    joined = known.join(named, F.col("_group").eqNullSafe(F.col("_of")), "left").drop("_of")
    big = written(joined.where("g IS NOT NULL").withColumn("x", F.col("_value").cast("double")), "mixtures")
    fits = fitted(big.select("g", "x"), {i: r[1] for i, r in enumerate(sizes)}, most, min_size, tolerance)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, method = np.zeros(len(batch), np.int32), np.empty(len(batch), object)
            for g, at, x in _parts(batch):
                fit, number = fits[g]
                labels[at], method[at] = number[_responsible(x, fit)[1].argmax(1)], f"mixture_{len(number)}"
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(labels), pa.array(method, pa.string())], [*names, "cluster", "method"])

    kinds = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in names)
    done = big.mapInArrow(assign, f"{kinds}, cluster int, method string")
    return cluster.mixtures(joined.where("g IS NULL").drop("g"), *names, **settings).unionByName(done).toDF(*columns)
