"""Reference models: fitted scaler, principal axes and neighbour indexes that cases
are projected on, saved and loaded as one locked contract.

The parts agree on the order of features and on the set of rows, by hashes that
each part carries; a model whose parts differ is refused. A neighbour index that
is absent or doesn't fit is no reason to refuse: distances are then taken directly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.artefacts import Store, checksum
from ..sources.readers import written
from . import matrix, pivots
from .casework import case_summary, harmonise_cases
from .contract import ContractError, contract_hash


@dataclass
class Reference:
    """``features``: (position, feature_name, feature_type, median, mean, std, centre), in
    order; ``axes``: (component, variance, share, loading); ``rows``: (id, vec[, labels]);
    ``coordinates``: (id, scores)."""

    features: DataFrame
    axes: DataFrame
    rows: DataFrame
    coordinates: DataFrame
    indexes: dict[str, pivots.Index]
    contract: str
    row_set: str
    warnings: list[str] = field(default_factory=list)


_FEATURES = "position int, feature_name string, feature_type string, median double, mean double, std double, centre double"


def feature_contract(features: Sequence[tuple[str, str]]) -> str:
    """SHA-256 of the ordered feature names and their types."""
    return contract_hash({"features": [list(f) for f in features]})


def row_set(rows: DataFrame) -> str:
    """Of the ids, in whatever order."""
    n, digest = checksum(rows.select("id"), ["id"])
    return f"{n}-{digest}"


def scaled_vectors(cells: DataFrame, features: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(id, vec): the scaled cells of each row in the features' order. Cells that lack are an error downstream: lengths differ."""
    placed = cells.join(features.select(F.col("feature_name").alias(name), "position"), name)
    return placed.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("x")))), lambda c: c["x"]).alias("vec"))


def fit(long: DataFrame, rows: DataFrame, types: dict[str, str], components: int = 20, metrics: Sequence[str] = ("euclidean",), max_missing: float = 0.30, block_rows: int = 2000) -> Reference:
    """A model of long cells (row, feature, value) for every row of ``rows`` (row[, labels]).

    Features that miss too often are dropped, gaps take the median, and values are
    scaled by mean and deviation (0 becomes 1); types default to continuous.
    Features stand in the order of their names. Features are a bounded contract and
    reach the driver; rows don't.
    """
    spark = rows.sparkSession
    cells, params = matrix.impute_scale(long, rows.select("row"), max_missing=max_missing)
    known = sorted(params.select("feature", "median", "mean", "std").collect())
    if not known:
        raise ContractError("no feature is left")
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(known)], "position int, feature_name string")
    labels = [c for c in rows.columns if c != "row"]
    vectors = scaled_vectors(cells, names, "row", "feature", "scaled").join(rows.select(F.col("row").alias("id"), *labels), "id")
    vectors = written(vectors.select("id", "vec", *labels), "reference")
    mean, loadings, variances, shares = matrix.pca(vectors, components)
    made = [(i, r[0], types.get(r[0], "continuous"), float(r[1]), float(r[2]), float(r[3]), float(m)) for i, (r, m) in enumerate(zip(known, mean))]
    axes = [(i + 1, float(v), float(s), [float(x) for x in w]) for i, (v, s, w) in enumerate(zip(variances, shares, loadings))]
    indexes = {m: pivots.build(vectors, m, block_rows=block_rows) for m in metrics}
    return Reference(
        spark.createDataFrame(made, _FEATURES), spark.createDataFrame(axes, "component int, variance double, share double, loading array<double>"), vectors, matrix.project_arrays(vectors, mean, loadings), indexes,
        feature_contract([(r[1], r[2]) for r in made]), row_set(vectors),
    )


def save(model: Reference, store: Store, name: str) -> int:
    """The version under which the model was saved, all parts or none."""
    spark = model.rows.sparkSession
    part = {"contract": model.contract, "row_set": model.row_set}
    facts = {"contract": model.contract, "row_set": model.row_set, "features": dict(part), "axes": dict(part), "coordinates": dict(part), "indexes": {}}
    tables = {"features": model.features, "axes": model.axes, "rows": model.rows, "coordinates": model.coordinates}
    for metric, index in model.indexes.items():
        facts["indexes"][metric] = dict(part) | {"width": index.width}
        tables[f"index_{metric}"] = index.rows
        tables[f"pivots_{metric}"] = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(index.pivots)], "cell int, point array<double>")
    return store.save(name, tables, facts)


def load(store: Store, name: str, version: int | None = None, verify: bool = True) -> Reference:
    """The saved model. Raises ContractError where parts are lost or were changed,
    where they disagree on features or rows, where features repeat, deviations aren't
    positive, or values aren't finite. Indexes that don't fit are left out, with a warning."""
    saved = store.load(name, version, verify)
    t, facts = saved.tables, saved.facts
    lost = [p for p in ("features", "axes", "rows", "coordinates") if p not in t or p != "rows" and p not in facts]
    if lost:
        raise ContractError(f"{name}: the model lacks {lost}")
    features = t["features"].orderBy("position").collect()  # a bounded contract
    names = [r["feature_name"] for r in features]
    if not names or len(set(names)) < len(names) or [r["position"] for r in features] != list(range(len(names))):
        raise ContractError(f"{name}: features are none, repeat, or have no order")
    contract = feature_contract([(r["feature_name"], r["feature_type"]) for r in features])
    for part in ("features", "axes", "coordinates"):
        if facts[part].get("contract") != contract or facts.get("contract") != contract:
            raise ContractError(f"{name}: {part} are of another feature contract")
    if any(not np.isfinite([r["median"], r["mean"], r["std"], r["centre"]]).all() or r["std"] <= 0 for r in features):
        raise ContractError(f"{name}: the scaler has a deviation that is not positive, or values that are not finite")
    width = len(names)
    axes = t["axes"].collect()
    if sorted(r["component"] for r in axes) != list(range(1, len(axes) + 1)) or any(len(r["loading"]) != width or not np.isfinite(r["loading"]).all() for r in axes):
        raise ContractError(f"{name}: principal axes don't fit {width} features")
    rows_of = row_set(t["rows"])
    for part, found in (("rows", rows_of), ("coordinates", row_set(t["coordinates"]))):
        if found != facts["row_set"] or facts["coordinates"].get("row_set") != facts["row_set"]:
            raise ContractError(f"{name}: {part} are of another set of rows")
    bad = lambda c, n: (F.size(c) != n) | F.exists(c, lambda x: x.isNull() | ~S.finite(x))
    if not t["rows"].where(bad("vec", width)).isEmpty() or not t["coordinates"].where(bad("scores", len(axes))).isEmpty():
        raise ContractError(f"{name}: rows or coordinates have values that are not finite or of another length")
    model = Reference(t["features"], t["axes"], t["rows"], t["coordinates"], {}, contract, rows_of)
    for metric, of in facts.get("indexes", {}).items():
        why = None
        if f"index_{metric}" not in t or f"pivots_{metric}" not in t:
            why = "is lost"
        elif of.get("contract") != contract or of.get("width") != width:
            why = "is of another feature contract"
        elif of.get("row_set") != rows_of or row_set(t[f"index_{metric}"]) != rows_of:
            why = "is of another set of rows"
        if why:
            model.warnings.append(f"the {metric} index {why}; direct distances are used")
        else:
            points = np.array([r["point"] for r in t[f"pivots_{metric}"].orderBy("cell").collect()], float)  # pivots.PIVOTS at most
            model.indexes[metric] = pivots.indexed(metric, t[f"index_{metric}"], points, None)
    return model


@dataclass
class Projection:
    """``audit``: a row per case and feature; ``coordinates``: (id, scores); ``neighbours``:
    (query_id, rank, neighbour_id, distance, similarity); ``method``: how they were found."""

    audit: DataFrame
    coordinates: DataFrame
    neighbours: DataFrame
    method: str
    warnings: list[str]


def project(model: Reference, values: DataFrame, cases: DataFrame, k: int = 50, metric: str = "euclidean", direct: bool = False) -> Projection:
    """Cases (case_id; case_id, source_file, feature_name, raw_value) on the model.

    Lacking features take the reference's medians; ids of cases are not those of
    rows. A case that supplies no known feature, and (for cosines) one whose
    scaled vector is zero, raises, as bad values do. With fewer than k rows all
    are neighbours.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = cases.sparkSession
    features = model.features.select("feature_name", "feature_type", "median", "mean", "std")
    audit = harmonise_cases(values, cases, features)
    audit = written(audit, "projection")
    none = case_summary(audit).where("supplied = 0").limit(5).collect()
    if none:
        raise ContractError(f"no known feature is supplied by {[r['case_id'] for r in none]}")
    expected = audit.where("expected_in_reference")
    vectors = scaled_vectors(expected, model.features, "case_id", "feature_name", "scaled_value")
    if metric == "cosine" and not vectors.where(~F.exists("vec", lambda x: x != 0)).isEmpty():
        raise ContractError("a case's scaled vector is zero: it has no cosines")
    warnings = list(model.warnings)
    index = None if direct else model.indexes.get(metric)
    if direct:
        warnings.append("direct distances were asked for")
    elif index is None and not any(metric in w for w in warnings):
        warnings.append(f"there is no {metric} index; direct distances are used")
    if index is not None:
        found, _ = pivots.search(index, vectors, k, own=True)
    else:
        found = matrix.nearest(model.rows.select("id", "vec"), vectors, k, metric, own=True)
    centre = [r["centre"] for r in model.features.orderBy("position").collect()]
    loadings = np.array([r["loading"] for r in model.axes.orderBy("component").collect()])
    return Projection(audit, matrix.project_arrays(vectors, np.array(centre), loadings), found.withColumn("similarity", 1 / (1 + F.col("distance"))), "index" if index is not None else "direct", warnings)


def label_shares(neighbours: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Per case and label of its neighbours: count, median and least distance, share of the
    similarity, and rank (share, least distance, label)."""
    named = neighbours.join(rows.select(F.col("id").alias("neighbour_id"), label), "neighbour_id")
    per = named.groupBy("query_id", label).agg(F.count(F.lit(1)).alias("n_neighbours"), F.median("distance").alias("median_distance"), F.min("distance").alias("min_distance"), F.sum("similarity").alias("weight"))
    total = Window.partitionBy("query_id")
    shared = per.withColumn("share", F.coalesce(F.col("weight") / F.sum("weight").over(total), F.lit(0.0)))
    order = total.orderBy(F.desc(F.round("share", 12)), "min_distance", label)
    return shared.withColumn("rank", F.row_number().over(order)).drop("weight")
