"""Matrices in long form (row, feature, value): imputing, scaling, distances, neighbours, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

#: Rows that a driver-side matrix may have at most; rows from which medians are narrowed down instead of held in one buffer.
SMALL, LARGE = 4000, 2_000_000
#: Pairs of a query and a row that a task holds distances of at once.
PAIRS = 500_000


def feature_profile(long: DataFrame, n_rows: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per feature: missing share (absent cells count as missing), spread, distinct values
    (beyond ``LARGE`` rows only whether there are more than one), median."""
    v = F.col(value)
    facts = [
        ((F.lit(n_rows) - F.count(v)) / F.lit(float(max(1, n_rows)))).alias("missing_fraction"),
        F.count(v).alias("n_observed"),
        F.stddev_samp(v).alias("sd_sample"),
        F.stddev_pop(v).alias("sd_population"),
    ]
    if n_rows <= LARGE:
        return long.groupBy(feature).agg(*facts, F.count_distinct(v).alias("n_distinct"), F.median(v).alias("median"))
    several = F.when(F.min(v) < F.max(v), 2).otherwise(F.least(F.count(v), F.lit(1))).cast("long")  # one, or more
    middle = exact_quantiles(long, [feature], value, [0.5]).select(F.col(feature).alias("_f"), F.col("quantiles")[0].alias("median"))
    return long.groupBy(feature).agg(*facts, several.alias("n_distinct")).join(middle, F.col(feature).eqNullSafe(F.col("_f"))).drop("_f")


def kept_features(profile: DataFrame, max_missing: float = 0.30, drop_constant: bool = False) -> DataFrame:
    """Dropped only if the missing share exceeds the limit; optionally also without spread."""
    out = profile.where((F.col("missing_fraction") <= max_missing) & (F.col("n_observed") > 0))
    return out.where(F.coalesce(F.col("sd_sample") > 1e-8, F.lit(False)) & (F.col("n_distinct") > 1)) if drop_constant else out


def impute_scale(long: DataFrame, rows: DataFrame, row: str = "row", max_missing: float = 0.30, ddof: int = 0, drop_constant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, parameters): kept features for every row, gaps filled with the median,
    scaled by mean and standard deviation (0 or undefined becomes 1)."""
    n = rows.count()
    kept = kept_features(feature_profile(long, n), max_missing, drop_constant)
    grid = rows.select(row).join(kept.select("feature", "median", "missing_fraction"), how="cross")  # the features are the matrix's columns
    filled = grid.join(long.select(row, "feature", "value"), [row, "feature"], "left").select(row, "feature", F.coalesce("value", "median").alias("value"), F.col("value").isNull().alias("imputed"), "median", "missing_fraction")
    spread = F.stddev_pop("value") if ddof == 0 else F.stddev_samp("value")
    params = filled.groupBy("feature").agg(F.first("median").alias("median"), F.first("missing_fraction").alias("missing_fraction"), F.avg("value").alias("mean"), spread.alias("raw_std"))
    params = params.withColumn("std", F.when(F.col("raw_std") > 0, F.col("raw_std")).otherwise(1.0)).drop("raw_std")
    cells = filled.drop("median", "missing_fraction").join(params.select("feature", "mean", "std"), "feature")
    return cells.select(row, "feature", "value", "imputed", ((F.col("value") - F.col("mean")) / F.col("std")).alias("scaled")), params


def zscores(long: DataFrame, by: str = "feature", value: str = "value") -> DataFrame:
    """Sample z-scores within ``by``; null where there is no spread."""
    of = long.groupBy(by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))  # one row each, combined before the shuffle
    z = (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd"))
    return long.join(of, by, "left").withColumn("z", z).drop("_mean", "_sd")


def library_normalised(long: DataFrame, sample: str, kind: str = "counts", value: str = "value") -> DataFrame:
    """counts: log2(1 + counts per million); linear: log2(1 + x); log: as it is. No positive library: null."""
    if kind == "log":
        return long.withColumn("normalised", F.col(value))
    if kind == "linear":
        return long.withColumn("normalised", F.log2(1 + F.when(F.col(value) >= 0, F.col(value))))
    sizes = long.groupBy(sample).agg(F.sum(value).alias("_size"))
    size = F.when(F.col("_size") > 0, F.col("_size"))
    return long.join(sizes, sample, "left").withColumn("normalised", F.log2(1 + F.col(value) / size * 1e6)).drop("_size")


def set_scores(z: DataFrame, sets: DataFrame, row: str, feature: str = "feature") -> DataFrame:
    """Mean z of each set's features that are present. sets: (set, feature)."""
    return z.join(sets, feature).where(F.col("z").isNotNull()).groupBy(row, "set").agg(F.avg("z").alias("score"), F.count(F.lit(1)).alias("n_features"))


def bounded_rows(long: DataFrame, row: str, most: int = SMALL) -> DataFrame:
    """The table itself; raises before any pairs are made if it has more rows than all pairs may be asked of."""
    n = long.select(row).distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"all pairs of more than {most} rows; nearest() finds the nearest ones")
    return long


def gower(long: DataFrame, row: str = "row", weights: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) for a < b: weighted mean of |x - y| / range over features both
    have, for at most ``SMALL`` rows."""
    known = bounded_rows(long, row).where(F.col("value").isNotNull())
    spans = known.groupBy("feature").agg((F.max("value") - F.min("value")).alias("_span"))
    unit = known.join(spans, "feature").withColumn("u", F.col("value") / F.when(F.col("_span") > 0, F.col("_span")))
    unit = unit.join(weights, "feature") if weights is not None else unit.withColumn("weight", F.lit(1.0))
    a, b = unit.select(F.col(row).alias("a"), "feature", F.col("u").alias("ua"), "weight"), unit.select(F.col(row).alias("b"), "feature", F.col("u").alias("ub"))
    part = F.col("weight") * F.abs(F.coalesce(F.col("ua") - F.col("ub"), F.lit(0.0)))
    return a.join(b, "feature").where("a < b").groupBy("a", "b").agg((F.sum(part) / F.sum("weight")).alias("distance"))


def gower_scenarios(long: DataFrame, classes: DataFrame, weights: DataFrame, row: str = "row") -> DataFrame:
    """(scenario, a, b, distance) for a < b: Gower distances under every scenario of class
    weights, from one pass over the pairs. classes: (feature, class); weights: (scenario,
    class, weight), both bounded contracts.

    A distance is a ratio of two sums over features, which are kept for each class;
    a scenario weighs the classes' sums. Features of no class take no part; a class
    that a scenario doesn't name has weight 0. At most ``SMALL`` rows.
    """
    known = bounded_rows(long, row).where(F.col("value").isNotNull()).join(classes, "feature")
    spans = known.groupBy("feature").agg((F.max("value") - F.min("value")).alias("_span"))
    unit = known.join(spans, "feature").withColumn("u", F.col("value") / F.when(F.col("_span") > 0, F.col("_span")))
    a, b = unit.select(F.col(row).alias("a"), "feature", "class", F.col("u").alias("ua")), unit.select(F.col(row).alias("b"), "feature", F.col("u").alias("ub"))
    apart = F.abs(F.coalesce(F.col("ua") - F.col("ub"), F.lit(0.0)))
    sums = a.join(b, "feature").where("a < b").groupBy("a", "b", "class").agg(F.sum(apart).alias("s"), F.count(F.lit(1)).alias("n"))
    weight = F.col("weight")
    total = sums.join(weights, "class").groupBy("scenario", "a", "b").agg(F.sum(weight * F.col("s")).alias("s"), F.sum(weight * F.col("n")).alias("n"))
    return total.where("n > 0").select("scenario", "a", "b", (F.col("s") / F.col("n")).alias("distance"))


def correlation_distance(long: DataFrame, row: str = "row") -> DataFrame:
    """(a, b, distance) for a < b: 1 - Pearson's r over shared features, r clipped; 0
    where r is undefined. At most ``SMALL`` rows."""
    long = bounded_rows(long, row)
    a, b = long.select(F.col(row).alias("a"), "feature", F.col("value").alias("x")), long.select(F.col(row).alias("b"), "feature", F.col("value").alias("y"))
    s = a.join(b, "feature").where("a < b and x is not null and y is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.col("c") / F.when(F.col("sx") * F.col("sy") > 0, F.col("sx") * F.col("sy"))
    return s.select("a", "b", F.coalesce(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)), F.lit(0.0)).alias("distance"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine, clipped; a zero vector has similarity 0."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(dot(x, y) / F.when(norm > 0, norm), F.lit(0.0))))


def vector_rows(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The column ``vec`` as a matrix."""
    flat = table.column("vec")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(table), -1)


def best_pairs(k: int, metric: str, group: str | None = None, own: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of queries and one of rows: the k best rows of each query, as one
    numpy product; distances of the candidates that it leaves are taken from differences.
    Rows of the query's own id are left out unless ``own``, and rows of its group.
    A query may name a ``limit``: what is farther is left out, what is as far stays."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0))]
        if len(left) and len(right):
            right = right.sort_by("id")
            q, r = vector_rows(left), vector_rows(right)
            qi, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
            qg, rg = (np.array(t.column(group).to_pylist()) if group else None for t in (left, right))
            limit = left.column("limit").to_numpy() if "limit" in left.column_names else None
            nq, nr = (q * q).sum(1), (r * r).sum(1)
            step = max(1, PAIRS // len(r))
            for s in range(0, len(q), step):
                part = slice(s, s + step)
                d = q[part] @ r.T
                if metric == "cosine":
                    norm = np.outer(nq[part], nr)
                    np.sqrt(norm, out=norm)
                    d[~(norm > 0)] = 0
                    np.divide(d, norm, out=d, where=norm > 0)
                    np.subtract(1, np.clip(d, -1, 1, out=d), out=d)
                else:
                    d *= -2
                    d += nr
                    d += nq[part, None]
                out = np.zeros(d.shape, bool) if own else qi[part, None] == ri
                if group:
                    out |= qg[part, None] == rg
                d[out] = np.inf
                kth = np.partition(d, min(k, len(r)) - 1, axis=1)[:, min(k, len(r)) - 1]
                slack = 1e-9 * (nq[part] + nr.max()) if metric != "cosine" else 0
                row, col = np.nonzero((d <= (kth + slack)[:, None]) & np.isfinite(d))
                exact = d[row, col] if metric == "cosine" else np.sqrt(((r[col] - q[s + row]) ** 2).sum(1))
                order = np.lexsort((ri[col], exact, row))
                row, col, exact = row[order], col[order], exact[order]
                first = np.searchsorted(row, np.arange(len(d)))
                keep = np.arange(len(row)) - first[row] < k
                if limit is not None:
                    keep &= exact <= limit[s + row]
                found.append((qi[s + row[keep]], ri[col[keep]], exact[keep]))
        a, b, c = (np.concatenate([x[j] for x in found]) for j in range(3))
        return pa.table({"query_id": a, "neighbour_id": b, "distance": c})

    return meet


def block_pairs(rows: DataFrame, queries: DataFrame, columns: Sequence[str], block_rows: int):
    """Blocks of queries, each with each block of rows, grouped together."""
    n_rows = rows.count()
    i_blocks = max(1, -(-queries.count() // block_rows))
    spread = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // i_blocks)
    j_blocks = max(1, -(-n_rows // (4 * block_rows)), min(spread, n_rows // 200))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(*columns).withColumn("i", block(i_blocks, 0)).withColumn("j", every(j_blocks))
    dealt = rows.select(*columns).withColumn("j", block(j_blocks, 1)).withColumn("i", every(i_blocks))
    return asked.groupBy("i", "j").cogroup(dealt.groupBy("i", "j"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", group: str | None = None, block_rows: int = 4000, own: bool = False) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): exact k nearest of ``rows`` (id, vec
    array<double>[, group]) for each query; itself (unless ``own``), and rows of its
    group, are left out.

    A grid of query blocks and row blocks: each pair of blocks is one numpy
    product in one task, which hands on its k best for each query. A row is
    shipped once per query block, a query once per row block; this is brute
    force, for query sets of up to some hundred thousands (``pivots`` visits fewer
    pairs of blocks). Ties go to the smaller id.
    """
    cols = ["id", "vec"] + ([group] if group else [])
    found = block_pairs(rows, queries, cols, block_rows).applyInArrow(best_pairs(k, metric, group, own), "query_id long, neighbour_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def nearest_sets(rows: DataFrame, queries: DataFrame, k: int, sets: dict[str, Sequence[float]], block_rows: int = 4000) -> DataFrame:
    """(feature_set, query_id, rank, neighbour_id, distance): the exact k nearest rows
    for each query under each set of feature weights, in one pass.

    Each pair of blocks meets once; a set is one product in single precision over
    its features, which leaves the rows that may be among the nearest, and those
    are compared in double precision. A set of some features has weights 0 and 1.
    Weights aren't negative; a set without weights raises. Ties go to the smaller id.
    """
    names = list(sets)
    weights = np.array([sets[n] for n in names], float)
    if not names or (weights < 0).any() or (weights.sum(1) <= 0).any() or not np.isfinite(weights).all():
        raise ValueError("each set needs weights that are not negative, and one above 0")
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        found = [(none, none, none, np.zeros(0))]
        if len(left) and len(right):
            right = right.sort_by("id")
            q, r = vector_rows(left), vector_rows(right)
            qi, ri = left.column("id").to_numpy(), right.column("id").to_numpy()
            step = max(1, PAIRS // len(r))
            size = max((float(np.abs(x[np.isfinite(x)]).max(initial=0)) for x in (q, r))) or 1.0
            sides = []
            for weight in weights:
                columns = np.flatnonzero(weight)
                a, b = (np.nan_to_num(x[:, columns] / size, nan=0, posinf=0, neginf=0) * np.sqrt(weight[columns]) for x in (q, r))
                aa, bb = (a * a).sum(1), (b * b).sum(1)
                ask = np.column_stack([-2 * a, aa, np.ones(len(a))]).astype(np.float32)
                have = np.column_stack([b, np.ones(len(b)), bb]).astype(np.float32).T
                slack = 8e-7 * (len(columns) + 2) * (aa + bb.max()) + 1e-30  # more than single precision may lose
                lost = [np.flatnonzero(~np.isfinite(x[:, columns]).all(1)) for x in (q, r)]
                sides.append((ask, np.ascontiguousarray(have), slack, *lost))
            at = min(k, len(r)) - 1
            for s in range(0, len(q), step):
                part = slice(s, s + step)
                same_row, same_col = np.nonzero(qi[part, None] == ri)
                for i, (weight, (ask, have, slack, no_q, no_r)) in enumerate(zip(weights, sides)):
                    d = ask[part] @ have
                    d[same_row, same_col] = np.inf
                    d[:, no_r] = np.inf
                    kth = d.min(1) if at == 0 else np.partition(d, at, axis=1)[:, at]
                    row, col = np.nonzero(d <= (kth + 2 * slack[part])[:, None])
                    fits = np.isfinite(d[row, col]) & ~np.isin(s + row, no_q)
                    row, col = row[fits], col[fits]
                    exact = np.sqrt(((r[col] - q[s + row]) ** 2) @ weight)
                    order = np.lexsort((ri[col], exact, row))
                    row, col, exact = row[order], col[order], exact[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row] < k
                    found.append((np.full(keep.sum(), i), qi[s + row[keep]], ri[col[keep]], exact[keep]))
        return pa.table({n: np.concatenate([f[j] for f in found]) for j, n in enumerate(("s", "query_id", "neighbour_id", "distance"))})

    met = block_pairs(rows, queries, ["id", "vec"], block_rows).applyInArrow(meet, "s long, query_id long, neighbour_id long, distance double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("s", "query_id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
    return ranked.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("s")).alias("feature_set"), "query_id", "rank", "neighbour_id", "distance")


def nearest_sql(rows: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", digits: int = 9) -> DataFrame:
    """The same for a small stated query set, in expressions only; distances are
    rounded, so that equal ones tie. The queries are broadcast if they are few."""
    q = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("_q"))
    few = queries.count() <= SMALL
    pairs = rows.join(F.broadcast(q) if few else q, F.col("id") != F.col("query_id"))
    d = F.round((euclidean if metric == "euclidean" else cosine_distance)(F.col("vec"), F.col("_q")), digits)
    out = pairs.select("query_id", F.col("id").alias("neighbour_id"), d.alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")


def covariance_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Per partition: count, sums and products of the vectors (additive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = np.array(b.column("vec").to_pylist(), float).reshape(len(b), width)
            n, s, p = n + len(b), s + x.sum(0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([p.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "p"])

    return rows.select("vec").mapInArrow(run, "n long, s array<double>, p array<double>")


def pca(rows: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, loadings by component, variances, shares) of (id, vec); each component's
    largest loading is positive. Only width x width sums reach the driver."""
    width = rows.select(F.size("vec")).first()[0]
    total = [0, np.zeros(width), np.zeros((width, width))]
    for n, s, p in covariance_blocks(rows, width).collect():
        total = [total[0] + n, total[1] + np.array(s), total[2] + np.array(p).reshape(width, width)]
    n, mean = total[0], total[1] / max(1, total[0])
    values, vectors = np.linalg.eigh((total[2] - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values)[: min(components, width)]
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(len(order)), np.abs(loadings).argmax(1)])[:, None]
    return mean, loadings, values[order], values[order] / values.sum()


def project(rows: DataFrame, mean: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """Scores of (id, vec) on saved components."""
    centred = F.zip_with("vec", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    return rows.select("id", *[dot(centred, F.array(*[F.lit(float(v)) for v in row])).alias(f"PC{i + 1}") for i, row in enumerate(loadings)])


def project_arrays(rows: DataFrame, mean: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """(id, scores): the scores of (id, vec) on saved components as one array."""
    centred = F.zip_with("vec", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in loadings])
    return rows.select("id", centred.alias("_x")).select("id", F.transform(weights, lambda w: dot(F.col("_x"), w)).alias("scores"))


def variance_summary(long: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    return long.groupBy("feature").agg(F.var_samp("value").alias("variance"), (q[1] - q[0]).alias("iqr"))


def classical_scaling(distances: np.ndarray, axes: int = 2) -> np.ndarray:
    """Coordinates from a small distance matrix (double centring)."""
    n = len(distances)
    if n > SMALL:
        raise ValueError(f"{n} rows are more than a driver-side matrix may have ({SMALL})")
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (distances**2) @ j)
    order = np.argsort(-values)[:axes]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def square(distances: DataFrame, names: Sequence[str] | None = None) -> tuple[list, np.ndarray]:
    """Names and matrix of a long table (a, b, distance) of at most ``SMALL`` rows a side."""
    ends = distances.select("a").unionAll(distances.select(F.col("b").alias("a"))).distinct()
    found = [r["a"] for r in ends.limit(SMALL + 1).collect()]
    if len(found) > SMALL:
        raise ValueError(f"more than {SMALL} rows")
    names = list(names or sorted(found))
    rows = distances.where(F.col("a").isin(names) & F.col("b").isin(names)).collect()
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["distance"]
    return names, out
