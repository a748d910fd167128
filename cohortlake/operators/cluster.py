"""Trees and clusters of bounded matrices, and mixtures per group in parallel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matrix import square


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size); leaves are 0..n-1, merge i makes n + i. Ties: the earliest pair."""
    n = len(d)
    active, size, merges = list(range(n)), {i: 1 for i in range(n)}, []
    dist = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    key = lambda a, b: (a, b) if a < b else (b, a)
    for step in range(n - 1):
        (a, b), h = min(((p, dist[p]) for p in ((x, y) for i, x in enumerate(active) for y in active[i + 1 :])), key=lambda x: (x[1], x[0]))
        new = n + step
        merges.append((a, b, h, size[a] + size[b]))
        active = [x for x in active if x not in (a, b)]
        for x in active:
            dist[(x, new)] = (size[a] * dist[key(a, x)] + size[b] * dist[key(b, x)]) / (size[a] + size[b])
        size[new] = size[a] + size[b]
        active.append(new)
    return merges


def cut_tree(merges: Sequence[tuple[int, int, float, int]], n: int, k: int) -> list[int]:
    """Cluster numbers 1.. in order of first appearance, after all but k - 1 merges."""
    root = list(range(n + len(merges)))
    for i, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        ra, rb = root[a], root[b]
        root = [n + i if r in (ra, rb) else r for r in root]
    seen: dict[int, int] = {}
    return [seen.setdefault(root[i], len(seen) + 1) for i in range(n)]


def newick(merges: Sequence[tuple[int, int, float, int]], names: Sequence[str]) -> str:
    n = len(names)
    height = {i: 0.0 for i in range(n)}
    text = {i: _label(names[i]) for i in range(n)}
    for i, (a, b, h, _) in enumerate(merges):
        half = h / 2
        text[n + i] = f"({text[a]}:{half - height[a]:.6g},{text[b]}:{half - height[b]:.6g})"
        height[n + i] = half
    return (text[n + len(merges) - 1] if merges else (text[0] if n else "")) + ";"


def _label(name: str) -> str:
    return "".join("_" if c in " ():;,[]'" else c for c in str(name))


def neighbour_joining(d: np.ndarray, names: Sequence[str]) -> str:
    """Newick of the unrooted tree; fewer than three names give a star."""
    d = np.array(d, float)
    text = [_label(n) for n in names]
    while len(text) > 3:
        n = len(text)
        r = d.sum(0)
        q = (n - 2) * d - r[:, None] - r[None]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        i, j = min(i, j), max(i, j)
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [x for x in range(n) if x not in (i, j)]
        text = [text[x] for x in keep] + [f"({text[i]}:{li:.6g},{text[j]}:{d[i, j] - li:.6g})"]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], new[keep]]), np.append(new[keep], 0)])
    if len(text) == 3:
        lengths = [(d[0, 1] + d[0, 2] - d[1, 2]) / 2, (d[0, 1] + d[1, 2] - d[0, 2]) / 2, (d[0, 2] + d[1, 2] - d[0, 1]) / 2]
        return "(" + ",".join(f"{t}:{x:.6g}" for t, x in zip(text, lengths)) + ");"
    return "(" + ",".join(text) + ");"


def cophenetic(merges: Sequence[tuple[int, int, float, int]], n: int) -> np.ndarray:
    members = {i: [i] for i in range(n)}
    out = np.zeros((n, n))
    for i, (a, b, h, _) in enumerate(merges):
        for x in members[a]:
            for y in members[b]:
                out[x, y] = out[y, x] = h
        members[n + i] = members[a] + members[b]
    return out


def closest_pairs(merges: Sequence[tuple[int, int, float, int]], names: Sequence[str], n: int = 8) -> list[tuple[str, str, float]]:
    c = cophenetic(merges, len(names))
    return sorted(((names[i], names[j], float(c[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))), key=lambda x: (x[2], x[0], x[1]))[:n]


def gower_matrix(x: np.ndarray) -> np.ndarray:
    span = x.max(0) - x.min(0)
    u = x / np.where(span > 0, span, np.inf)
    return np.abs(u[:, None] - u[None]).mean(2)


def bootstrap_stability(spark: SparkSession, names: Sequence[str], x: np.ndarray, iterations: int = 100, k: int | None = None, seed: int = 1) -> DataFrame:
    """(a, b, frequency): share of feature resamples in which a pair shares a cluster.
    Iterations run in parallel, each seeded by its number, so reruns agree."""
    n = len(names)
    k = k or max(2, min(n - 1, round(math.sqrt(n))))
    labels = list(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"]:
                rng = np.random.default_rng([seed, int(i)])
                part = x[:, rng.integers(0, x.shape[1], x.shape[1])]
                c = cut_tree(average_linkage(gower_matrix(part)), n, k)
                yield pd.DataFrame([(labels[p], labels[q], int(c[p] == c[q])) for p in range(n) for q in range(p + 1, n)], columns=["a", "b", "same"])

    return spark.range(iterations).mapInPandas(run, "a string, b string, same int").groupBy("a", "b").agg((F.sum("same") / F.lit(float(iterations))).alias("frequency"))


def member_stability(pairs: DataFrame, high: float = 0.90) -> DataFrame:
    """Per member: the mean of its mean as first and as second of a pair, its best pair, its number of stable partners."""
    def side(c: str) -> DataFrame:
        return pairs.groupBy(F.col(c).alias("member")).agg(F.avg("frequency").alias("m"), F.max("frequency").alias("top"), F.sum((F.col("frequency") >= high).cast("int")).alias("n"))

    return side("a").unionAll(side("b")).groupBy("member").agg(F.avg("m").alias("mean_frequency"), F.max("top").alias("max_frequency"), F.sum("n").alias("n_stable_partners"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings; 1 where the denominator is 0."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.agg(pairs(F.col("n")).alias("together"), F.sum("n").alias("total"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("in_a"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("in_b"))
    one = both.join(rows, how="cross").join(cols, how="cross")
    expected = F.col("in_a") * F.col("in_b") / F.when(F.col("total") > 1, F.col("total") * (F.col("total") - 1) / 2)
    bottom = (F.col("in_a") + F.col("in_b")) / 2 - expected
    return one.select(F.coalesce((F.col("together") - expected) / F.when(bottom != 0, bottom), F.lit(1.0)).alias("adjusted_rand"))


def changed_members(before: DataFrame, after: DataFrame, key: str, cluster: str = "cluster") -> DataFrame:
    """Members whose cluster number differs; a relabelling counts as a change."""
    other = after.select(key, F.col(cluster).alias("_after"))
    return before.join(other, key).where(F.col(cluster) != F.col("_after")).select(key, F.col(cluster).alias("before"), F.col("_after").alias("after"))


def singletons(df: DataFrame, cluster: str) -> DataFrame:
    return df.withColumn("is_singleton", F.count(F.lit(1)).over(Window.partitionBy(cluster)) == 1)


def weighting_sensitivity(distances: DataFrame, base: str, k: int = 6) -> tuple[list[tuple], list[tuple]]:
    """((scenario, adjusted Rand index against ``base``, changed members), (scenario, member,
    cluster)) of average-linkage clusters under each scenario of (scenario, a, b, distance),
    each a small matrix. Members change where their cluster's members do."""
    scenarios = sorted(r[0] for r in distances.select("scenario").distinct().collect())
    if base not in scenarios:
        raise ValueError(f"no scenario {base}")
    cut = {}
    for s in scenarios:
        names, apart = square(distances.where(F.col("scenario") == s).select("a", "b", "distance"))
        cut[s] = dict(zip(names, cut_tree(average_linkage(apart), len(names), min(k, len(names)))))
    first = cut[base]
    spark = distances.sparkSession
    pairs = spark.createDataFrame([(s, first[m], c) for s in scenarios for m, c in cut[s].items() if m in first], "scenario string, a int, b int")
    index = {s: adjusted_rand(pairs.where(F.col("scenario") == s), "a", "b").first()[0] for s in scenarios}
    member = lambda c: {m: frozenset(x for x in c if c[x] == c[m]) for m in c}
    sets = {s: member(c) for s, c in cut.items()}
    changed = {s: sorted(m for m in first if sets[s].get(m) != sets[base][m]) for s in scenarios}
    return [(s, index[s], changed[s]) for s in scenarios], [(s, m, int(c)) for s in scenarios for m, c in sorted(cut[s].items())]


def kruskal(long: DataFrame, group: str, feature: str = "feature", value: str = "value", bins: int = 256) -> DataFrame:
    """(feature, n, k, h, epsilon_squared): tie-corrected Kruskal-Wallis.

    Equal values are counted, not ordered; different ones are ranked within
    approximate quantile bins of their feature, to which the counts of the bins
    below are added, so that no task orders a whole feature.
    """
    known = long.where(F.col(value).isNotNull()).select(F.col(feature).alias("_f"), F.col(group).alias("_g"), F.col(value).alias("_v"))
    counted = known.groupBy("_f", "_v", "_g").agg(F.count(F.lit(1)).alias("_m"))
    edges = counted.groupBy("_f").agg(F.percentile_approx("_v", F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10 * bins)).alias("_edges")).withColumnRenamed("_f", "_whose")
    tied = counted.groupBy("_f", "_v").agg(F.sum("_m").alias("_ties"), F.collect_list(F.struct("_g", "_m")).alias("_by"))  # a group once each
    binned = tied.join(edges, F.col("_f").eqNullSafe(F.col("_whose"))).drop("_whose").withColumn("_b", F.size(F.filter(F.array_distinct("_edges"), lambda e: e < F.col("_v")))).drop("_edges")
    sizes = binned.groupBy("_f", "_b").agg(F.sum("_ties").alias("_n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_f").alias("_of"), F.col("_b").alias("_in"), before("_n", Window.partitionBy("_f").orderBy("_b")).alias("_below"))  # at most ``bins`` rows a feature
    placed = binned.join(sizes, F.col("_f").eqNullSafe(F.col("_of")) & (F.col("_b") == F.col("_in")))
    rank = F.col("_below") + before("_ties", Window.partitionBy("_f", "_b").orderBy("_v")) + (F.col("_ties") + 1) / 2
    each = placed.withColumn("_rank", rank).select(F.col("_f").alias(feature), F.explode("_by").alias("_x"), "_rank", F.col("_ties").cast("double").alias("_ties"))
    m = F.col("_x._m").cast("double")
    groups = each.groupBy(feature, F.col("_x._g").alias(group)).agg(F.sum(F.col("_rank") * m).alias("r"), F.sum(m).alias("n"), F.sum((F.col("_ties") * F.col("_ties") - 1) * m).alias("t"))
    out = groups.groupBy(feature).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("t").alias("t"))
    n = F.col("n")
    correction = 1 - F.col("t") / F.when(n > 1, n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.when(correction > 0, correction)
    return out.select(feature, n.cast("bigint").alias("n"), "k", h.alias("h"), ((h - F.col("k") + 1) / F.when(n > F.col("k"), n - F.col("k"))).alias("epsilon_squared"))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_p(h: Column, df: Column) -> Column:
    """Upper-tail p-values, a batch of rows at a time."""

    def run(xs: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(k) or k < 1 else chi2_tail(float(x), int(k)) for x, k in zip(xs, ks)], dtype=float)

    return F.pandas_udf(run, "double")(h.cast("double"), df.cast("double"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """False discovery rates; null p stays null and doesn't count.

    Rows are ranked within quantile bins of p; one row per bin carries the ranks
    below it and the least rate above it, so no group is ordered in one task
    unless its values are equal. Values that tie get one rate.
    """
    known = df.where(F.col(p).isNotNull())
    edges = sorted(set(known.approxQuantile(p, [i / bins for i in range(1, bins)], 0.001)))
    of = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(p))) if edges else F.lit(0)
    binned = known.withColumn("_b", of)
    sizes = binned.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_below": F.coalesce(F.sum("_m").over(before), F.lit(0)), "_n": F.sum("_m").over(Window.partitionBy(*by))})  # at most ``bins`` rows a group
    inside = Window.partitionBy(*by, "_b")
    joined = binned.join(sizes, [*by, "_b"])
    ranked = joined.withColumn("_r", F.col("_below") + F.row_number().over(inside.orderBy(p, key))).withColumn("_q", F.col(p) * F.col("_n") / F.col("_r"))
    least = ranked.groupBy(*by, "_b").agg(F.min("_q").alias("_least"))
    after = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(*by, "_b", F.min("_least").over(after).alias("_above"))
    back = inside.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = F.least(F.lit(1.0), F.min("_q").over(back), "_above")
    done = ranked.join(least, [*by, "_b"]).withColumn("fdr", rate).select(*df.columns, "fdr")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("fdr", F.lit(None).cast("double")))


#: Rows and components that are worked on at once; they stay in a core's cache.
CELLS = 1 << 16
#: Rows of groups that are fitted together.
GROUP_ROWS = 100_000


def _mixture(x: np.ndarray, count: np.ndarray, mean: np.ndarray, var: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood, labels) of 1-D Gaussian mixtures of many groups by EM, a row a group.

    x: distinct values, count: how often each occurs (0: padding), mean: starts
    of the components, var: their first variance. A group that is done leaves.
    """
    groups, k = mean.shape
    n, like, labels = count.sum(1), np.full(groups, -np.inf), np.zeros(x.shape, np.int32)
    mean, var, share, live = mean.copy(), np.repeat(var[:, None], k, 1), np.full((groups, k), 1 / k), np.arange(groups)
    for turn in range(rounds):
        # components first, so that each sum over values runs along memory
        logs = x[:, None] - mean[:, :, None]
        logs *= logs
        logs *= -0.5 / var[:, :, None]
        logs += (np.log(share) - 0.5 * np.log(2 * np.pi * var))[:, :, None]
        top = logs.max(1)
        logs -= top[:, None]
        np.exp(logs, out=logs)
        total = logs.sum(1)
        now = ((top + np.log(total)) * count).sum(1)
        done = np.abs(now - like[live]) < 1e-6 * n
        like[live] = now
        if turn == rounds - 1:
            done[:] = True
        if done.any():
            at = live[done]
            labels[at, : x.shape[1]] = logs[done].argmax(1)
            rest = ~done
            if not rest.any():
                break
            x, count, n, live, logs, total, mean = (v[rest] for v in (x, count, n, live, logs, total, mean))
        logs *= (count / total)[:, None]
        weight = logs.sum(2) + 1e-12
        mean = (logs * x[:, None]).sum(2) / weight
        share = weight / weight.sum(1, keepdims=True)
        gap = x[:, None] - mean[:, :, None]
        gap *= gap
        gap *= logs
        var = gap.sum(2) / weight + 1e-6
    return like, labels


def _by_mean(labels: np.ndarray, x: np.ndarray) -> np.ndarray:
    order = sorted(set(labels.tolist()), key=lambda c: -x[labels == c].mean())
    return np.array([order.index(c) + 1 for c in labels])


def _quantiles(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """As ``np.quantile`` of sorted values."""
    at = shares * (len(x) - 1)
    low = np.floor(at).astype(int)
    a, b, t = x[low], x[np.minimum(low + 1, len(x) - 1)], at - low
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))


def mixture_labels(x: np.ndarray, **settings: float) -> tuple[np.ndarray, str]:
    """``group_labels`` of one group."""
    return group_labels([x], **settings)[0]


def group_labels(groups: Sequence[np.ndarray], least: int = 50, most: int = 6, min_size: int = 10, tolerance: float = 10.0) -> list[tuple[np.ndarray, str]]:
    """For each group, cluster numbers from the greatest mean down and the method: the simplest mixture
    within ``tolerance`` of the best BIC whose clusters all have ``min_size``, else quantile bins.

    Equal values of a group are one with a count, and groups of like size go
    through EM together, in arrays of about ``CELLS`` numbers.
    """
    out: list[tuple[np.ndarray, str]] = [(np.zeros(len(x), int), "skipped_too_few") for x in groups]
    some = [i for i, x in enumerate(groups) if len(x) >= least]
    distinct = {i: np.unique(groups[i], return_inverse=True, return_counts=True) for i in some}
    some.sort(key=lambda i: len(distinct[i][0]))
    most_of = {i: max(1, min(most, len(groups[i]) // min_size)) for i in some}
    fits: dict[int, list[tuple[float, np.ndarray, int]]] = {i: [] for i in some}
    ordered = {i: np.sort(groups[i]) for i in some}
    for k in range(1, max(most_of.values(), default=0) + 1):
        shares = (np.arange(k) + 0.5) / k
        at = [i for i in some if most_of[i] >= k]
        while at:
            last = 1
            while last < len(at) and (last + 1) * k * len(distinct[at[last]][0]) <= CELLS:
                last += 1
            part, at = at[:last], at[last:]
            x = np.zeros((len(part), len(distinct[part[-1]][0])))
            count = np.zeros_like(x)
            for row, i in enumerate(part):
                u, _, c = distinct[i]
                x[row, : len(u)], x[row, len(u) :], count[row, : len(u)] = u, u[-1], c
            starts, var = np.array([_quantiles(ordered[i], shares) for i in part]), np.array([groups[i].var() / k + 1e-6 for i in part])
            like, labels = _mixture(x, count, starts, var)
            for row, i in enumerate(part):
                fits[i].append((-2 * like[row] + (3 * k - 1) * math.log(len(groups[i])), labels[row, : len(distinct[i][0])], k))
    for i in some:
        sizes = [np.bincount(f[1], distinct[i][2], f[2]) for f in fits[i]]
        valid = [f for f, n in zip(fits[i], sizes) if n.min() >= max(1, min_size)]
        if valid:
            best = min(f[0] for f in valid)
            _, labels, k = min((f for f in valid if f[0] <= best + tolerance), key=lambda f: f[2])
            out[i] = _by_mean(labels[distinct[i][1]], groups[i]), f"mixture_{k}"
        else:
            out[i] = quantile_labels(groups[i], most, min_size)
    return out


def quantile_labels(x: np.ndarray, most: int = 6, min_size: int = 10) -> tuple[np.ndarray, str]:
    for k in range(max(1, min(most, len(x) // min_size)), 1, -1):
        edges = np.unique(np.quantile(x, np.arange(1, k) / k))
        labels = np.searchsorted(edges, x, "left")
        sizes = np.bincount(labels)
        if (sizes[sizes > 0] >= min_size).all() and (sizes > 0).sum() > 1:
            return _by_mean(labels, x), f"quantile_{int((sizes > 0).sum())}"
    return np.ones(len(x), int), "single"


def mixtures(df: DataFrame, group: str, key: str, value: str, **settings: float) -> DataFrame:
    """(group, key, value, cluster, method): one mixture per group, many groups of a task at once."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            ends = np.cumsum(pa.compute.list_value_length(batch.column("_rows")).to_numpy(zero_copy_only=False))
            while begin < len(batch):  # about GROUP_ROWS rows
                upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + GROUP_ROWS, "right")))
                part = batch.slice(begin, upto - begin)
                begin = upto
                lists = part.column("_rows")
                sizes, rows = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
                x = rows.field("x").cast(pa.float64()).to_numpy(zero_copy_only=False)
                found = group_labels(np.split(x, np.cumsum(sizes)[:-1]), **settings)
                of = np.repeat(np.arange(len(part)), sizes)
                columns = [part.column("_group").take(pa.array(of)), rows.field("key"), rows.field("x"), pa.array(np.concatenate([f[0] for f in found]).astype(np.int32)), pa.array([f[1] for f in found]).take(pa.array(of))]
                yield pa.RecordBatch.from_arrays(columns, [group, key, value, "cluster", "method"])

    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_group"), F.struct(F.col(key).alias("key"), F.col(value).alias("x")).alias("_row"))
    # by number: a task's time is in its rounds, so that few bytes are no reason for few tasks
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_group")
    known = dealt.groupBy("_group").agg(F.collect_list("_row").alias("_rows"))
    return known.mapInArrow(run, f"`{group}` {fields[group]}, `{key}` {fields[key]}, `{value}` {fields[value]}, cluster int, method string")


def cluster_meaning(mean: Column, purity: Column, tolerance: float = 0.08) -> Column:
    expected = purity / 2
    return F.when(mean.isNull() | purity.isNull(), "uncertain").when(F.abs(mean - expected) <= tolerance, "clonal_like").when(mean < expected - tolerance, "subclonal_like").otherwise("uncertain")


def sample_meaning(n: Column, clusters: Column, dominant: Column, subclonal: Column, entropy: Column, least: int = 50) -> Column:
    return F.when(n < least, "low_confidence").when((dominant >= 0.75) & (subclonal <= 1) & (clusters <= 2), "predominantly_clonal_like").when((clusters <= 3) & (entropy < 0.75), "oligoclonal_like").otherwise("multicluster_subclonal_like")
