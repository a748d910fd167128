"""Exact nearest neighbours over an index of pivots, most of whose blocks are never read.

Each row belongs to the cell of its nearest pivot, and to a ring of that cell by
its distance to the pivot; a block is a part of a ring. The triangle inequality
bounds the distance of a query to every row of a block from both sides, by the
query's distances to the pivots alone. Points of few dimensions are cut into boxes
instead of rings, and the box that a block's rows lie in bounds them too. A search visits the nearest blocks first
and then only those whose lower bound does not exceed the k-th distance found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import written
from .matrix import best_pairs, vector_rows

#: Pivots and blocks at most: what every search task holds. Rings of a cell. Queries of one task.
PIVOTS, BLOCKS, RINGS, QUERIES = 256, 20_000, 32, 4000
#: Dimensions up to which cells are cut into boxes, and rows, about, that the cuts are chosen by.
BOXED, DRAWN = 8, 100_000


def in_space(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as points whose Euclidean distance orders as the metric does: for
    cosines on the unit sphere, with zero vectors on an axis of their own."""
    if metric == "euclidean":
        return vectors
    size = np.sqrt((vectors * vectors).sum(1))
    unit = np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=size[:, None] > 0)
    return np.column_stack([unit, (size == 0).astype(float)])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all of ``a`` to the few of ``b``, from differences."""
    return np.stack([np.sqrt(((a - p) ** 2).sum(1)) for p in b], 1)


def _cuts(points: np.ndarray, leaves: int) -> tuple | None:
    """(dimension, value, cuts below, cuts from it on): about equal parts, across the widest dimension."""
    wide = np.ptp(points, 0) if leaves > 1 and len(points) > 1 else np.zeros(1)
    dim = int(wide.argmax())
    if not wide[dim] > 0:
        return None
    x, half = np.sort(points[:, dim]), leaves // 2
    cut = x[len(x) * half // leaves]
    if cut == x[0]:
        cut = x[np.searchsorted(x, cut, "right")]
    below = points[:, dim] < cut
    return dim, cut, _cuts(points[below], half), _cuts(points[~below], leaves - half)


def _leaf(cuts: tuple | None, points: np.ndarray) -> tuple[np.ndarray, int]:
    """Each point's part, and how many parts there are."""
    if cuts is None:
        return np.zeros(len(points), np.int32), 1
    dim, cut, one, two = cuts
    below = points[:, dim] < cut
    (left, n), (right, m) = _leaf(one, points[below]), _leaf(two, points[~below])
    out = np.empty(len(points), np.int32)
    out[below], out[~below] = left, right + n
    return out, n + m


@dataclass
class Index:
    """``rows``: (id, vec, block[, group]); ``pivots``: points; the arrays have a value
    per block: its cell, least and greatest distance to the pivot, rows, and rows of
    its most common group."""

    metric: str
    rows: DataFrame
    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    main: list
    main_n: np.ndarray
    box: tuple[np.ndarray, np.ndarray] | None = None  # least and greatest coordinates, for few dimensions

    @property
    def width(self) -> int:
        return self.pivots.shape[1] - (self.metric == "cosine")

    def bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's distance to the rows of each block, with room for rounding."""
        d = _apart(points, self.pivots)
        near, mine = d.min(1, keepdims=True), d[:, self.cell]
        low = np.maximum.reduce([mine - self.high, self.low - mine, (mine - near) / 2])
        if self.box:
            apart = np.zeros_like(low)
            for q, least, most in zip(points.T, *(b.T for b in self.box)):
                apart += np.maximum(np.maximum(least - q[:, None], q[:, None] - most), 0) ** 2
            low = np.maximum(low, np.sqrt(apart))
        slack = 1e-7 * (mine + self.high)
        return np.maximum(low - slack, 0), mine + self.high + slack

    def others(self, groups: list) -> np.ndarray:
        """At least so many rows of each block are of another group than each query (all, without groups)."""
        if groups and groups[0] is not None:
            same = np.array(groups, object)[:, None] == np.array(self.main, object)
            return np.where(same, self.n - self.main_n, self.main_n)
        return np.broadcast_to(self.n, (len(groups), len(self.n)))


def build(rows: DataFrame, metric: str = "euclidean", group: str | None = None, block_rows: int = 2000) -> Index:
    """An index of ``rows`` (id, vec array<double>[, group]), all of one width, finite.

    Pivots are far apart among at most 16 * ``PIVOTS`` rows drawn by their ids' hash;
    every row is indexed. Rings are cut at approximate quantiles, boxes at medians of
    about ``DRAWN`` rows, and either is split by id where many rows lie equally far,
    so that no block is much over ``block_rows`` (or rows / ``BLOCKS``, if more).
    """
    spark, n = rows.sparkSession, rows.count()
    if not n:
        raise ValueError("no rows to index")
    block_rows = max(block_rows, -(-n // (BLOCKS // 2)))
    wanted = int(min(PIVOTS, max(1, np.sqrt(n) / 2)))
    drawn = rows.select("vec").orderBy(F.xxhash64("id")).limit(16 * wanted).collect()
    sample = in_space(np.array([r["vec"] for r in drawn], float), metric)
    picked = [0]
    apart = _apart(sample, sample[:1])[:, 0]
    while len(picked) < wanted and apart.max() > 0:
        picked.append(int(apart.argmax()))
        apart = np.minimum(apart, _apart(sample, sample[picked[-1:]])[:, 0])
    pivots = sample[picked]

    columns = ["id", "vec"] + ([group] if group else [])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _apart(in_space(vector_rows(batch), metric), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "away"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(columns).schema.fields)
    dealt = written(rows.select(columns).mapInArrow(deal, f"{kinds}, cell int, away double"), "pivots")
    cut = _boxed(dealt, n, block_rows, f"{kinds}, cell int, away double") if metric == "euclidean" and pivots.shape[1] <= BOXED else _ringed(dealt, block_rows)
    rings = cut.groupBy("cell", "ring").count().collect()  # at most RINGS for each pivot
    first, parts = 0, []
    for r in sorted(rings, key=lambda r: (r["cell"], r["ring"])):
        many = -(-r["count"] // block_rows)
        parts.append((r["cell"], r["ring"], first, many))
        first += many
    place = spark.createDataFrame(parts, "cell int, ring int, first int, parts int")
    blocked = cut.join(place, ["cell", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    table = written(blocked.select(*columns, "cell", "away", "block").repartitionByRange("block").sortWithinPartitions("block"), "pivots")
    return indexed(metric, table, pivots, group)


def _ringed(dealt: DataFrame, block_rows: int) -> DataFrame:
    """Rows (.., cell, away) with the ring of their cell."""
    steps = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    cells = dealt.groupBy("cell").agg(F.percentile_approx("away", steps, 1000).alias("cuts"), F.count(F.lit(1)).alias("n")).collect()  # a row per pivot
    cuts = []
    for r in cells:
        rings = min(RINGS, -(-r["n"] // block_rows))
        cuts.append((r["cell"], sorted({r["cuts"][round(i * RINGS / rings) - 1] for i in range(1, rings)})))
    made = dealt.sparkSession.createDataFrame(cuts, "cell int, cuts array<double>")
    return dealt.join(made, "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("away")))).drop("cuts")


def _boxed(dealt: DataFrame, n: int, block_rows: int, kinds: str) -> DataFrame:
    """Rows (id, vec, .., cell, away) with the box of their cell, as ``ring``."""
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # a row per pivot
    drawn = dealt.where(F.pmod(F.xxhash64("id"), F.lit(n)) < DRAWN).select("cell", "vec").collect()
    points: dict[int, list] = {}
    for r in drawn:
        points.setdefault(r["cell"], []).append(r["vec"])
    cuts = {c: _cuts(np.array(p, float), -(-sizes[c] // block_rows)) for c, p in points.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cell = vector_rows(batch), batch.column("cell").to_numpy()
            ring = np.zeros(len(batch), np.int32)
            for c in np.unique(cell).tolist():
                mine = np.flatnonzero(cell == c)
                ring[mine] = _leaf(cuts.get(c), vectors[mine])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring)], [*batch.schema.names, "ring"])

    return written(dealt.mapInArrow(place, f"{kinds}, ring int"), "pivots")


def indexed(metric: str, rows: DataFrame, pivots: np.ndarray, group: str | None = None) -> Index:
    """The index of dealt rows (id, vec, cell, away, block[, group]): what is known of each block is read from them."""
    dims = range(pivots.shape[1] if metric == "euclidean" and pivots.shape[1] <= BOXED else 0)
    by = rows.groupBy("block", *([group] if group else [])).agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n"), F.first("cell").alias("cell"), *[F.min(F.get("vec", F.lit(i))).alias(f"least{i}") for i in dims], *[F.max(F.get("vec", F.lit(i))).alias(f"most{i}") for i in dims])
    of = F.max_by(F.struct(F.col(group) if group else F.lit(None).alias("g"), "n"), "n").alias("main")
    facts = by.groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.first("cell").alias("cell"), of, *[F.min(f"least{i}").alias(f"least{i}") for i in dims], *[F.max(f"most{i}").alias(f"most{i}") for i in dims]).orderBy("block").collect()  # BLOCKS rows or so
    number = {r["block"]: i for i, r in enumerate(facts)}
    if list(number) != list(range(len(number))):  # a part that no id fell into: numbers stay, such a block is empty
        empty = {"low": 0.0, "high": 0.0, "n": 0, "cell": 0, "main": (None, 0)} | {f"{side}{i}": 0.0 for side in ("least", "most") for i in dims}
        have = {r["block"]: r for r in facts}
        facts = [have.get(i, empty) for i in range(max(number) + 1)]
    column = lambda c: np.array([r[c] for r in facts])
    box = tuple(np.stack([column(f"{side}{i}") for i in dims], 1) for side in ("least", "most")) if dims else None
    return Index(metric, rows, pivots, column("cell"), column("low"), column("high"), column("n"), [r["main"][0] for r in facts], np.array([r["main"][1] for r in facts]), box)


def _first_blocks(index: Index, low: np.ndarray, others: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the nearest blocks that surely hold k rows."""
    order = np.argsort(low, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(others, order, 1), 1)
    return [o[: int(np.searchsorted(h, k)) + 1] for o, h in zip(order, held)]


def search(index: Index, queries: DataFrame, k: int, group: str | None = None, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, neighbour_id, distance), (n_pairs, n_compared, n_all)): the
    exact k nearest rows of the index for each query (id, vec[, group]), ties to the
    smaller id, and how many pairs of a query and a block were visited, rows compared,
    and rows that brute force would compare.

    A row of the query's own id is left out unless ``own``; with ``group`` rows of
    the query's group are. Queries of another width raise. No queries give no rows.
    """
    spark = queries.sparkSession
    columns = ["id", "vec"] + ([group] if group else [])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(columns).schema.fields)
    if group is None:
        index = Index(index.metric, index.rows, index.pivots, index.cell, index.low, index.high, index.n, [None] * len(index.n), index.n, index.box)
    kept = Index(index.metric, None, index.pivots, index.cell, index.low, index.high, index.n, index.main, index.main_n, index.box)  # what tasks need of it
    need = k if own else k + 1

    def planned(batches: Iterator[pa.RecordBatch], later: bool) -> Iterator[pa.RecordBatch]:
        names = [*columns, "limit"] if later else columns
        for whole in batches:
            for start in range(0, len(whole), 200):
                batch = whole.slice(start, 200)
                vectors = vector_rows(batch)
                if len(vectors) and vectors.shape[1] != kept.width:
                    raise ValueError(f"queries have {vectors.shape[1]} components, the index {kept.width}")
                low, high = kept.bounds(in_space(vectors, kept.metric))
                others = kept.others(batch.column(group).to_pylist() if group else [None] * len(batch))
                blocks = _first_blocks(kept, low, others, need)
                if later:
                    order = np.argsort(high, axis=1, kind="stable")
                    held = np.take_along_axis(others, order, 1).cumsum(1)
                    most = np.array([h[o[i]] if (i := int(np.searchsorted(c, need))) < len(o) else np.inf for h, o, c in zip(high, order, held)])
                    found = batch.column("limit").to_numpy(zero_copy_only=False)
                    most = np.minimum(most, np.sqrt(2 * found) if kept.metric == "cosine" else found)
                    wanted = (low <= (most * (1 + 1e-9) + (1e-7 if kept.metric == "cosine" else 1e-9))[:, None]) & (others > 0)  # a cosine is known to 1e-15, so its root to 1e-7
                    for row, done in enumerate(blocks):
                        wanted[row, done] = False
                    blocks = [np.flatnonzero(w) for w in wanted]
                out = [batch.column(c) for c in names] + [pa.array([b.astype(np.int32) for b in blocks], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, [*names, "blocks"])

    def visited(asked: DataFrame, later: bool) -> tuple[DataFrame, DataFrame]:
        own_columns = [*columns, "limit"] if later else columns  # what is farther than the limit is not sent back
        asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # few bytes, much work
        plan = written(asked.mapInArrow(lambda batches: planned(batches, later), f"{kinds}{', `limit` double' if later else ''}, blocks array<int>"), "search")
        pairs = plan.select(*own_columns, F.explode("blocks").alias("block"))
        loads = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"), F.count(F.lit(1)).alias("asked"))
        asks = pairs.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rows = index.rows.select(*columns, "block").join(loads, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = asks.select(*own_columns, "block", "part").groupBy("block", "part").cogroup(rows.select(*columns, "block", "part").groupBy("block", "part")).applyInArrow(best_pairs(k, index.metric, group, own), "query_id long, neighbour_id long, distance double")
        return written(met, "search"), loads

    asked = queries.select(columns)
    first, loads = visited(asked, False)
    best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    limit = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("limit"))
    second, more = visited(asked.join(limit, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")))), True)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.n)], "block int, n long")
    total = int(index.n.sum())
    work = loads.unionByName(more).join(sizes, "block").agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(F.col("asked") * F.col("n")), F.lit(0)).alias("n_compared"))
    return ranked.select("query_id", "rank", "neighbour_id", "distance"), work.withColumn("n_all", F.lit(asked.count() * total))
