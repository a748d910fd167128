"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

The graph starts from random-projection chunks and improves by joins of
neighbours of neighbours: every node's forward and (bounded) reverse
neighbours meet under its key with their vectors, all pairs among them are
compared, and whoever finds a better neighbour keeps it. Queries walk the
graph in joined rounds: each expands the best nodes of its beam that it has
not expanded, scores their neighbours and keeps the best. Vectors travel in
single precision, scaled by a power of two, so components that were floats
stay exact; scores are double. The whole last beam is ranked again in double
precision on the original vectors. Equal vectors are one node, whose hits are
its members in the order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, whole_groups

DEGREE, REVERSE, SWEEPS, OFFERS = 32, 32, 3, 10
TREES, BITS, CHUNK = 5, 8, 256
BEAM, STEPS, ENTRIES = 320, (48, 128, 160), 256
#: Neighbours in one row of the graph, so that Arrow batches stay small.
PIECE = 8


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components, and not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of rows that take part: an id, a usable vector of the
    commonest length (ties: the longer); rows that share an id count once, with
    the vector that is first in array order."""
    all_ = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    widths = all_.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    width = widths[0] if widths else 0
    return all_.where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec"))


def _floats(column: pa.ChunkedArray | pa.Array, count: int) -> np.ndarray:
    """Single-precision binary rows as a float64 matrix."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    raw = b"".join(p.as_buffer() for part in parts for p in part)
    return np.frombuffer(raw, np.float32).reshape(count, -1).astype(float)


def best(a: np.ndarray, b: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each a the ``keep`` highest scored distinct b other than itself (ties: smaller b)."""
    order = np.lexsort((-s, b, a))
    a, b, s = a[order], b[order], s[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new &= a != b
    a, b, s = a[new], b[new], s[new]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    top = rank < keep
    return a[top], b[top], s[top]


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s.astype(float))], ["a", "b", "s"])


def _offers(ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best partners of each row within one small group, if above its floor."""
    g = vectors @ vectors.T
    np.fill_diagonal(g, -np.inf)
    k = min(most, len(ids) - 1)
    if k <= 0:
        return ids[:0], ids[:0], floor[:0]
    at = np.argpartition(-g, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(g, at, 1)
    good = s > floor[:, None]
    return np.broadcast_to(ids[:, None], s.shape)[good], ids[at][good], s[good]


def top_edges(edges: DataFrame, keep: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "a"):
            yield _edges(*best(*(t.column(c).to_numpy() for c in ("a", "b", "s")), keep))

    return edges.repartition(partitions(edges.sparkSession), "a").sortWithinPartitions("a").mapInArrow(run, "a long, b long, s double")


def power_of_two(top: float | None) -> float:
    """The power of two at or below ``top``, by which division loses no digits."""
    return 2.0 ** np.floor(np.log2(top)) if top else 1.0


def build_graph(vectors: DataFrame, scratch: Scratch, degree: int = DEGREE, sweeps: int = SWEEPS) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, raw; edges: a, b, s): the neighbour graph of (id, vec)."""
    spark = vectors.sparkSession
    top = vectors.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec"))).first()
    scale, width = power_of_two(top[0]), (top[1] or 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = (batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width) / scale).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "raw"])

    nodes = scratch.table(vectors.mapInArrow(pack, "id long, raw binary"))
    rng = np.random.default_rng(11)
    planes, lines = rng.standard_normal((TREES, width, BITS)).astype(np.float32), rng.standard_normal((TREES, width)).astype(np.float32)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _floats(batch.column("raw"), len(batch))
            for t in range(TREES):
                cell = ((v @ planes[t]) > 0) @ (1 << np.arange(BITS))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(cell + (t << BITS)), pa.array((v @ lines[t]).astype(float))], ["id", "raw", "cell", "at"])

    def sprout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grow(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("id").to_numpy()
            return _edges(*_offers(ids, _floats(batch.column("raw"), len(batch)), np.full(len(batch), -np.inf), degree // 2))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = len(table) // CHUNK * CHUNK
                for start in range(0, whole, CHUNK):
                    yield from map(grow, table.slice(start, CHUNK).to_batches())
                held = table.slice(whole).to_batches()
        if held:
            yield from map(grow, pa.Table.from_batches(held).combine_chunks().to_batches())

    ranged = nodes.mapInArrow(plant, "id long, raw binary, cell long, at double").repartitionByRange(partitions(spark), "cell", "at").sortWithinPartitions("cell", "at")
    edges = scratch.table(top_edges(ranged.mapInArrow(sprout, "a long, b long, s double"), degree))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "c"):
            t = t.combine_chunks()
            centre, ids, floor = (t.column(c).to_numpy() for c in ("c", "m", "floor"))
            v = _floats(t.column("raw"), len(t))
            cut = np.concatenate([[0], np.flatnonzero(centre[1:] != centre[:-1]) + 1, [len(t)]])
            got = [_offers(ids[x:y], v[x:y], floor[x:y], OFFERS) for x, y in zip(cut[:-1], cut[1:])]
            yield _edges(*best(*(np.concatenate([g[i] for g in got]) for i in range(3)), degree))

    for sweep in range(sweeps):
        draw = Window.partitionBy("b").orderBy(F.xxhash64("a", "b", F.lit(sweep)), "a")
        back = edges.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= REVERSE).select(F.col("b").alias("c"), F.col("a").alias("m"))
        met = edges.select(F.col("a").alias("c"), F.col("b").alias("m")).unionAll(back).unionAll(nodes.select(F.col("id").alias("c"), F.col("id").alias("m"))).distinct()
        floors = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low")).select(F.col("a").alias("id"), F.when(F.col("n") >= degree, F.col("low")).otherwise(F.lit(-3e38)).alias("floor"))
        known = scratch.table(nodes.join(floors, "id", "left").select(F.col("id").alias("m"), "raw", F.coalesce("floor", F.lit(-3e38)).alias("floor")))
        grouped = met.join(known, "m").select("c", "m", "raw", "floor").repartition(partitions(spark), "c").sortWithinPartitions("c")
        better = grouped.mapInArrow(meet, "a long, b long, s double")
        after = scratch.table(top_edges(edges.unionAll(better), degree))
        scratch.drop(edges, known)
        edges = after
    return nodes, edges


def search(vectors: DataFrame, queries: DataFrame, k: int, scratch: Scratch, degree: int = DEGREE, beam: int = BEAM, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest of ``vectors`` (id, vec) for
    each of ``queries`` (id, vec), by inner product; a query's own id is no candidate.

    A query starts at its own node, if it has one, and at the best of a fixed
    number of entry nodes; ``steps`` says how many nodes of its beam it expands
    in each round. Fewer rows come only where fewer candidates were reached.
    Equal vectors are one node, equal queries are asked once; of each node the
    ``k`` + 1 smallest ids are kept, as one may be the query's own.
    """
    spark = vectors.sparkSession
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    kept = vectors.select("id", "vec").withColumn("r", first).where(F.col("r") <= k + 1)
    classes = scratch.table(kept.groupBy("vec").agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("members")))
    nodes, edges = build_graph(classes.select("id", "vec"), scratch, degree)
    if not nodes.take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def inline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "a"):
            t = t.combine_chunks()
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            raw = t.column("raw").to_pylist()
            first = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
            rank = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
            cut = [*np.flatnonzero(rank % PIECE == 0).tolist(), len(t)]
            yield pa.RecordBatch.from_arrays([pa.array(a[cut[:-1]]), pa.array([b[x:y] for x, y in zip(cut[:-1], cut[1:])], pa.list_(pa.int64())), pa.array([b"".join(raw[x:y]) for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["node", "near", "raws"])

    held = edges.join(nodes.withColumnRenamed("id", "b"), "b").select("a", "b", "raw").repartition(partitions(spark), "a").sortWithinPartitions("a")
    graph = scratch.table(held.mapInArrow(inline, "node long, near array<long>, raws binary"))
    scale = power_of_two(classes.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0])
    once = queries.groupBy("vec").agg(F.min("id").alias("q"))
    asked = scratch.table(once.join(classes.select("vec", F.col("id").alias("own")), "vec", "left").select("q", "own", "vec"))
    entry = nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()  # a fixed number of rows
    entry_ids, entry_vectors = np.array([r[0] for r in entry]), np.stack([np.frombuffer(r[1], np.float32) for r in entry]).astype(float)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = (batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) / scale).astype(np.float32)
            has = batch.column("own").is_valid().to_numpy(zero_copy_only=False)
            own = batch.column("own").fill_null(0).to_numpy()[has]
            q, s = batch.column("q").to_numpy(), v.astype(float) @ entry_vectors.T
            few = min(4, len(entry_ids))
            at = np.argpartition(-s, few - 1, axis=1)[:, :few]
            raw = [x.tobytes() for x in v]
            node = np.concatenate([entry_ids[at].ravel(), own])
            who = np.concatenate([np.repeat(np.arange(len(q)), few), np.flatnonzero(has)])
            score = np.concatenate([np.take_along_axis(s, at, 1).ravel(), np.full(len(own), 3e38)])
            yield pa.RecordBatch.from_arrays([pa.array(q[who]), pa.array(node), pa.array(score), pa.array([raw[i] for i in who], pa.binary())], ["q", "node", "s", "raw"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4000):
                rows = batch.slice(start, 4000)
                count = np.diff(rows.column("near").offsets.to_numpy())
                near = rows.column("near").flatten().to_numpy()
                v = np.frombuffer(b"".join(x.as_buffer() for x in rows.column("raws")), np.float32).reshape(len(near), -1).astype(float)
                own = np.repeat(np.arange(len(rows)), count)
                s = np.einsum("ij,ij->i", v, _floats(rows.column("raw"), len(rows))[own])
                good = s > rows.column("floor").to_numpy()[own]
                q = rows.column("q").to_numpy()[own[good]]
                yield _edges(*best(q, near[good], s[good], beam)).rename_columns(["q", "node", "s"])

    start = scratch.table(asked.mapInArrow(enter, "q long, node long, s double, raw binary").dropDuplicates(["q", "node"]))
    raws = start.groupBy("q").agg(F.min("raw").alias("raw"))
    front = start.select("q", "node", "raw", F.lit(-3e38).alias("floor"))
    state = start.select("q", "node", "s", F.lit(True).alias("done"))
    for step in (*steps, 0):
        found = front.join(graph, "node").select("q", "raw", "floor", "near", "raws").mapInArrow(expand, "q long, node long, s double")
        merged = state.unionAll(found.select("q", "node", "s", F.lit(False).alias("done"))).groupBy("q", "node").agg(F.max("s").alias("s"), F.bool_or("done").alias("done"))
        ranked = merged.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))).where(F.col("r") <= beam)
        if not step:
            state = scratch.table(ranked.select("q", "node", "s"))
            break
        turn = F.row_number().over(Window.partitionBy("q").orderBy("done", F.desc("s"), "node"))
        floor = F.when(F.count(F.lit(1)).over(Window.partitionBy("q")) >= beam, F.min("s").over(Window.partitionBy("q"))).otherwise(F.lit(-3e38))
        ranked = scratch.table(ranked.withColumn("turn", turn).withColumn("floor", floor).select("q", "node", "s", "done", (~F.col("done") & (F.col("turn") <= step)).alias("go"), "floor"))
        front = ranked.where("go").select("q", "node", "floor").join(raws, "q").select("q", "node", "raw", "floor")
        state = ranked.select("q", "node", "s", (F.col("done") | F.col("go")).alias("done"))
    exact = state.select("q", "node").join(classes.select(F.col("id").alias("node"), "vec", "members"), "node").join(asked.select("q", F.col("vec").alias("other")), "q")
    dot = F.aggregate(F.zip_with("vec", "other", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    scored = exact.select("q", "node", dot.alias("score"), "members")
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))).where(F.col("r") <= k + 1)
    hits = top.select("q", "score", F.explode("members").alias("vec_id"))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("hits"))
    # every query takes its class's list without itself
    whose = queries.select("id", "vec").join(asked.select("q", "vec"), "vec").select("q", F.col("id").alias("query_id"))
    others = F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    final = whose.join(scratch.table(lists), "q").select("query_id", F.posexplode(others).alias("at", "hit"))
    return final.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op1(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    scratch = Scratch(spark, "op1")
    vectors = scratch.table(clean_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
    return search(vectors, vectors.where("id % 20 = 0"), 20, scratch)
