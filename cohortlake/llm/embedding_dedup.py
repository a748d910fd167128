"""Embedding near-duplicates on a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards (the few nearest
of sampled centres, split again where a shard stays large). Each shard builds
a flat graph by robust pruning; the adjacency lists a vector gets in its
shards are united. Every vector then searches its shards: greedily from the
shard's medoids and its own place, and on outwards as long as what it finds
is in range. Found pairs are verified in double precision on the original
vectors and counted once, whichever of their shards finds them: a task sends
spanning edges, counts of pairs that share no other shard, and packed lists of
the others, which are united for each vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import clean_vectors, usable
from .common import Scratch, partitions, whole_groups
from .components import components, contract

TARGET, LARGE, BLOCK = 500, 4000, 1500
OVERLAP, LEVELS, CENTRES = 3, 4, 64
DEGREE, POOL, ALPHA = 16, 48, 1.2
EXPANSIONS, SLACK = 16, 1e-4


def robust_prune(v: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """For each unit vector up to ``degree`` diverse near ones (-1 pads): the nearest
    candidate is taken, and those it lies ``alpha`` times closer to go, again and again."""
    m = len(v)
    out = np.full((m, degree), -1, np.int64)
    k = min(pool, m - 1)
    if k < 1:
        return out
    g = v @ v.T
    np.fill_diagonal(g, -2)
    near = np.argpartition(-g, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(g, near, 1), axis=1, kind="stable"), 1)
    away = 2 - 2 * np.take_along_axis(g, near, 1)
    alive = np.ones((m, k), bool)
    row = np.arange(m)
    for d in range(min(degree, k)):
        first = alive.argmax(1)
        some = alive[row, first]
        pick = near[row, first]
        out[some, d] = pick[some]
        alive[row, first] = False
        between = 2 - 2 * g[pick[:, None], near]
        np.fill_diagonal(g, -2)
        alive &= (alpha * alpha * between > away) | ~some[:, None]
    return out


def range_search(v: np.ndarray, adjacency: np.ndarray, asking: np.ndarray, entries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(asking index, node) pairs found with inner product >= threshold, itself excluded."""
    q, m = len(asking), len(v)
    score = np.full((q, m), -np.inf, np.float32)
    seen, expanded = np.zeros((q, m), bool), np.zeros((q, m), bool)
    own = np.arange(q)
    seen[own, asking] = True

    def look(at: np.ndarray, node: np.ndarray) -> None:
        keep = node >= 0
        at, node = at[keep], node[keep]
        fresh = ~seen[at, node]
        key = np.unique(at[fresh] * m + node[fresh])
        at, node = key // m, key % m
        seen[at, node] = True
        for part in np.array_split(np.arange(len(at)), len(at) // 200_000 + 1):
            score[at[part], node[part]] = np.einsum("ij,ij->i", v[asking[at[part]]], v[node[part]])

    def grow(at: np.ndarray, node: np.ndarray) -> None:
        expanded[at, node] = True
        step = 100_000
        for s in range(0, len(at), step):
            near = adjacency[node[s : s + step]]
            look(np.repeat(at[s : s + step], near.shape[1]), near.ravel())

    grow(own, asking)
    look(np.repeat(own, len(entries)), np.tile(entries, q))
    for _ in range(EXPANSIONS // 4):
        open_ = np.where(expanded, -np.inf, score)
        k = min(4, m)
        top = np.argpartition(-open_, k - 1, axis=1)[:, :k]
        good = np.take_along_axis(open_, top, 1) > -np.inf
        grow(np.repeat(own, k)[good.ravel()], top[good])
    while True:
        at, node = np.nonzero((score >= threshold) & ~expanded)
        if not len(at):
            return np.nonzero(score >= threshold)
        grow(at, node)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(ids: np.ndarray, mult: np.ndarray) -> bytes:
    """Ids and their class sizes, sorted by id, compressed."""
    order = np.argsort(ids)
    return zlib.compress(np.stack([np.diff(ids[order], prepend=0), mult[order]]).astype(np.int64).tobytes(), 1)


def united_links(found: DataFrame) -> DataFrame:
    """(a, links): the plain counts of (a, links, near) and the class sizes of the
    distinct ids in the packed lists, each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "a"):
            a, links = table.column("a").to_numpy(), table.column("links").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
            total = np.add.reduceat(links, cut[:-1])
            near = table.column("near").to_pylist()
            for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
                lists = [np.frombuffer(zlib.decompress(b), np.int64).reshape(2, -1) for b in near[x:y] if b]
                if lists:
                    ids, at = np.unique(np.concatenate([np.cumsum(b[0]) for b in lists]), return_index=True)
                    total[k] += np.concatenate([b[1] for b in lists])[at].sum()
            yield pa.RecordBatch.from_arrays([pa.array(a[cut[:-1]]), pa.array(total)], ["a", "links"])

    return found.repartition(partitions(found.sparkSession), "a").sortWithinPartitions("a").mapInArrow(run, "a long, links long")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def shards(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label, vec, mult, shard): every vector in up to ``OVERLAP`` shards of each level."""
    now = scratch.table(classes.withColumn("shard", F.xxhash64("label")))
    for level in range(LEVELS):
        sizes = now.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
        large = scratch.table(sizes.where(F.col("size") > (TARGET * 2 if level == 0 else LARGE)))
        if large.isEmpty():
            break
        draw = Window.partitionBy("shard").orderBy(F.xxhash64("id", F.lit(level)), "id")
        drawn = now.join(large, "shard").withColumn("r", F.row_number().over(draw)).where((F.col("r") <= CENTRES) & (F.col("r") <= F.ceil(F.col("size") / TARGET)))
        centres = scratch.table(drawn.groupBy("shard").agg(F.collect_list(F.struct("r", "vec")).alias("centres")))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = batch.column("shard").to_numpy().copy()
                rows, where = [], []
                asked = batch.column("centres")
                for s in np.unique(shard):
                    mine = np.flatnonzero(shard == s)
                    given = asked[int(mine[0])]
                    if not given.is_valid:
                        rows.append(mine)
                        where.append(np.full(len(mine), s))
                        continue
                    given = sorted(given.as_py(), key=lambda c: c["r"])
                    c = _unit(np.array([g["vec"] for g in given]))
                    v = _unit(_matrix(pa.chunked_array([batch.column("vec").take(pa.array(mine))])))
                    k = min(OVERLAP, len(c))
                    near = np.argpartition(-(v @ c.T), k - 1, axis=1)[:, :k]
                    rows.append(np.repeat(mine, k))
                    with np.errstate(over="ignore"):
                        where.append((np.int64(s) * np.int64(6364136223846793005) + near.ravel() + 1 + level * 1000))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(at) for x in ("id", "label", "vec", "mult")), pa.array(np.concatenate(where))], ["id", "label", "vec", "mult", "shard"])

        joined = now.join(centres, "shard", "left").select("id", "label", "vec", "mult", "shard", "centres")
        after = scratch.table(joined.mapInArrow(deal, now.schema).dropDuplicates(["id", "shard"]))
        scratch.drop(now)
        now = after
    return now


def near_duplicates(rows: DataFrame, scratch: Scratch, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Pairs of equal, non-null label link at cosine >= ``threshold``. Unusable
    vectors (see ``ann.usable``), null labels and null ids link with nothing:
    no links, their own component (null for a null id), kept. Rows that share
    an id are one vector. Equal vectors of a label form one class, whose
    members all link; classes are compared once.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    plain = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vec"), F.col(f"`{label_col}`").alias("label"))
    labels = plain.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    valid = clean_vectors(plain.where("label is not null"), "id", "vec").join(labels, "id")
    valid = scratch.table(valid)
    classes = scratch.table(valid.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult")))
    members = shards(classes.select("id", "label", "vec", "mult"), scratch)
    of = members.groupBy("id").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    blocks = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = scratch.table(members.join(of, "id").join(scratch.table(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard", "block"):
            key = np.stack([table.column(c).to_numpy() for c in ("shard", "block")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(table)]
            for x, y in zip(cut[:-1], cut[1:]):
                part = table.slice(x, y - x)
                ids = part.column("id").to_numpy()
                near = robust_prune(_unit(_matrix(part.column("vec"))).astype(np.float32))
                a, b = np.repeat(ids, near.shape[1]), near.ravel()
                a, b = a[b >= 0], ids[b[b >= 0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.repeat([0, 1], [len(a), len(b)]))], ["a", "b", "back"])

    flat = members.select("shard", "block", "id", "vec").repartition(n, "shard", "block").sortWithinPartitions("shard", "block").mapInArrow(build, "a long, b long, back long")
    # the united lists; of the edges that only come back to a node, a bounded draw
    once = flat.groupBy("a", "b").agg(F.min("back").alias("back"))
    draw = Window.partitionBy("a").orderBy("back", F.xxhash64("a", "b"), "b")
    united = once.withColumn("r", F.row_number().over(draw)).where(F.col("r") <= 4 * DEGREE).groupBy("a").agg(F.collect_list("b").alias("near"))
    known = members.join(united.withColumnRenamed("a", "id"), "id", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = known.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "vec", "mult", "shards", "near")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard", "i", "j"):
            key = np.stack([table.column(c).to_numpy() for c in ("shard", "i", "j")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(table)]
            for x, y in zip(cut[:-1], cut[1:]):
                yield unit(table.slice(x, y - x), int(key[1, x]), int(key[2, x]))

    def unit(part: pa.Table, i: int, j: int) -> pa.RecordBatch:
        part = part.combine_chunks()
        ids, block, mult = (part.column(c).to_numpy() for c in ("id", "block", "mult"))
        v = _unit(_matrix(part.column("vec")))
        low = v.astype(np.float32)
        place = {int(x): k for k, x in enumerate(ids)}
        lists = [[place[b] for b in near if b in place] if near else [] for near in part.column("near").to_pylist()]
        adjacency = np.full((len(ids), max(1, max(map(len, lists)))), -1, np.int64)
        for k, near in enumerate(lists):
            adjacency[k, : len(near)] = near
        mean = low.mean(0)
        medoids = np.array(sorted({int((low[block == b] @ mean).argmax() + 0) if i == j else int(np.flatnonzero(block == b)[(low[block == b] @ mean).argmax()]) for b in (i, j)}))
        asking = np.flatnonzero(block == i)
        at, node = range_search(low, adjacency, asking, medoids, threshold - SLACK)
        at = asking[at]
        if i != j:
            cross = block[node] == j
            a, b = at[cross], node[cross]
        else:
            a, b = np.minimum(at, node), np.maximum(at, node)
        pair = np.unique(a * len(ids) + b)
        a, b = pair // len(ids), pair % len(ids)
        exact = np.zeros(len(a), bool)
        for s in range(0, len(a), 100_000):
            exact[s : s + 100_000] = np.einsum("ij,ij->i", v[a[s : s + 100_000]], v[b[s : s + 100_000]]) >= threshold
        a, b = a[exact], b[exact]
        # a pair with another shared shard may be found there too
        of = [set(x) for x in part.column("shards").to_pylist()]
        more = np.fromiter((len(of[x] & of[y]) > 1 for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
        links = np.bincount(a[~more], mult[b[~more]], len(ids)) + np.bincount(b[~more], mult[a[~more]], len(ids))
        one, other = np.concatenate([a[more], b[more]]), np.concatenate([b[more], a[more]])
        order = np.argsort(one, kind="stable")
        one, other = one[order], other[order]
        cut = np.searchsorted(one, np.arange(len(ids) + 1))
        node, root = contract(np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]))
        low_of = dict(zip(node.tolist(), root.tolist()))
        some = np.flatnonzero((links > 0) | (np.diff(cut) > 0))
        near = [packed(ids[other[cut[x] : cut[x + 1]]], mult[other[cut[x] : cut[x + 1]]]) if cut[x + 1] > cut[x] else None for x in some]
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([low_of.get(int(x), int(x)) for x in ids[some]], pa.int64()), pa.array(links[some].astype(np.int64)), pa.array(near, pa.binary())], ["a", "b", "links", "near"])

    found = scratch.table(known.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(find, "a long, b long, links long, near binary"))
    parts = components(found.select("a", "b"), scratch)
    counts = united_links(found.select("a", "links", "near")).withColumnRenamed("a", "rep")
    joined = classes.select(F.col("id").alias("rep"), "label", "vec", "mult").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.table(joined.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    final = scratch.table(valid.join(named, ["label", "vec"]).select("id", "n_links", "component_id"))
    out = plain.select("id").join(final, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(rows: DataFrame, result: DataFrame, scratch: Scratch, sample: int = 64, threshold: float = 0.98) -> float:
    """Share of the true links of at most ``sample`` vectors (drawn by a hash of the
    id among usable ones with a label) that ``result`` counts; 1.0 if they have none.
    The sample is compared with all rows of its labels, in blocks."""
    plain = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label").where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    drawn = plain.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by ``sample``
    if not drawn:
        return 1.0
    of, label, ids = _unit(np.array([r["vec"] for r in drawn])), np.array([r["label"] for r in drawn]), [r["id"] for r in drawn]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                v = _unit(_matrix(pa.chunked_array([batch.column("vec")])))
                same = batch.column("label").to_numpy()[:, None] == label[None]
                other = batch.column("id").to_numpy()[:, None] != np.array(ids)[None]
                total += ((v @ of.T >= threshold) & same & other).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

    true = plain.mapInArrow(block, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    found = result.where(F.col("vec_id").isin(ids)).select("vec_id", "n_links").distinct()
    sums = true.join(found, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return 1.0 if not sums[0] else sums[1] / sums[0]


def op2(spark, sf_dir: str) -> DataFrame:
    """Cosine 0.98 within labels over all rows; ``audit_recall`` is measured on a drawn sample."""
    rows, scratch = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op2")
    result = scratch.table(near_duplicates(rows, scratch))
    return result.withColumn("audit_recall", F.lit(audit(rows, result, scratch)))
