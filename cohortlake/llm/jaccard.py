"""Exact n-gram Jaccard self-join by signature trees over pigeonhole groups.

Two sets with Jaccard similarity t or more, the smaller of ``s`` elements,
differ in at most ``d(s)`` elements. Cut by hash into more than ``d`` pieces,
they agree on a whole piece, so every link joins two sets that post an equal
piece. Sets that post an equal piece are compared by their profiles, counts of
shingles in few bins: these differ by no more than the sets do, so pairs whose
profiles are too far apart, such as texts that share a passage, can't link.
Sets that are connected by pairs which are left form a group.

Each group is resolved by a signature tree: nodes hold OR-combined bitmaps of
the shingles that any two sets of the group share, size ranges and the range
of components below them; a dual traversal drops node pairs whose maximum
possible overlap is below the overlap that the threshold asks for, or that lie
in one component. Surviving leaves are verified on their whole sets as the
traversal reaches them and joined at once, the sets nearest to the group's
majority first, so that a group of copies costs a spanning forest, not its
pairs.

A group of more than ``block`` sets is dealt to blocks. Each block gets its
own tree and names its most central sets; the most central of the group meet
every block. What can still link are sets outside of the group's largest
component: if they are few, they meet every block; if they are many, the group
is loose, and sets meet only where they post an equal piece and lie in
different components: as distinct pairs for pieces of few sets, else in a tree
for each piece. Every pair is verified, known to be connected, or excluded by a
bound, so no link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, chunks, partitions, whole_groups
from .components import components, contract, forest

BLOCK = 2048
#: Central sets that a group of several blocks shows to all of them.
PIVOTS = 64
#: Sets of one piece up to which the pairs that it leaves open are written as such.
FEW = 8
#: Sets of one piece in a task, and in all, beyond which they are tied unseen.
MANY, LOOSE = 64, 2048
#: A key that marks a piece whose sets a task has tied.
MARK = np.iinfo(np.int64).min
#: Shingles that a block holds, unless one set has more.
BLOCK_GRAMS = 2 << 20
FAN = 8
_U = np.uint64


def row_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = W.LOWER[data]
    starts, ends, first = W.split(data, offsets, W.NOT_SPACE)
    hashes = W.span_hashes(W.prefix_sums(data), starts, ends)
    grams, at = W.shingles(hashes, first, size)
    return [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def set_key(grams: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    total = W.mix(grams + _U(1)).sum(dtype=_U) + _U(len(grams))
    return int(W.mix(np.array([total ^ np.bitwise_xor.reduce(W.mix(grams + _U(0x1234567)), initial=_U(0))])).view(np.int64)[0])


def profile(grams: np.ndarray) -> bytes:
    """Counts (255 at most) of the shingles by the head of their hashes, in a power of two of bins:
    one for eight shingles, as in fuller bins sets that share nothing would differ too little."""
    bins = min(1 << 20, max(16, 1 << max(0, math.ceil(math.log2(max(1, len(grams)) / 8)))))
    return np.minimum(np.bincount((grams >> _U(40)).astype(np.int64) * bins >> 24, minlength=bins), 255).astype(np.uint8).tobytes()


class Profiles:
    """Profiles of many sets, compared in the bins of the shorter one."""

    def __init__(self, raws: list[bytes], sizes: np.ndarray, percent: int):
        self.sizes, self.percent = sizes, percent
        self.width = np.array([len(r) for r in raws], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by width: each set's row, and a table of the sets that are so wide
        wide, last = np.zeros(0, np.int64), np.zeros((0, 1), np.int16)
        for w in sorted(set(self.width.tolist()), reverse=True):
            own = np.flatnonzero(self.width == w)
            folded = np.minimum(last.reshape(len(wide), w, -1).sum(2), 255) if len(wide) else np.zeros((0, w))
            last = np.concatenate([folded.astype(np.int16), np.frombuffer(b"".join(raws[i] for i in own), np.uint8).reshape(len(own), w).astype(np.int16)])
            wide = np.append(wide, own)
            row = np.full(len(raws), -1)
            row[wide] = np.arange(len(wide))
            self.at[w] = row, last

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the sets can still link."""
        out = np.zeros(len(i), bool)
        alike = 100 * np.minimum(self.sizes[i], self.sizes[j]) >= self.percent * np.maximum(self.sizes[i], self.sizes[j])
        width = np.where(alike, np.minimum(self.width[i], self.width[j]), 0)
        most = (100 - self.percent) * (self.sizes[i] + self.sizes[j]) // (100 + self.percent)
        for w, (row, table) in self.at.items():
            for part in np.array_split(np.flatnonzero(width == w), len(i) * w // (4 << 20) + 1):
                if len(part):
                    out[part] = np.abs(table[row[i[part]]] - table[row[j[part]]]).sum(1) <= most[part]
        return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


class Bands:
    """Sizes in bands. A pair is posted in the band of its smaller set: both
    sets are cut into ``pieces`` there, of which at most ``differ`` differ."""

    def __init__(self, percent: int, ratio: float = 1.35):
        self.percent = percent
        upper, differ, pieces = [], [], []
        u = next((n for n in range(1, 200) if self._differ(n)), 0)  # below it only equal sets link
        self.least = u
        low = u
        while u and u < 1 << 40:
            d = self._differ(u)
            m, spare = d + 1, 0
            for _ in range(4):  # as many pieces more as are likely to be empty
                empty = (m + spare) * math.exp(-low / (m + spare))
                spare = math.ceil(empty + 2 * math.sqrt(empty))
            upper.append(u)
            differ.append(d)
            pieces.append(m + spare)
            low, u = u + 1, max(u + 1, int(u * ratio))
        self.upper, self.differ, self.pieces = (np.array(x, np.int64) for x in (upper, differ, pieces))

    def _differ(self, n: int) -> int:
        """Elements in one set alone, at most, if the smaller set has n at most."""
        return (100 - self.percent) * (n + n * 100 // self.percent) // (100 + self.percent)

    def pieces_of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pieces that each set posts, and each set's first one.

        A set posts its pieces that aren't empty. Where these are no more than
        ``differ``, it posts the empty ones too: a pair that agrees on empty
        pieces alone has two such sets.
        """
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, _U)])
        mixed = W.mix(flat + _U(0x51ED27))
        first = np.concatenate([[0], np.cumsum(n)])
        some = np.flatnonzero(n >= self.least) if self.least else np.zeros(0, np.int64)
        own = np.searchsorted(self.upper, n)
        lowest = np.searchsorted(self.upper, np.maximum((n * self.percent + 99) // 100, self.least))
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
        for shift in range(int((own - lowest)[some].max(initial=-1)) + 1):
            mine = some[(own - lowest)[some] >= shift]
            band = own[mine] - shift
            length = n[mine]
            at = np.repeat(first[mine] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            row = np.repeat(np.arange(len(mine)), length)
            piece = ((flat[at] >> _U(32)) * self.pieces[band].astype(_U)[row]) >> _U(32)
            new = np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]))
            begin = np.flatnonzero(new)
            name = W.mix(band.astype(_U)[row[begin]] * _U(1 << 32) + piece[begin])
            rows.append(mine[row[begin]])
            hashes.append(W.mix(np.add.reduceat(mixed[at], begin) + name))
            ends = np.cumsum(length)
            for i in np.flatnonzero(np.bincount(row[begin], minlength=len(mine)) <= self.differ[band]):
                empty = np.setdiff1d(np.arange(self.pieces[band[i]]), piece[ends[i] - length[i] : ends[i]].astype(np.int64)).astype(_U)
                rows.append(np.full(len(empty), mine[i]))
                hashes.append(W.mix(W.mix(_U(int(band[i]) << 32) + empty)))
        rows_, hashes_ = np.concatenate(rows), np.concatenate(hashes)
        order = np.argsort(rows_, kind="stable")
        return hashes_[order], np.searchsorted(rows_[order], np.arange(len(sets) + 1))


def bitmaps(sets: list[np.ndarray], most: int = 1 << 25) -> tuple[np.ndarray, np.ndarray]:
    """(bits, excess): a bit for each shingle that stands in two sets or more, so
    that a pair's common bits are its overlap; beyond ``most`` bits in all, bits
    are shared, and excess says how many shingles of a set lie on bits it has
    already."""
    all_ = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, counts = np.unique(all_, return_counts=True)
    shared = values[counts > 1]
    if not len(shared):
        return np.zeros((len(sets), 1), np.uint8), np.zeros(len(sets), np.int64)
    at = np.minimum(np.searchsorted(shared, all_), len(shared) - 1)
    here = shared[at] == all_
    width = min(-(-len(shared) // 8) * 8, max(64, most // len(sets) // 8 * 8))
    bits = np.zeros((len(sets), width), bool)
    bits[row[here], at[here] % width] = True
    bits = np.packbits(bits, axis=1)
    return bits, np.bincount(row[here], minlength=len(sets)) - np.bitwise_count(bits).sum(1, dtype=np.int64)


class SignatureTree:
    """Sets as leaves, alike ones side by side, packed bottom-up."""

    def __init__(self, chosen: np.ndarray, sets: list[np.ndarray], bits: np.ndarray, excess: np.ndarray):
        least = np.array([sets[i][0] for i in chosen], _U)
        sizes = np.array([len(sets[i]) for i in chosen], np.int64)
        order = np.lexsort((sizes, least))  # near copies often share their least hash
        self.leaves, sizes = chosen[order], sizes[order]
        self.levels = [(bits[self.leaves], sizes, sizes, excess[self.leaves])]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, excess = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def relabel(self, part: np.ndarray) -> None:
        """part: component of each set."""
        self.parts = [(part[self.leaves],) * 2]
        while len(self.parts[-1][0]) > 1:
            least, most = self.parts[-1]
            at = np.arange(0, len(least), FAN)
            self.parts.append((np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def possible(self, other: SignatureTree, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether any pair below nodes a and b can still be a new link."""
        bits, low, high, excess = self.levels[mine := min(level, len(self.levels) - 1)]
        bits2, low2, high2, excess2 = other.levels[its := min(level, len(other.levels) - 1)]
        (least, most), (least2, most2) = self.parts[mine], other.parts[its]
        keep = ((least[a] != most[a]) | (least2[b] != most2[b]) | (least[a] != least2[b])) & (high[a] * 100 >= low2[b] * percent) & (high2[b] * 100 >= low[a] * percent)
        at = np.flatnonzero(keep)
        for part in np.array_split(at, max(1, len(at) * bits.shape[1] // (16 << 20) + 1)):
            x, y = a[part], b[part]
            most_common = np.bitwise_count(bits[x] & bits2[y]).sum(1, dtype=np.int64) + np.minimum(excess[x], excess2[y])
            most_common = np.minimum(most_common, np.minimum(high[x], high2[y]))
            keep[part] = most_common * (100 + percent) >= (low[x] + low2[y]) * percent
        return keep

    def pairs(self, other: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: leaf pairs that survive, each unordered pair once.

        ``relabel`` may be called between pairs; nodes that have come to lie in
        one component meanwhile are dropped."""
        same = self is other
        top = max(len(self.levels), len(other.levels)) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 1 << 14:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            keep = self.possible(other, level, a, b, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                keep = a < b if same else slice(None)
                yield self.leaves[a[keep]], other.leaves[b[keep]]
                continue
            near = a == b if same else np.zeros(len(a), bool)
            for some in (np.flatnonzero(~near), np.flatnonzero(near)):  # the last is taken first: pairs within a node
                if len(some):
                    x, y = self._below(level, a[some], np.arange(FAN * FAN) // FAN, self), self._below(level, b[some], np.arange(FAN * FAN) % FAN, other)
                    ok = (x >= 0) & (y >= 0) & ((x <= y) | (not same))
                    stack.append((level - 1, x[ok], y[ok]))

    @staticmethod
    def _below(level: int, nodes: np.ndarray, step: np.ndarray, tree: SignatureTree) -> np.ndarray:
        """Children of the nodes, FAN * FAN for each; -1 where there is none."""
        if level >= len(tree.levels):  # a lower tree waits at its root
            return np.where(step == 0, nodes[:, None], -1).ravel()
        child = nodes[:, None] * FAN + step
        return np.where(child < len(tree.levels[level - 1][0]), child, -1).ravel()


def centrality(bits: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """How like each chosen set is to the shingles that most of them have, from 0 to 1."""
    plain = np.zeros(bits.shape[1] * 8, np.int64)
    for part in np.array_split(chosen, max(1, len(chosen) * len(plain) // (8 << 20))):
        plain += np.unpackbits(bits[part], axis=1).sum(0, dtype=np.int64)
    majority = np.packbits(2 * plain > len(chosen))
    common = np.bitwise_count(bits[chosen] & majority).sum(1, dtype=np.int64)
    return common / np.maximum(1, sizes[chosen] + int(np.bitwise_count(majority).sum()) - common)


def spanning_links(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int) -> tuple[list[tuple[int, int]], np.ndarray | None]:
    """Verified links that join all components which links join: of sets
    ``left`` with each other, or with those of ``right``; and, of ``left``
    alone, each one's centrality.

    part: a number for the component that each set is known to lie in.
    """
    _, part = np.unique(part, return_inverse=True)
    found: list[tuple[int, int]] = []

    def meet(i: int, j: int) -> None:
        if part[i] != part[j] and linked(sets[i], sets[j], percent):
            found.append((i, j))
            part[part == part[j]] = part[i]

    if right is None and len(left) == 2:
        meet(*left)
        return found, np.ones(2)
    bits, excess = bitmaps(sets)
    sizes = np.array([len(x) for x in sets], np.int64)

    def star(centre: int, others: np.ndarray) -> None:
        common = np.bitwise_count(bits[others] & bits[centre]).sum(1, dtype=np.int64) + np.minimum(excess[others], excess[centre])
        for j in others[common * (100 + percent) >= (sizes[others] + sizes[centre]) * percent].tolist():
            meet(centre, j)

    central = centrality(bits, sizes, left if right is None else right)
    for k in np.argsort(-central, kind="stable")[:4]:
        star(int((left if right is None else right)[k]), left)
    one = SignatureTree(left, sets, bits, excess)
    two = one if right is None else SignatureTree(right, sets, bits, excess)
    for tree in {one, two}:
        tree.relabel(part)
    for a, b in one.pairs(two, percent):
        before = len(found)
        for i, j in zip(a.tolist(), b.tolist()):
            meet(i, j)
        if len(found) > before:
            for tree in {one, two}:
                tree.relabel(part)
    return found, central if right is None else None


def link_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    docs: any columns besides ``id_col`` (an integer) and ``text_col``; words
    are runs of bytes other than ASCII white space, with A-Z lower-cased; a
    text of fewer words than ``size`` is one shingle; without words (null,
    empty, blank) the set is empty and links with nothing. Documents link when
    ``100 * intersection >= percent * union``. Rows with a null id get their
    size and a null component and link with nothing; rows that share an id
    are one document, which links with all that any of its texts links with
    (a row of it without words keeps its own id).
    Equal sets form one class, so copies are never expanded into pairs (a set
    is known by 64 bits of its shingles, each shingle by 64 bits of its
    words). ``percent`` must lie in 50..100. ``block``: the most classes that
    one tree holds; it changes the work's order, never the result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie in 50..100")
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bands = Bands(percent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            sets = row_shingles(data, offsets, size)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([profile(s) for s in sets], pa.binary())], ["doc_id", "n", "key", "profile"])

    whole = scratch.table(texts.mapInArrow(describe, "doc_id long, n long, key long, profile binary"))
    described = scratch.table(whole.select("doc_id", "n", "key"))  # outlives the profiles
    linkable = described.where("n > 0 and doc_id is not null")
    posting = whole.where(F.col("doc_id").isNotNull() & (F.col("n") >= max(1, bands.least)))
    classes = scratch.table(linkable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's postings, from the texts: pieces are made again rather than kept in a
        table beside the shuffle. Of a piece that very many of its sets post, one and a
        mark, with links from it to the others as pieces that only their two ends
        post: a hot piece travels once per task."""
        schema = pa.schema([("piece", pa.int64()), ("key", pa.int64())])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> pa.RecordBatch:
            piece, key = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.lexsort((key, piece))
            piece, key = piece[order], key[order]
            new = np.append(True, (piece[1:] != piece[:-1]) | (key[1:] != key[:-1]))
            piece, key = piece[new], key[new]
            first = np.append(True, piece[1:] != piece[:-1])
            group = np.cumsum(first) - 1
            hot = (np.bincount(group) > MANY)[group]
            lead = key[np.flatnonzero(first)][group]
            a, b = contract(lead[hot & ~first], key[hot & ~first])
            link = W.mix(W.mix(a.view(_U)) + b.view(_U)).view(np.int64)
            marked = piece[hot & first]
            keep = ~hot | first
            mark = np.full(len(marked) + len(link), MARK)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([piece[keep], link, link, marked, link])), pa.array(np.concatenate([key[keep], a, b, mark]))], schema=schema)

        for _, data, offsets in chunks(batches, "text"):
            sets = row_shingles(data, offsets, size)
            values, first = bands.pieces_of(sets)
            held.append((values.view(np.int64), np.repeat(np.array([set_key(s) for s in sets], np.int64), np.diff(first))))
            if sum(len(x[0]) for x in held) > 1 << 20:
                yield combined()
                held = []
        if sum(len(x[0]) for x in held):
            yield combined()

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The postings of pieces that several sets post; rows come sorted by piece and key."""
        last, sent = np.zeros((2, 0), np.int64), False
        for batch in batches:
            if not len(batch):
                continue
            posted = np.append(last, np.stack([batch.column(i).to_numpy() for i in (0, 1)]), axis=1)
            done = np.zeros(posted.shape[1], bool)
            done[: last.shape[1]] = sent
            new = np.append(True, (posted[:, 1:] != posted[:, :-1]).any(0))
            posted, done = posted[:, new], done[new]
            same = posted[0, 1:] == posted[0, :-1]
            several = np.append(same, False) | np.append(False, same)
            out = posted[:, several & ~done]
            last, sent = posted[:, -1:], bool(several[-1] or done[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["piece", "key"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between sets of one piece that can link; within marked and very large pieces, between all."""

        def links(table: pa.Table) -> pa.RecordBatch:
            piece, key = table.column("piece").to_numpy(), table.column("key").to_numpy()
            raws = [x or b"\0" * 16 for x in table.column("profile").to_pylist()]
            known = Profiles(raws, table.column("n").fill_null(0).to_numpy(), percent)
            first = np.append(True, piece[1:] != piece[:-1])
            group = np.cumsum(first) - 1
            size = np.bincount(group)
            free = (np.bincount(group, key == MARK) > 0) | (size > LOOSE)
            pairs, tied = [(np.zeros(0, np.int64),) * 2], [(np.zeros(0, np.int64),) * 2]
            for k in range(1, FEW):
                i = np.flatnonzero((group[k:] == group[:-k]) & ((size <= FEW) & ~free)[group[k:]])
                pairs.append((i, i + k))
            begin = np.flatnonzero(first)
            for g in np.flatnonzero((size > FEW) & ~free):
                i, j = np.triu_indices(size[g], 1)
                ok = known.close(begin[g] + i, begin[g] + j)
                tied.append(contract(begin[g] + i[ok], begin[g] + j[ok]))
            i, j = (np.concatenate([p[x] for p in pairs]) for x in (0, 1))
            ok = known.close(i, j)
            i, j = (np.concatenate([x[ok], *(t[at] for t in tied)]) for at, x in enumerate((i, j)))
            chained = np.flatnonzero(free[group] & ~first)
            lead = begin[group]
            # a link's ends bear no mark: the mark is the least key, so chains start behind it
            lead = np.where((key[lead] == MARK) & (lead + 1 < len(key)), lead + 1, lead)[chained]
            real = (key[chained] != MARK) & (key[lead] != MARK) & (lead != chained)
            return pa.RecordBatch.from_arrays([pa.array(np.append(key[i], key[lead[real]])), pa.array(np.append(key[j], key[chained[real]]))], ["a", "b"])

        yield from forest(links(table) for table in whole_groups(batches, "piece"))

    posted = texts.where("doc_id is not null and text is not null").select("text").mapInArrow(post, "piece long, key long").repartition(partitions(spark), "piece").sortWithinPartitions("piece", "key")
    shared = scratch.table(posted.mapInArrow(share, "piece long, key long"))
    profiles = posting.groupBy("key").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
    compared = shared.join(profiles.hint("merge"), "key", "left").select("piece", "key", "n", "profile")
    compared = compared.repartition(partitions(spark), "piece").sortWithinPartitions("piece", "key")
    groups = components(compared.mapInArrow(meet, "a long, b long"), scratch, reduced=True)
    scratch.drop(shared)
    scratch.drop(whole)

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each wanted class once, with its set."""
        seen: set[tuple[int, int]] = set()
        names = ["of", "blocks", "block", "rep", "key", "n"]
        for rows, data, offsets in chunks(batches, "text"):
            if len(seen) > 100_000:  # one that comes again costs time only
                seen = set()
            keys = list(zip(rows.column("rep").to_pylist(), rows.column("key").to_pylist()))
            sets, at = [], []
            for i, grams in enumerate(row_shingles(data, offsets, size)):
                if keys[i] not in seen and set_key(grams) == keys[i][1]:
                    seen.add(keys[i])
                    sets.append(grams.tobytes())
                    at.append(i)
            rows = rows.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "grams"])

    def pieces_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = batch.slice(start, 256)
                values, first = bands.pieces_of([np.frombuffer(x.as_buffer(), _U) for x in rows.column("grams")])
                at = pa.array(np.repeat(np.arange(len(rows)), np.diff(first)))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(rows.column(c).take(at) for c in ("rep", "key", "part"))], ["piece", "rep", "key", "part"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("of", pa.int64()), ("key", pa.int64()), ("central", pa.float64())])
        for table in whole_groups(batches, "of", "place"):
            of, place = table.column("of").to_numpy(), table.column("place").to_numpy()
            cut = np.flatnonzero((of[1:] != of[:-1]) | (place[1:] != place[:-1])) + 1
            out: list[tuple] = []
            for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(table)]):
                mine = table.slice(begin, end - begin).combine_chunks()
                sets = [np.frombuffer(x.as_buffer(), _U) for x in mine.column("grams")]
                rep, key, part, side = (mine.column(c).to_numpy() for c in ("rep", "key", "part", "side"))
                left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
                if len(left) > 1 and side[left[0]] > 1:
                    found, central = spanning_links(sets, part, left, None, percent)
                elif len(left) and len(right):
                    found, central = spanning_links(sets, part, left, right, percent)
                else:
                    found, central = [], np.ones(len(left)) if len(left) and side[left[0]] > 1 else None
                out += [(int(rep[i]), int(rep[j]), None, None, None) for i, j in found]
                if side[0] == 3:
                    top = np.argsort(-central, kind="stable")[:PIVOTS]
                    out += [(int(rep[left[k]]), None, int(of[begin]), int(key[left[k]]), float(central[k])) for k in top]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def resolved(rows: DataFrame) -> DataFrame:
        """rows (of: group, places: array of 4 * place + side, part, rep, key, grams) -> (a, b) verified
        links, and (a, of, key, central) for the central sets of each place of side 3.

        side: 0 meets 1 of the same group and place; 2 and 3 all others there."""
        dealt = rows.withColumn("to", F.explode("places")).select("of", F.shiftright("to", 2).alias("place"), F.col("to").bitwiseAND(3).alias("side"), "part", "rep", "key", "grams")
        dealt = dealt.repartition(partitions(spark), "of", "place").sortWithinPartitions("of", "place")
        return scratch.table(dealt.mapInArrow(trees, "a long, b long, of long, key long, central double"))

    def needed(members: DataFrame) -> DataFrame:
        """(of, blocks): as many blocks as the group's sets need."""
        return members.groupBy("of").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))

    hashed = lambda n: F.pmod(F.xxhash64("rep", "key"), F.col(n))
    place = lambda i, side: F.array(i * 4 + side)
    members = scratch.table(groups.select(F.col("node").alias("key"), F.col("component").alias("of")).join(classes, "key"))
    members = members.join(needed(members), "of").withColumn("block", hashed("blocks"))
    # both sides grow with the data: never a broadcast
    wanted = texts.where("text is not null").join(members.hint("merge"), F.col("doc_id") == F.col("rep")).select("text", "of", "blocks", "block", "rep", "key", "n")
    sets = scratch.table(wanted.mapInArrow(whole_sets, "of long, blocks long, block long, rep long, key long, n long, grams binary"))
    first = resolved(sets.select("of", place(F.col("block"), F.when(F.col("blocks") > 1, 3).otherwise(2)).alias("places"), F.col("rep").alias("part"), "rep", "key", "grams"))
    links = first.where("b is not null").select("a", "b")
    large = sets.where("blocks > 1")
    if not large.isEmpty():
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        ranked = first.where("b is null").withColumn("r", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("central"), "a", "key")))
        pivots = scratch.table(ranked.where(F.col("r") <= PIVOTS).select("of", F.col("a").alias("rep"), "key"))
        shown = large.join(pivots, ["of", "rep", "key"]).select("of", F.transform(every("blocks"), lambda i: i * 4 + 1).alias("places"), F.col("rep").alias("part"), "rep", "key", "grams")
        met = resolved(large.select("of", place(F.col("block"), F.lit(0)).alias("places"), F.col("rep").alias("part"), "rep", "key", "grams").unionAll(shown))
        links = links.unionAll(met.select("a", "b"))
        parts = components(links, scratch)
        now = large.drop("grams").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
        now = scratch.table(now.select("of", "blocks", "block", "rep", "key", "n", "part"))
        sized = now.groupBy("of", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("of").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
        minor = now.join(sized, "of").where("part <> main")
        sides = scratch.table(needed(minor).withColumnRenamed("blocks", "sides"))
        if not sides.isEmpty():
            # few sets outside of the main component: they meet every block
            last = now.join(sized, "of").join(sides.where("sides = 1"), "of").join(large.select("of", "rep", "key", "grams"), ["of", "rep", "key"])
            in_block = F.array(F.col("block") * 4)
            places = F.when(F.col("part") == F.col("main"), in_block).otherwise(F.concat(in_block, F.transform(every("blocks"), lambda i: i * 4 + 1)))
            beside = last.select("of", places.alias("places"), "part", "rep", "key", "grams")
            # many: a loose group, whose sets meet where they post an equal piece
            loose = now.join(sides.where("sides > 1"), "of").select("rep", "key", "part").join(large.select("rep", "key", "grams"), ["rep", "key"])
            posts = scratch.table(loose.mapInArrow(pieces_again, "piece long, rep long, key long, part long"))
            open_ = posts.groupBy("piece").agg(F.count(F.lit(1)).alias("m"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("piece", "m")
            opened = scratch.table(posts.join(open_, "piece"))
            scratch.drop(posts)
            few = opened.where(F.col("m") <= FEW).groupBy("piece").agg(F.collect_list(F.struct("key", "rep", "part")).alias("all"))
            pairs = few.select(F.explode(F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y["key"] > x["key"]) & (y["part"] != x["part"])), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
            pairs = pairs.select("p.x", "p.y").distinct().select(F.xxhash64("x.key", "y.key").alias("of"), F.explode(F.array("x", "y")).alias("z"))
            pairs = pairs.select("of", F.array(F.lit(2).cast("long")).alias("places"), "z.part", "z.rep", "z.key")
            blocks = F.ceil(F.col("m") / block)
            crowd = opened.where(F.col("m") > FEW).withColumn("blocks", blocks).withColumn("block", hashed("blocks"))
            tiles = F.transform(every("blocks"), lambda o: (F.least("block", o) * F.col("blocks") + F.greatest("block", o)) * 4 + F.when(F.col("block") == o, 2).when(F.col("block") < o, 0).otherwise(1))
            crowd = crowd.select(F.col("piece").alias("of"), tiles.alias("places"), "part", "rep", "key")
            across = pairs.unionAll(crowd).join(large.select("rep", "key", "grams"), ["rep", "key"]).select("of", "places", "part", "rep", "key", "grams")
            links = links.unionAll(resolved(beside.unionAll(across)).select("a", "b"))
            scratch.drop(opened)

    # an id with several sets ties their classes together
    several = linkable.groupBy("doc_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("doc_id")
    ties = linkable.join(several, "doc_id").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = components(links.unionAll(ties), scratch)
    scratch.drop(sets)
    named = linkable.select("doc_id", "n", "key").join(classes.select("key", "rep"), "key").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return named.unionAll(described.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard 0.9, over all documents."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op8"))
