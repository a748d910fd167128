"""A gated recurrent language model over words, scored on whole documents.

Counts of all words of the training fold are exact: blocks of documents send
their distinct words to hash buckets as packed arrays, buckets add them up and
answer each block with the totals of its own words. The model is a gated
recurrent unit in numpy, trained by truncated backpropagation on windows with
state carried across them, in every partition at once from one start, and
averaged; its output softmax is factored into classes. Words outside the model
vocabulary have classes by ending, within which they follow their counts, so
the probabilities of all words and of one unseen word per class sum to one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, chunks, partitions, whole_groups

_U = np.uint64
END = _U(0x5EED0FE4D)
CLASS_WORDS, FREQUENT, RARE, HIDDEN = 64, 32, 32, 24
VOCAB = CLASS_WORDS * FREQUENT
CLASSES = FREQUENT + RARE
START = VOCAB + RARE
#: Rounds of gradient steps, each on its own share of the training texts; together on all.
ROUNDS = 4
WINDOW, LANES, RATE = 20, 256, 0.02
SCORE_WINDOW, SCORE_LANES = 64, 256
#: Rows whose softmax is taken at once.
ROWS = 512
#: Numbers of a parameter that a step works on at once.
BLOCK = 1 << 13
BLOCK_BYTES = 24 << 20
#: Copies of a parameter that one task adds up.
FAN = 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and rare class of every token (an end after each text) and each text's first token."""
    data = W.LOWER[data]
    starts, ends, first = W.split(data, offsets, W.NOT_SPACE)
    hashes = W.span_hashes(W.prefix_sums(data), starts, ends)
    last = data[ends - 1].astype(np.int64)
    tail = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    kind = ((last * 131 + tail * 31) % RARE).astype(np.uint8)
    n = np.diff(first)
    to = np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)
    all_, kinds = np.full(len(hashes) + len(n), END, _U), np.zeros(len(hashes) + len(n), np.uint8)
    all_[to], kinds[to] = hashes, kind
    return all_, kinds, first + np.arange(len(first))


@dataclass
class Counts:
    """Of the training fold: tokens, distinct tokens, the model vocabulary and the rare classes' weights."""

    total: int
    distinct: int
    vocab: np.ndarray = field(repr=False)  # sorted hashes
    slot: np.ndarray = field(repr=False)  # model word of each
    seen: np.ndarray = field(repr=False)  # its count, by model word
    rare: np.ndarray = field(repr=False)  # sum of (count + 1) by rare class, and one more for the unseen


class Places:
    """Where hashes stand among sorted distinct ones: found by their first bits, then
    one by one, of which there are few, as hashes are spread evenly."""

    def __init__(self, among: np.ndarray):
        bits = (4 * len(among) + 255).bit_length()
        self.among, self.shift = among, _U(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((among >> self.shift).view(np.int64), minlength=1 << bits), out=self.first[1:])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is not there."""
        lead = (hashes >> self.shift).view(np.int64)
        at = np.full(len(hashes), -1, np.int64)
        left = np.flatnonzero(self.first[lead] < self.first[1:][lead])
        place, end = self.first[lead[left]], self.first[1:][lead[left]]
        while len(left):
            same = self.among[place] == hashes[left]
            at[left[same]] = place[same]
            more = ~same & (place + 1 < end)
            left, place, end = left[more], place[more] + 1, end[more]
        return at


def model_words(counts: Counts, hashes: np.ndarray) -> np.ndarray:
    """Model word of each hash, -1 for rare ones."""
    at = Places(counts.vocab).of(hashes)
    return np.append(counts.slot, -1)[at]


class Network:
    """Parameters by name, and the unit's steps."""

    NAMES = ("embed", "wx", "uh", "un", "b", "wc", "bc", "wo", "bo")

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, counts: Counts) -> Network:
        """Small random weights; the output biases give the words' shares."""
        rng = np.random.default_rng(5)
        h = HIDDEN
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        share = np.concatenate([counts.seen.reshape(FREQUENT, CLASS_WORDS).sum(1) + 1e-3, counts.rare])
        inside = np.log(counts.seen.reshape(FREQUENT, CLASS_WORDS) + 0.01)
        return cls({"embed": draw(START + 1, h), "wx": draw(h, 3 * h), "uh": draw(h, 2 * h), "un": draw(h, h), "b": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]).astype(np.float32), "wc": draw(h, CLASSES) * 0.1, "bc": np.log(share / share.sum()).astype(np.float32), "wo": draw(FREQUENT, h, CLASS_WORDS) * 0.1, "bo": (inside - np.log(np.exp(inside).sum(1, keepdims=True))).astype(np.float32)})

    def gated(self) -> tuple[np.ndarray, ...]:
        """Weights of the input and of the state, and bias, as the steps take them: by
        unit, those of the two gates negated, so that a gate is 1 / (1 + exp(.))."""
        sign = np.ones((3 * HIDDEN, 1), self.p["b"].dtype)
        sign[: 2 * HIDDEN] = -1
        return self.p["wx"].T * sign, -self.p["uh"].T, np.ascontiguousarray(self.p["un"].T), self.p["b"][:, None] * sign

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of each class's words, the bias as a last row."""
        return np.concatenate([self.p["wc"], self.p["bc"][None]]), np.concatenate([self.p["wo"], self.p["bo"][:, None]], 1)

    def log_probs(self, h: np.ndarray, kind: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Natural log of P(class | h), times P(word | class, h) for model words (inside >= 0).
        Rows go in blocks, by class, through one small array."""
        classes, within = self.outputs()
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        kind, inside = kind[order], inside[order]
        rows = np.ones((len(h), HIDDEN + 1), classes.dtype)
        np.take(h, order, axis=0, out=rows[:, :HIDDEN], mode="clip")
        wide, one = np.empty((ROWS, max(CLASSES, CLASS_WORDS)), classes.dtype), np.ones(max(CLASSES, CLASS_WORDS), classes.dtype)
        least, at = max(1.0, float(np.abs(rows).max(initial=0))), np.arange(ROWS)
        plain = bounded(classes, least), bounded(within, least)
        true, sums = np.empty(len(h), classes.dtype), np.empty(len(h), classes.dtype)

        def of_true(lo: int, hi: int, weights: np.ndarray, truth: np.ndarray, plain: bool) -> None:
            logits = np.matmul(rows[lo:hi], weights, out=wide[: hi - lo, : weights.shape[1]])
            if not plain:
                logits -= logits.max(1, keepdims=True)
            true[lo:hi] = logits[at[: hi - lo], truth[lo:hi]]
            np.exp(logits, out=logits)
            np.matmul(logits, one[: weights.shape[1]], out=sums[lo:hi])

        for lo in range(0, len(h), ROWS):
            of_true(lo, min(lo + ROWS, len(h)), classes, kind, plain[0])
        out = np.empty_like(true)
        out[order] = true - np.log(sums)
        cut = np.searchsorted(kind, np.arange(FREQUENT + 1)).tolist()
        for c in range(FREQUENT):
            for lo in range(cut[c], cut[c + 1], ROWS):
                of_true(lo, min(lo + ROWS, cut[c + 1]), within[c], inside, plain[1])
        out[order[: cut[-1]]] += (true - np.log(sums))[: cut[-1]]
        return out


def bounded(weights: np.ndarray, least: float = 1.0) -> bool:
    """Whether no logit of rows within ``least`` can leave the range of exp, so that the
    softmax needs no row's maximum."""
    return float(np.abs(weights).sum(-2).max()) * least < 60


class Recurrence:
    """The unit's steps over windows: arrays lie by step, unit and lane, so that what a
    step works on is of one piece. Work arrays last: fresh memory for each window would
    cost more than the arithmetic."""

    def __init__(self, net: Network):
        self.net, self.work = net, {}

    def take(self, name: str, *shape: int) -> np.ndarray:
        """A work array by name; its contents are left from the last use."""
        size = math.prod(shape)
        if name not in self.work or len(self.work[name]) < size:
            self.work[name] = np.empty(size, self.net.p["embed"].dtype)
        return self.work[name][:size].reshape(shape)

    def forward(self, source: np.ndarray, start: np.ndarray, h: np.ndarray, weights: tuple[np.ndarray, ...]) -> np.ndarray:
        """States after each step (step, unit, lane) from the one carried in (unit, lane).
        Leaves the inputs, the gates, the candidates and what these take of the state in ``work``.
        source: input id by step and lane; start: where a text begins; weights: ``gated``."""
        (steps, width), k = source.shape, HIDDEN
        wx, uh, un, b = weights
        x = np.take(self.net.p["embed"], source.ravel(), axis=0, out=self.take("x", steps * width, k), mode="clip")
        gates = np.matmul(wx, x.reshape(steps, width, k).transpose(0, 2, 1), out=self.take("gates", steps, 3 * k, width))
        gates += b
        rh, after = (self.take(n, steps, k, width) for n in ("rh", "after"))
        two, one, unit = self.take("two", 2 * k, width), self.take("one", k, width), np.ones((), gates.dtype)
        begins, old = start.any(1).tolist(), h
        # few and cheap calls: beside a long text most steps have few lanes
        for t, (g, z, r, n, x_r, new) in enumerate(zip(gates[:, : 2 * k], gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], rh, after)):
            if begins[t]:
                old = old * ~start[t]
            np.add(g, np.dot(uh, old, out=two), out=g)
            np.exp(g, out=g)
            np.add(g, unit, out=g)
            np.reciprocal(g, out=g)
            np.multiply(r, old, out=x_r)
            np.add(n, np.dot(un, x_r, out=one), out=n)
            np.tanh(n, out=n)
            np.subtract(n, old, out=new)
            np.multiply(new, z, out=new)
            np.add(new, old, out=new)
            old = new
        return after


def lanes(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts dealt to at most ``width`` lanes of even length: a matrix of token
    indices by step and lane (-1 past a lane's end), longest lane first, and
    where a text starts."""
    sizes = np.diff(first)
    width = max(1, min(width, len(sizes)))
    heap = [(0, i) for i in range(width)]
    given: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        given[i].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), i))
    given.sort(key=lambda g: -int(sizes[g].sum()) if g else 0)
    steps = int(sizes[given[0]].sum()) if given[0] else 0
    index, begins = np.full((steps, width), -1, np.int64), np.zeros((steps, width), bool)
    for i, g in enumerate(given):
        if g:
            index[: int(sizes[g].sum()), i] = np.concatenate([np.arange(first[d], first[d + 1]) for d in g])
            begins[np.cumsum(sizes[g]) - sizes[g], i] = True
    return index, begins


def even_lanes(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``lanes``, for training: the texts stand one after another and are cut
    into lanes of equal length, so that a very long text leaves no narrow
    windows behind. A text cut by a lane's end goes on in the next lane, from
    its last word and an empty state."""
    total = int(first[-1])
    width = max(1, min(width, total // (4 * WINDOW)))
    steps = -(-total // width)
    index = np.arange(steps * width)
    begins = np.zeros(steps * width, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    index[total:] = -1
    return index.reshape(width, steps).T, begins.reshape(width, steps).T


def encoded(counts: Counts, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input id, class and place within the class (-1: rare) of each token."""
    word = model_words(counts, hashes)
    known = word >= 0
    kinds = kinds.astype(np.int64)
    return np.where(known, word, VOCAB + kinds), np.where(known, word // CLASS_WORDS, FREQUENT + kinds), np.where(known, word % CLASS_WORDS, -1)


class Learner(Recurrence):
    """Gradients and steps of one task. Its moments last as long as the task learns."""

    def __init__(self, net: Network):
        super().__init__(net)
        self.turn = 0
        self.moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}
        self.grad = {n: np.zeros_like(v) for n, v in net.p.items()}

    def shares_less_one(self, logits: np.ndarray, truth: np.ndarray, plain: bool) -> np.ndarray:
        """In place: the softmax of each row, less one at its true place."""
        if not plain:
            logits -= logits.max(1, keepdims=True)  # rows may be none, columns never
        np.exp(logits, out=logits)
        logits *= (1 / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
        logits[np.arange(len(logits)), truth] -= 1
        return logits

    def gradients(self, ids: np.ndarray, kind: np.ndarray, inside: np.ndarray, at: np.ndarray, start: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Puts the gradients of one window's summed loss into ``grad``; returns the state after it.

        at: token indices by step and lane, -1 past a lane's end (such places
        take no part in the loss); start: where a text begins; h: the state
        carried in by lane, through which no gradient flows. What depends on
        the inputs alone is done for the window at once, the steps do the rest.
        """
        p, grad, k = self.net.p, self.grad, HIDDEN
        steps, width = at.shape
        size = steps * width
        source = np.where(start, START, ids[np.maximum(at - 1, 0)])
        after = self.forward(source, start, h.T, self.net.gated())
        x, gates, rh = self.take("x", steps, width, k), self.take("gates", steps, 3 * k, width), self.take("rh", steps, k, width)
        before = self.take("before", steps, k, width)
        before[0], before[1:] = h.T, after[:-1]
        before *= ~start[:, None]

        flat = at.ravel()
        live = np.flatnonzero(flat >= 0)
        order = live[np.argsort(kind[flat[live]].astype(np.uint8), kind="stable")]  # by class
        flat = flat[order]
        truth = kind[flat]
        by_lane = self.take("by_lane", steps, width, k)
        by_lane[:] = after.transpose(0, 2, 1)
        states = self.take("states", len(order), k + 1)  # and one, for the bias
        states[:, :k] = np.take(by_lane.reshape(size, k), order, axis=0, out=self.take("ordered", len(order), k), mode="clip")
        states[:, k] = 1
        classes, within = self.net.outputs()
        e = np.matmul(states, classes, out=self.take("e", len(order), CLASSES))
        e = self.shares_less_one(e, truth, bounded(classes))
        both = states.T @ e
        grad["wc"][:], grad["bc"][:] = both[:k], both[k]
        ds = np.matmul(e, p["wc"].T, out=self.take("ds", len(order), k))
        cut = np.searchsorted(truth, np.arange(FREQUENT + 1)).tolist()
        some = [(c, lo, hi) for c, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if lo < hi]
        q = self.take("q", cut[-1], CLASS_WORDS)
        for c, lo, hi in some:
            np.matmul(states[lo:hi], within[c], out=q[lo:hi])
        q = self.shares_less_one(q, inside[flat[: cut[-1]]], bounded(within))
        grad["wo"][:], grad["bo"][:] = 0, 0
        low = self.take("low", cut[-1], k)
        for c, lo, hi in some:
            both = states[lo:hi].T @ q[lo:hi]
            grad["wo"][c], grad["bo"][c] = both[:k], both[k]
            np.matmul(q[lo:hi], p["wo"][c].T, out=low[lo:hi])
        ds[: cut[-1]] += low
        if len(order) < size:
            by_lane[:] = 0
        by_lane.reshape(size, k)[order] = ds
        dh_all = self.take("dh", steps, k, width)
        dh_all[:] = by_lane.transpose(0, 2, 1)

        z, r, n = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
        dg = self.take("dg", steps, 3 * k, width)
        dz, dr, dn = dg[:, :k], dg[:, k : 2 * k], dg[:, 2 * k :]
        less = np.subtract(1, z, out=self.take("less", steps, k, width))
        np.subtract(n, before, out=dz)
        dz *= less
        dz *= z
        np.subtract(1, r, out=dr)
        dr *= rh
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= z
        uh, un = p["uh"], p["un"]
        dh_next, one = np.zeros((k, width), h.dtype), self.take("one", k, width)
        begins = start.any(1).tolist()
        for t in range(steps - 1, -1, -1):
            dh, g = dh_all[t], dg[t]
            dh += dh_next
            g[2 * k :] *= dh
            g[:k] *= dh
            np.matmul(un, g[2 * k :], out=one)
            g[k : 2 * k] *= one
            np.matmul(uh, g[: 2 * k], out=dh_next)
            one *= gates[t, k : 2 * k]
            dh_next += one
            dh *= less[t]
            dh_next += dh
            if begins[t]:
                dh_next *= ~start[t]
        over = lambda a, b: np.matmul(a, b.transpose(0, 2, 1)).sum(0)
        grad["un"][:] = over(rh, dn)
        grad["uh"][:] = over(before, dg[:, : 2 * k])
        grad["wx"][:] = np.matmul(dg, x).sum(0).T
        grad["b"][:] = dg.sum((0, 2))
        np.matmul(dg.transpose(0, 2, 1), p["wx"].T, out=by_lane)
        by = np.argsort(source.astype(np.uint16).ravel(), kind="stable")
        source = source.ravel()[by]
        run = np.flatnonzero(np.diff(source, prepend=-1))
        grad["embed"][:] = 0
        dx = np.take(by_lane.reshape(size, k), by, axis=0, out=self.take("sorted", size, k), mode="clip")
        grad["embed"][source[run]] = np.add.reduceat(dx, run)
        return after[-1].T.copy()

    def step(self, count: int) -> None:
        """One step of Adam along the mean gradient, cut to unit length, in blocks that
        stay near. Moments too small to matter are zeroed: denormal numbers are very slow."""
        self.turn += 1
        size = float(np.sqrt(sum(float(np.vdot(g, g)) for g in self.grad.values()))) / count
        scale = min(1.0, 1.0 / max(size, 1e-9)) / count
        left = math.sqrt(1 - 0.99**self.turn)
        rate = RATE / (1 - 0.9**self.turn) * left
        part = self.take("part", BLOCK)
        for name, all_g in self.grad.items():
            whole = [v.reshape(-1) for v in (all_g, *self.moments[name], self.net.p[name])]
            for lo in range(0, len(whole[0]), BLOCK):
                g, one, two, value = (v[lo : lo + BLOCK] for v in whole)
                a = np.multiply(g, 0.1 * scale, out=part[: len(g)])
                one *= 0.9
                one += a
                a *= a  # a hundredth of the gradient's square
                two *= 0.99
                two += a
                if self.turn % 64 == 0:
                    one[np.abs(one) < 1e-20] = 0
                    two[two < 1e-30] = 0
                np.sqrt(two, out=a)
                a += 1e-6 * left
                np.divide(one, a, out=a)
                a *= rate
                value -= a

    def train(self, ids: np.ndarray, kind: np.ndarray, inside: np.ndarray, first: np.ndarray) -> int:
        """Truncated backpropagation over all windows of the texts; returns the tokens used."""
        index, begins = even_lanes(first, LANES)
        h, used = np.zeros((index.shape[1], HIDDEN), self.net.p["embed"].dtype), 0
        for t0 in range(0, len(index), WINDOW):
            at = index[t0 : t0 + WINDOW]
            width = int((at[0] >= 0).sum())  # full lanes come first
            if not width:
                break
            h = self.gradients(ids, kind, inside, at[:, :width], begins[t0 : t0 + WINDOW, :width], h[:width])
            count = int((at >= 0).sum())
            self.step(count)
            used += count
        return used


def score(net: Network, ids: np.ndarray, kind: np.ndarray, inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each token (of a rare word: of its class), state carried over whole texts."""
    out = np.zeros(len(ids), np.float64)
    index, begins = lanes(first, SCORE_LANES)
    unit, weights = Recurrence(net), net.gated()
    h = np.zeros((HIDDEN, index.shape[1]), net.p["embed"].dtype)
    for t0 in range(0, len(index), SCORE_WINDOW):
        width = int((index[t0] >= 0).sum())  # the longest lanes come first
        at, start = index[t0 : t0 + SCORE_WINDOW, :width], begins[t0 : t0 + SCORE_WINDOW, :width]
        after = unit.forward(np.where(start, START, ids[np.maximum(at - 1, 0)]), start, h[:, :width], weights)
        h = after[-1].copy()
        live = at >= 0
        flat = at[live]
        out[flat] = net.log_probs(after.transpose(0, 2, 1)[live], kind[flat], inside[flat])
    return out


def held_out(of: str = "doc_id") -> Column:
    """crc32(id as text) mod 7 is 2; a null id is held out."""
    return F.coalesce(F.crc32(F.col(of).cast("string").cast("binary")) % 7 == 2, F.lit(True))


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))
    mark = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.crc32(F.col("text").cast("binary"))), F.lit(n)).cast("int")
    return docs.select("doc_id", "text", held_out().alias("held_out"), mark.alias("block")), n


def block_counts(blocked: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, Counts]:
    """(block, hashes, counts): each block's distinct words and their training counts, and the totals."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def folded(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            h, c, kind = (np.concatenate([x[i] for x in parts]) for i in range(3))
            u, at, inv = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(inv, c, len(u)).astype(np.int64), kind[at]

        for rows, data, offsets in chunks(batches, "text"):
            hashes, kinds, first = tokens(data, offsets)
            block, train_ = rows.column("block").to_numpy(), ~rows.column("held_out").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(rows)), np.diff(first))
            for b in np.unique(block):
                mine = (block == b)[row] if len(rows) > 1 else slice(None)
                h, t = hashes[mine], train_[row[mine]]
                held.setdefault(int(b), []).append(folded([(h, t.astype(np.int64), kinds[mine])]))
                if len(held[int(b)]) > 12:
                    held[int(b)] = [folded(held[int(b)])]
        for b, parts in held.items():
            h, c, kind = folded(parts)
            bucket = (h >> _U(40)) % _U(n)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(n + 1))
            h, c, kind = h[order], c[order], kind[order]
            some = [i for i in range(n) if cut[i + 1] > cut[i]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([b] * len(some), pa.int32()), *(pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()) for x in (h, c, kind))], ["bucket", "block", "hashes", "counts", "kinds"])

    sent = blocked.repartition(n, "block").mapInArrow(gather, "bucket int, block int, hashes binary, counts binary, kinds binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64()), ("rare", pa.list_(pa.float64()))])
        for table in whole_groups(batches, "bucket"):
            buckets = table.column("bucket").to_numpy()
            for b in np.unique(buckets):
                part = table.filter(pa.array(buckets == b)).combine_chunks()
                h = [np.frombuffer(x.as_buffer(), _U) for x in part.column("hashes")]
                c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part.column("counts")])
                kind = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column("kinds")])
                u, at, inv = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
                sums = np.bincount(inv, c, len(u)).astype(np.int64)
                cut = np.concatenate([[0], np.cumsum([len(x) for x in h])])
                answers = sums[inv].astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column("block").combine_chunks(), pa.array([x.tobytes() for x in h], pa.binary()), pa.array([answers[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([None] * len(h), pa.int64()), pa.array([None] * len(h), pa.int64()), pa.array([None] * len(h), pa.list_(pa.float64()))], schema=schema)
                known = sums > 0
                top = np.argsort(-sums, kind="stable")[:VOCAB]
                top = top[sums[top] > 0]
                weight = np.bincount(kind[at][known], sums[known] + 1, RARE)
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([u[top].tobytes()], pa.binary()), pa.array([np.stack([sums[top], kind[at][top].astype(np.int64)]).tobytes()], pa.binary()), pa.array([int(sums.sum())]), pa.array([int(known.sum())]), pa.array([weight.tolist()], pa.list_(pa.float64()))], schema=schema)

    answered = scratch.table(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "block int, hashes binary, counts binary, total long, distinct long, rare array<double>"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x in zip(batch.column("hashes"), batch.column("counts")):
                top = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_buffer(), _U).view(np.int64)), pa.array(top[0]), pa.array(top[1])], ["h", "n", "kind"])

    heads = answered.where("block = -1")
    sums = heads.agg(F.sum("total"), F.sum("distinct"), *[F.sum(F.col("rare")[i]) for i in range(RARE)]).first()
    best = heads.select("hashes", "counts").mapInArrow(spread, "h long, n long, kind long").orderBy(F.desc("n"), "h").limit(VOCAB).collect()
    hashes = np.array([r[0] for r in best], np.int64).view(_U)
    seen = np.zeros(VOCAB, np.int64)
    seen[: len(best)] = [r[1] for r in best]
    rare = np.array([x or 0 for x in sums[2:]], float) + 1
    for r in best:
        rare[r[2]] -= r[1] + 1
    order = np.argsort(hashes)
    return answered.where("block >= 0").select("block", "hashes", "counts"), Counts(int(sums[0] or 0), int(sums[1] or 0), hashes[order], order.astype(np.int64), seen, rare)


def shares(blocked: DataFrame) -> list[DataFrame]:
    """The texts of each round: every training text is in exactly one."""
    mark = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(ROUNDS))
    return [blocked.where(~F.col("held_out") & (mark == turn)).select("text") for turn in range(ROUNDS)]


def fit(blocked: DataFrame, counts: Counts) -> Network:
    """Rounds of local training in every partition, each on its own share of the
    training texts (together: all), averaged over the tokens used in a tree of
    partial sums. The model so depends on how texts lie in partitions, within
    what different orders of the same gradient steps make."""
    net = Network.start(counts)
    for share in shares(blocked):
        begun = net.p

        def learn(batches: Iterator[pa.RecordBatch], begun: dict[str, np.ndarray] = begun) -> Iterator[pa.RecordBatch]:
            local, used = Network({n: v.copy() for n, v in begun.items()}), 0
            learner = Learner(local)
            for _, data, offsets in chunks(batches, "text", 3 << 20):
                hashes, kinds, first = tokens(data, offsets)
                used += learner.train(*encoded(counts, hashes, kinds), first)
            if used:
                place, k = TaskContext.get().partitionId(), len(Network.NAMES)
                yield pa.RecordBatch.from_arrays([pa.array([place] * k, pa.int64()), pa.array(list(Network.NAMES)), pa.array([used] * k, pa.int64()), pa.array([(local.p[n].astype(np.float64) * used).tobytes() for n in Network.NAMES], pa.binary())], ["place", "name", "used", "values"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One sum for each place and parameter."""
            sums: dict[tuple[int, str], list] = {}
            for batch in batches:
                for place, name, used, values in zip(*(batch.column(c).to_pylist() for c in ("place", "name", "used")), batch.column("values")):
                    one = sums.setdefault((place, name), [0, 0.0])
                    one[0] += used
                    one[1] = one[1] + np.frombuffer(values.as_buffer(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.string()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["place", "name", "used", "values"])

        kinds = "place long, name string, used long, values binary"
        got: dict[str, list] = {}
        sums, width = share.mapInArrow(learn, kinds), share.rdd.getNumPartitions()
        while width > 1:  # a tree: no task adds up more than ``FAN`` copies of a parameter
            width = -(-width // FAN)
            sums = sums.withColumn("place", F.floor(F.col("place") / FAN)).repartition(min(width * len(Network.NAMES), partitions(share.sparkSession)), "place", "name").mapInArrow(add, kinds)
        for _, name, used, values in sums.collect():  # one sum for each parameter
            one = got.setdefault(name, [0, 0.0])
            one[0] += used
            one[1] = one[1] + np.frombuffer(values, np.float64)
        if got:
            net = Network({n: (s[1] / s[0]).reshape(begun[n].shape).astype(np.float32) for n, s in got.items()})
    return net


def score_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs`` (doc_id, text).

    Rows with a null id are scored but never learned from; a null text is
    empty and has its end alone; without training tokens every score is that
    of one unseen token. Word identity is a 64-bit hash.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocked, n = _blocks(docs.select("doc_id", "text"))
    words, counts = block_counts(blocked, n, scratch)
    net = fit(blocked, counts)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.concatenate([np.zeros(0, _U), *(np.frombuffer(x.as_buffer(), _U) for x in right.column("hashes"))])
        c = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x.as_buffer(), np.uint32) for x in right.column("counts"))])
        order = np.argsort(h)
        h, c = h[order], c[order].astype(np.float64)
        floor = np.log10(counts.total + counts.distinct + 1.0)
        base_of = np.log10(c + 1) - floor
        word_of, places = model_words(counts, h), Places(h)
        rare_log = np.log10(counts.rare)
        known, base, model, sizes = [], [], [], []
        for _, data, offsets in chunks(iter(left.combine_chunks().to_batches()), "text", 6 << 20):
            hashes, kinds, first = tokens(data, offsets)
            at = places.of(hashes)
            word = word_of[at]
            is_known = word >= 0
            kinds = kinds.astype(np.int64)
            ids = np.where(is_known, word, VOCAB + kinds)
            group = np.where(is_known, word // CLASS_WORDS, FREQUENT + kinds)
            logs = score(net, ids, group, np.where(is_known, word % CLASS_WORDS, -1), first) / np.log(10)
            logs += np.where(is_known, 0, np.log10(c[at] + 1) - rare_log[kinds])
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            sizes.append(np.diff(first))
            known.append(np.bincount(row, c[at] > 0, len(first) - 1).astype(np.int64))
            base.append(np.bincount(row, base_of[at], len(first) - 1))
            model.append(np.bincount(row, logs, len(first) - 1))
        return pa.table([left.column("doc_id"), left.column("held_out"), *(pa.array(np.concatenate(x)) for x in (sizes, known)), pa.array(np.full(len(left), counts.total)), *(pa.array(np.concatenate(x)) for x in (base, model))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = blocked.groupBy("block").cogroup(words.groupBy("block"))
    return both.applyInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents, learned from those outside the held-out fold."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op5"))
