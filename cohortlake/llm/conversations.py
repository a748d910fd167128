"""Least-cost repair of conversations to the form ``(s?(ua)+)?`` of role initials.

Rows of a conversation are layers of a graph whose nodes are the states of that
form; edits are its arcs. Forward and backward least costs mark the arcs of
optimal repairs (tight arcs), and a walk with the set of all nodes reached so far
takes the least letter at each step, which gives the least audit of all optimal
repairs. Costs relative to their least value take few forms, so each step is a
lookup.

A conversation may be larger than a task. Rows are ranged by conversation, turn,
role and text; a conversation that crosses a border is cut there, each segment
gives its cost from every state to every state, and the chain of segments (a few
numbers each) tells every segment its costs and its set of nodes at the borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after s, after u, after a. Classes of initials: s, u, a, others.
START, END = 0, (0, 3)
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Bytes of a segment, a row counting 100 besides its text.
SEGMENT = 32 << 20

Costs = tuple[float, ...]


def _inserted(v: Iterable[float], back: bool = False) -> Costs:
    """Costs once rows may be put in at this layer."""
    out = list(v)
    for _ in range(3):
        for (x, role), y in NEXT.items():
            if role:
                a, b = (y, x) if back else (x, y)
                out[b] = min(out[b], out[a] + INSERT)
    return tuple(out)


def _arcs(kind: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits that use up a row. Kind 0 can only be
    deleted; others are 1 + 2 * class of initial + 1 if truncated."""
    arcs = [("D", x, x, DELETE) for x in range(4)]
    if kind:
        role, cut = divmod(kind - 1, 2)
        arcs += [("K", x, y, TRUNCATED * cut) for (x, r), y in NEXT.items() if r == role]
        arcs += [("R", x, y, REROLE + TRUNCATED * cut) for (x, r), y in NEXT.items() if r]
    return arcs


def _relative(v: Iterable[float]) -> tuple[Costs, float]:
    v = tuple(v)
    least = min(v)
    return tuple(x - least for x in v), least


@lru_cache(None)
def forward(v: Costs, kind: int) -> tuple[Costs, float]:
    """Costs behind a row from those before it, relative to their least, and that."""
    out = [inf] * 4
    for _, x, y, cost in _arcs(kind):
        out[y] = min(out[y], v[x] + cost)
    return _relative(_inserted(out))


@lru_cache(None)
def _before(v: Costs, kind: int) -> Costs:
    out = [inf] * 4
    for _, x, y, cost in _arcs(kind):
        out[x] = min(out[x], v[y] + cost)
    return _inserted(out, back=True)


def backward(v: Costs, kind: int) -> Costs:
    return _relative(_before(v, kind))[0]


@lru_cache(None)
def step(f: Costs, b: Costs, kind: int, nodes: frozenset[int]) -> tuple[str, frozenset[int]]:
    """The least letters of tight arcs from ``nodes`` to behind a row, and the nodes
    there. ``f``: costs before the row, ``b``: costs to the end from behind it."""
    here = _before(b, kind)
    best = min(x + y for x, y in zip(f, here))
    letters = ""
    while True:
        tight = [(k, y) for k, x, y, cost in _arcs(kind) if x in nodes and f[x] + cost + b[y] == best]
        tight += [("I", y) for (x, role), y in NEXT.items() if role and x in nodes and f[x] + INSERT + here[y] == best]
        letter = min(k for k, _ in tight)
        letters += letter
        nodes = frozenset(y for k, y in tight if k == letter)
        if letter != "I":
            return letters, nodes


@lru_cache(None)
def ending(f: Costs, nodes: frozenset[int]) -> str:
    """The rows put in after the last one; a repair that ends is less than one that goes on."""
    here = _inserted((0, inf, inf, 0), back=True)
    best = min(x + y for x, y in zip(f, here))
    letters = ""
    while not any(f[x] == best for x in nodes & set(END)):
        nodes = frozenset(y for (x, role), y in NEXT.items() if role and x in nodes and f[x] + INSERT + here[y] == best)
        letters += "I"
    return letters


FIRST = _inserted((0, inf, inf, inf))
LAST = _inserted((0, inf, inf, 0), back=True)


def passed(v: Costs, kinds: list[int], copies: list[int]) -> tuple[Costs, float]:
    """Costs behind all rows, relative, and their base. Copies of a row can only be deleted."""
    total = 0.0
    for kind, n in zip(kinds, copies):
        v, base = forward(v, kind)
        total += base + DELETE * n
    return v, total


def walked(f: Costs, b: Costs, nodes: frozenset[int], kinds: list[int]) -> tuple[list[str], frozenset[int], Costs]:
    """Letters for each row between costs ``f`` before all and ``b`` behind all, and the nodes and costs there."""
    behind = [b]
    for kind in reversed(kinds[1:]):
        behind.append(backward(behind[-1], kind))
    out = []
    for kind in kinds:
        letters, nodes = step(f, behind.pop(), kind, nodes)
        out.append(letters)
        f = forward(f, kind)[0]
    return out, nodes, f


def rebuilt(letters: list[str], tail: str, copies: list[int], turns: list, roles: list[str], texts: list[str], before: int, odd: bool) -> tuple[str, list, list[str], list[str]]:
    """(edits, turns, roles, texts) of the repaired rows. With an odd number of
    rows in all the first is a system row; users and assistants take turns after it."""
    edits, out = [], []
    for row, word in enumerate([*letters, tail]):
        for letter in word:
            if letter == "D":
                continue
            due = "assistant" if (before + len(out) + odd) % 2 else "user"
            if letter == "I":
                out.append((None, due, ""))
            else:
                out.append((turns[row], roles[row] if letter == "K" else due, texts[row]))
        edits.append(word + "D" * copies[row] if row < len(copies) else word)
    return "".join(edits), *([r[i] for r in out] for i in range(3))


class Facts:
    """What is counted of consecutive rows; two stretches of a conversation can be joined."""

    NAMES = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail")

    def __init__(self, values: Iterable = (None, None, 0, 0, 0, 0, 0, None, None)):
        self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail = values

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    def add(self, turn: int | None, n: int, fault: int, role: int) -> None:
        same = n - 1  # copies of a row stand beside it: they are duplicates unless blank, and no such pair is legal
        self.join(Facts((turn, turn, int(turn is not None), n if fault == 1 else 0, (n if fault == 2 else same) if fault != 1 else 0, int(fault == 3), same, role, role)))

    def join(self, other: Facts) -> None:
        if other.head is None:
            return
        if self.head is None:
            self.head = other.head
        elif (self.tail, other.head) not in LEGAL:
            self.illegal += 1
        self.tail = other.tail
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def counts(self) -> tuple[int, int, int, int, int]:
        """gaps, blank, duplicate, truncated, illegal."""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def prepared(table: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text, n, fault, kind): equal rows as one with their number,
    faults (1 blank, 2 seen earlier, 3 truncated) and kinds. ``n`` may be 0: such a row
    only says that there is the conversation."""
    n = F.col(copies) if copies else F.lit(1)
    one = table.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), n.cast("long").alias("n"))
    rows = one.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))
    first = rows.where("n > 0").groupBy("conv_id", "role", "text").agg(F.min(order).alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("least.turn").alias("at"), F.lit(True).alias("new"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("at")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    blank, cut = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(F.col("new").isNull(), 2).when(cut, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), role.alias("class"))
    return rows.withColumn("kind", F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * F.col("class") + (F.col("fault") == 3).cast("int")))


@dataclass
class Repair:
    """``whole``: a row for each conversation that no border crosses, with its counts,
    cost and repaired rows; ``chains``: counts and cost of the others; ``pieces``:
    their repaired rows, in segments."""

    whole: DataFrame
    chains: DataFrame
    pieces: DataFrame


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ROWS = "edits string, turns array<long>, roles array<string>, texts array<string>"


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """(conv_id, is the last of its conversation here, rows), each up to ``most`` bytes."""
    rows: list[tuple] = []
    conv, size = None, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault", "kind", "class"))):
            if rows and (row[0] != conv or size > most):
                yield conv, row[0] != conv, rows
                rows, size = [], 0
            conv = row[0]
            rows.append(row)
            size += 100 + len(row[3])
    if rows:
        yield conv, True, rows


def _first_pass(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Solves conversations between a task's first and last; of the others keeps the rows and what they cost."""
    head = next(batches, None)
    if head is None:
        return
    kind = head.schema.field("conv_id").type
    part, slot, held = TaskContext.get().partitionId(), 0, None
    types = [kind, pa.int64(), *[pa.int64()] * 9, pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
    out: list[tuple] = []
    size = 0

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def made(segment: tuple, edge: bool) -> tuple:
        nonlocal slot
        conv, _, rows = segment
        facts, rows = Facts(), [r for r in rows if r[4]]
        for r in rows:
            facts.add(r[1], r[4], r[5], r[7])
        kinds, copies = [r[6] for r in rows], [r[4] - 1 for r in rows]
        turns, roles, texts = ([r[i] for r in rows] for i in (1, 2, 3))
        if edge:
            slot += 1
            costs = []
            for x in range(4):
                v, base = passed(_inserted(0 if y == x else inf for y in range(4)), kinds, copies)
                costs += [base + c for c in v]
            return conv, (part << 32) + slot, *facts.values(), costs, kinds, copies, None, None, turns, roles, texts
        f, base = passed(FIRST, kinds, copies)
        letters, nodes, f = walked(FIRST, LAST, frozenset([START]), kinds)
        tail = ending(f, nodes)
        odd = sum(len(w) - w.count("D") for w in [*letters, tail]) % 2 == 1
        return conv, None, *facts.values(), None, None, None, int(base + min(f[x] for x in END)), *rebuilt(letters, tail, copies, turns, roles, texts, 0, odd)

    edge = True  # the first conversation may have begun in an earlier task, one of several segments goes on
    for segment in _segments(chain([head], batches), most):
        if held is not None:
            out.append(made(held, edge or not held[1]))
            size += 1000 + sum(len(r[3]) for r in held[2])
            edge = not held[1]
            if size > 1 << 22:
                yield batch_of(out)
                out, size = [], 0
        held = segment
    if held is not None:
        out.append(made(held, True))
    if out:
        yield batch_of(out)


def _chained(rows: list) -> list[list]:
    """Segments of one conversation, in order, for each conversation."""
    chains: list[list] = []
    for row in sorted(rows, key=lambda r: r["segment"]):
        if chains and chains[-1][-1]["conv_id"] == row["conv_id"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    return chains


def _through(v: Iterable[float], costs: list[float], back: bool = False) -> Costs:
    """Costs at the other side of a segment."""
    v = tuple(v)
    if back:
        return tuple(min(costs[4 * x + y] + v[y] for y in range(4)) for x in range(4))
    return tuple(min(v[x] + costs[4 * x + y] for x in range(4)) for y in range(4))


def _tight(f: Costs, b: Costs) -> list[frozenset[int]]:
    """All sets of nodes that an optimal repair may hold where costs are ``f`` and ``b``."""
    best = min(x + y for x, y in zip(f, b))
    nodes = [x for x in range(4) if f[x] + b[x] == best]
    return [frozenset(s) for k in range(1, len(nodes) + 1) for s in combinations(nodes, k)]


def repair(table: DataFrame, scratch: Scratch, copies: str | None = None, segment: int = SEGMENT) -> Repair:
    """The cheapest repair of every conversation of ``table`` (conv_id, turn, role, text).

    Edits: K keeps a row, R (3) makes it the user's or the assistant's, D (4)
    deletes it, I (3) puts an empty row of the user or the assistant in. Blank rows
    and rows whose role and text stood earlier must go; truncated rows that stay
    cost 3 more. Of equal costs the edits least in ASCII win.

    Rows stand by turn, nulls first, then by role and text. Null roles and texts
    read as one space; null ids are one conversation; rows that repeat are
    duplicates; an empty role has no initial, so the row can't be kept as it is.
    No rows give no conversations. Other columns are not read. The driver holds
    some hundred bytes for each border of a task and for each ``segment`` bytes of a
    conversation that crosses one, never rows.
    """
    spark = table.sparkSession
    field = table.schema["conv_id"].dataType
    kind, names = field.simpleString(), ["conv_id", "segment", *Facts.NAMES, "costs", "kinds", "copies", "cost", "edits", "turns_of", "roles", "texts"]
    ordered = prepared(table, copies).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, segment long, {', '.join(f'{n} long' for n in Facts.NAMES)}, costs array<double>, kinds array<int>, copies array<long>, cost long, edits string, turns_of array<long>, roles array<string>, texts array<string>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_pass(batches, names, segment)

    solved = scratch.table(ordered.mapInArrow(first, schema))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    whole = solved.where("segment IS NULL").select("conv_id", gaps.alias("gaps"), *_COUNTS[1:], "edits", F.col("turns_of").alias("turns"), "roles", "texts")

    cut = solved.where("segment IS NOT NULL")
    chains = _chained(cut.select("conv_id", "segment", *Facts.NAMES, "costs").collect())  # a few numbers for each border
    starts, ends, counts, plan = {}, {}, [], []
    for i, links in enumerate(chains):
        facts, f, b = Facts(), FIRST, LAST
        for row in links:
            facts.join(Facts([row[n] for n in Facts.NAMES]))
            starts[row["segment"]] = _relative(f)[0]
            f = _through(f, row["costs"])
        for row in reversed(links):
            ends[row["segment"]] = _relative(b)[0]
            b = _through(b, row["costs"], back=True)
        counts.append((i, links[0]["conv_id"], *facts.counts(), int(min(f[x] for x in END))))
        plan += [(i, row["segment"], [*map(float, starts[row["segment"]])], [*map(float, ends[row["segment"]])]) for row in links]
    bounds = spark.createDataFrame(plan, "chain long, segment long, f array<double>, b array<double>")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, f, b, kinds, last in zip(*(batch.column(c).to_pylist() for c in ("segment", "f", "b", "kinds", "last"))):
                f, b, got = tuple(f), tuple(b), []
                here = b
                for k in reversed(kinds):
                    here = backward(here, k)
                for nodes in _tight(f, here):
                    letters, left, v = walked(f, b, nodes, kinds)
                    if last:
                        letters.append(ending(v, left))
                    got.append((sum(1 << x for x in nodes), sum(1 << x for x in left), sum(len(w) - w.count("D") for w in letters)))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(got)), *(pa.array(c, pa.int64()) for c in zip(*got))], ["segment", "nodes", "left", "rows"])

    last = spark.createDataFrame([(links[-1]["segment"], True) for links in chains], "segment long, last boolean")
    known = cut.join(bounds, "segment").join(last, "segment", "left").withColumn("last", F.coalesce("last", F.lit(False)))
    crossing = [row["segment"] for links in chains if len(links) > 1 for row in links]
    some = known.where(F.col("segment").isin(crossing)) if len(crossing) < 1000 else known
    found = {(r["segment"], r["nodes"]): (r["left"], r["rows"]) for r in some.select("segment", "f", "b", "kinds", "last").mapInArrow(ways, "segment long, nodes long, left long, rows long").collect()} if crossing else {}
    entries = []
    for links in chains:
        nodes, before, of = 1 << START, 0, []
        for row in links if len(links) > 1 else []:
            of.append((row["segment"], nodes, before))
            nodes, rows = found[row["segment"], nodes]
            before += rows
        entries += [(*x, before % 2 == 1) for x in of] or [(links[0]["segment"], nodes, 0, None)]
    known = known.join(spark.createDataFrame(entries, "segment long, nodes long, before long, odd boolean"), "segment")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("f", "b", "kinds", "last", "nodes", "before", "odd", "copies", "turns_of", "roles", "texts")
        for batch in batches:
            for at in range(len(batch)):
                f, b, kinds, last, nodes, before, odd, *rest = (batch.column(c)[at].as_py() for c in columns)
                letters, left, v = walked(tuple(f), tuple(b), frozenset(x for x in range(4) if nodes >> x & 1), kinds)
                tail = ending(v, left) if last else ""
                if odd is None:
                    odd = sum(len(w) - w.count("D") for w in [*letters, tail]) % 2 == 1
                made = rebuilt(letters, tail, *rest, before, odd)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, 1) for c in ("conv_id", "chain", "segment")), *(pa.array([x], t) for x, t in zip(made, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))))],
                    ["conv_id", "chain", "segment", "edits", "turns", "roles", "texts"],
                )

    pieces = known.select("conv_id", "chain", "segment", "f", "b", "kinds", "last", "nodes", "before", "odd", "copies", "turns_of", "roles", "texts").mapInArrow(final, f"conv_id {kind}, chain long, segment long, {_ROWS}")
    totals = spark.createDataFrame(counts, f"chain long, conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}")
    return Repair(whole, totals, pieces)


def repaired_rows(done: Repair) -> DataFrame:
    """(conv_id, segment, place, turn, role, text): the repaired rows; those put in have no turn.
    They stand by segment and place."""
    rows = done.whole.select("conv_id", F.lit(0).cast("long").alias("segment"), "turns", "roles", "texts").unionByName(done.pieces.select("conv_id", "segment", "turns", "roles", "texts"))
    each = rows.select("conv_id", "segment", F.posexplode(F.arrays_zip("turns", "roles", "texts")).alias("place", "x"))
    return each.select("conv_id", "segment", "place", F.col("x.turns").alias("turn"), F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


def digests(done: Repair) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256) of every conversation; those in
    segments are hashed as a stream, segment after segment."""
    body = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    whole = done.whole.withColumns({"audit": F.col("edits"), "repaired_sha256": F.sha2(body, 256)}).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, edits, some = None, None, [], False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(["".join(edits)]), pa.array([sha.hexdigest()])], ["chain", "audit", "repaired_sha256"])

        for batch in batches:
            for chain, letters, text in zip(*(batch.column(c).to_pylist() for c in ("chain", "edits", "body"))):
                if chain != now:
                    if sha:
                        yield row()
                    now, sha, edits, some = chain, hashlib.sha256(), [], False
                edits.append(letters)
                if text is not None:
                    sha.update((("\n" if some else "") + text).encode())
                    some = True
        if sha:
            yield row()

    pieces = done.pieces.select("chain", "segment", "edits", F.when(F.size("roles") > 0, body).alias("body"))
    stream = pieces.repartition("chain").sortWithinPartitions("chain", "segment").select("chain", "edits", "body")
    cut = done.chains.join(stream.mapInArrow(run, "chain long, audit string, repaired_sha256 string"), "chain").select(columns)
    return whole.unionByName(cut)


def damaged(table: DataFrame) -> DataFrame:
    """``table`` with rows dropped, emptied, stripped of sentence ends, doubled or made
    the user's, by the crc32 of ``conv_id:turn``; ``copies`` is 0 for what is dropped."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(as_text("text"), ".!?", "")).otherwise(as_text("text"))
    gone = how == 0  # only says that there is the conversation
    return table.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(how == 4, "user").otherwise(as_text("role")).alias("role"), F.when(gone, "").otherwise(text).alias("text"), F.when(gone, 0).when(how == 3, 2).otherwise(1).alias("copies")
    )


def op11(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(repair(rows, Scratch(spark, "op11"), copies="copies"))
