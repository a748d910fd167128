"""How far the sources of a language differ in their use of words, exactly.

With integer rates p (of a group) and q (of another), a term adds
``f = floor((p - q)**2 / q)``. For two groups A and B of a language with V kept
terms, let a and b be the rates of a term that neither holds. Then

    sum f(pA, pB) = V f(a, b)
                  + sum over A's terms of f(pA, b) - f(a, b)
                  + sum over B's terms of f(a, pB) - f(a, b)
                  + sum over common terms of f(pA, pB) - f(pA, b) - f(a, pB) + f(a, b)

The first three parts need only each group's histogram of rates. The last one
is split by weight: terms of many groups form dense numpy tiles (terms by
groups), terms of few groups are posting lists whose pairs are corrected one by
one. All parts are integers and are added by Spark, so the split changes no bit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, chunks, whole_groups

#: A term: letters of ASCII, lower-cased, and every byte of a longer character.
TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
#: Entries that a task gathers before it adds them up, entries of a batch it hands on; bytes of text split at once.
ENTRIES, ROWS, SLICE = 1 << 20, 1 << 16, 1 << 20
_LAST = 0xFFFFFFFF
#: Terms, and entries of (place of the term, group, occurrences, documents).
Part = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Terms in at most so many groups are corrected pair by pair; groups and terms of a tile.
LIGHT, GROUPS, TERMS = 8, 128, 2048


def _words(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, a slice at a time; a slice ends where no term can be cut."""
    text, start = text.translate(_LOWER), 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE)
        end = gap.start() if gap else len(text)
        yield TERM.findall(text, start, end)
        start = end


def _counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Part:
    """Entries of some texts: for each term and group, its occurrences and the texts that hold it."""
    if len(data) > SLICE:  # one long text
        n: Counter = Counter()
        for words in _words(data.tobytes()):
            n.update(words)
        return pa.array(list(n), pa.binary()), np.arange(len(n)), np.repeat(group, len(n)), np.fromiter(n.values(), np.int64, len(n)), np.ones(len(n), np.int64)
    data = W.LOWER[data]
    starts, ends, first = W.split(data, offsets, W.LETTER)
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[W.LETTER[data]])]).dictionary_encode()
    row = np.repeat(np.arange(len(group)), np.diff(first))
    held, n = np.unique((row << 32) + terms.indices.to_numpy(), return_counts=True)
    key, n, docs = _summed(((held & _LAST) << 32) + group[held >> 32], n, np.ones(len(held), np.int64))
    return terms.dictionary, key >> 32, key & _LAST, n, docs


def _summed(keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    if not len(first):
        return keys, n, docs
    return keys[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)


def _merged(parts: list[Part]) -> Part:
    """The parts' entries, equal ones added up, by term and group."""
    terms = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    at = terms.indices.to_numpy()
    ids = np.concatenate([at[p[1] + b] for p, b in zip(parts, base)]).astype(np.int64)
    group, n, docs = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
    key, n, docs = _summed((ids << 32) + group, n, docs)
    return terms.dictionary, key >> 32, key & _LAST, n, docs


def _by_term(part: Part, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, uses) of a part; names: the groups."""
    terms, ids, group, n, docs = part
    langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in names}))}
    key = (ids << 32) + np.array([langs[lang] for lang, _ in names], np.int64)[group]
    order = np.argsort(key, kind="stable")
    lang_names, source_names = pa.array(list(langs), pa.string()), pa.array([source for _, source in names], pa.string())
    for lo in range(0, len(order), ROWS):  # a term with more groups goes on in the next batch
        at = order[lo : lo + ROWS]
        mine = key[at]
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        uses = pa.StructArray.from_arrays([source_names.take(pa.array(group[at])), pa.array(n[at]), pa.array(docs[at])], ["source", "n", "docs"])
        uses = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), uses)
        yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(mine[first] & _LAST)), terms.take(pa.array(mine[first] >> 32)).cast(pa.string()), uses], ["lang", "term", "uses"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, uses): partial counts of each term by source and of the documents
    that hold it, to be added up. Null text, lang and source read as ''. Every
    group also gives the empty term with zeros, so that groups without terms are seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        parts: list[Part] = []
        for rows, data, offsets in chunks(batches, "text", SLICE):
            known, names = len(groups), zip(*(rows.column(c).fill_null("").to_pylist() for c in ("lang", "source")))
            parts.append(_counted(data, offsets, np.array([groups.setdefault(name, len(groups)) for name in names], np.int64)))
            if len(groups) > known:
                none = np.zeros(len(groups) - known, np.int64)
                parts.append((pa.array([b""], pa.binary()), none, np.arange(known, len(groups)), none, none))
            if sum(len(p[1]) for p in parts) > ENTRIES:
                parts = [_merged(parts)]
                if len(parts[0][1]) > ENTRIES // 2:
                    yield from _by_term(parts.pop(), list(groups))
        if parts:
            yield from _by_term(_merged(parts), list(groups))

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, term string, uses array<struct<source: string, n: long, docs: long>>")


def rate(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) for 0 <= count <= total < 9 * 10**15, in whole numbers:
    three digits at a time, so that no product leaves 64 bits."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return F.lit(1) + out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _sums(lang: list[str], a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])


_SUMS = "lang string, a long, b long, value long"


def _by_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts that need no common term: each group against all others of its language."""
    for batch in batches:
        for row in range(len(batch)):
            lang, me, v, mine = (batch.column(c)[row].as_py() for c in ("lang", "gid", "v", "absent"))
            p, m = (batch.column(c)[row].values.to_numpy() for c in ("rates", "terms"))
            others, theirs = (batch.column(c)[row].values.to_numpy() for c in ("gids", "absents"))
            keep = others != me
            others, theirs = others[keep], theirs[keep]
            if not len(others):
                continue
            both, back = excess(mine, theirs), excess(theirs, mine)
            to, fro = v * both - m.sum() * both, -m.sum() * back
            step = max(1, (1 << 20) // max(1, len(others)))
            for i in range(0, len(p), step):
                x, k = p[i : i + step, None], m[i : i + step, None]
                to = to + (excess(x, theirs) * k).sum(0)
                fro = fro + (excess(theirs, x) * k).sum(0)
            yield _sums([lang] * len(others), np.full(len(others), me), others, to)
            yield _sums([lang] * len(others), others, np.full(len(others), me), fro)


def _add(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of 64-bit values by key, exactly."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each short posting list, added up per batch."""
    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        size = batch.column("gids").value_lengths().to_numpy()
        first = np.cumsum(size) - size
        gid, p, absent = (batch.column(c).flatten().to_numpy() for c in ("gids", "rates", "absents"))
        for lang in set(langs.tolist()):
            keys, values = [], []
            for g in range(2, int(size.max(initial=0)) + 1):
                at = first[(langs == lang) & (size == g)]
                for i in range(g if len(at) else 0):
                    for j in range(g):
                        if i != j:
                            x, y = at + i, at + j
                            keys.append((gid[x] << 32) + gid[y])
                            values.append(excess(p[x], p[y]) - excess(p[x], absent[y]) - excess(absent[x], p[y]) + excess(absent[x], absent[y]))
            if keys:
                key, value = _add(np.concatenate(keys), np.concatenate(values))
                yield _sums([lang] * len(key), key >> 32, key & 0xFFFFFFFF, value)


def _tile(lang: str, low: int, high: int, rows: pa.Table) -> pa.RecordBatch:
    """All pairs of the groups of a tile, over its terms: dense, with the rate of absence where a group lacks a term."""
    groups, g = np.unique(rows.column("gid").to_numpy(), return_inverse=True)
    _, t = np.unique(rows.column("term").to_numpy(zero_copy_only=False), return_inverse=True)
    absent = np.empty(len(groups), np.int64)
    absent[g] = rows.column("absent").to_numpy()
    dense = np.repeat(absent[:, None], t.max() + 1, 1)
    dense[g, t] = rows.column("p").to_numpy()
    block = groups // GROUPS
    keys, values = [], []
    for j in range(len(groups)):
        # a tile of two blocks of groups compares them with each other, one of a single block within itself
        i = np.flatnonzero((block == (low if block[j] == high else high)) & (np.arange(len(groups)) != j))
        if len(i):
            q, b, a = dense[j], absent[j], absent[i]
            values.append((excess(dense[i], q) - excess(dense[i], b) - excess(a[:, None], q) + excess(a, b)[:, None]).sum(1))
            keys.append((groups[i] << 32) + groups[j])
    key, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, values))
    return _sums([lang] * len(key), key >> 32, key & 0xFFFFFFFF, value)


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, "lang", "terms", "low", "high"):
        table = table.combine_chunks()
        columns = [table.column(k).to_numpy(zero_copy_only=False) for k in ("lang", "terms", "low", "high")]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(table)]):
            if end > start:
                yield _tile(columns[0][start], int(columns[2][start]), int(columns[3][start]), table.slice(start, end - start))


def audit(docs: DataFrame, scratch: Scratch, least: int = 3, top: int = 200, light: int = LIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Part ``pair``: how far the group is from each other source of its language,
    over all terms that ``least`` documents of the language hold. Part ``term``:
    the ``top`` terms that it uses more than the language does. Terms in more than
    ``light`` groups go through tiles, others through postings; the sums are equal
    whatever ``light`` is. Ranks run by value, descending, and the item's bytes.

    Null text, lang and source read as ''; empty texts hold no term, but their
    group is listed. Rows that repeat count each. No rows give no rows; a
    language of one source has no pairs, one without kept terms has pairs of 0.
    Other columns of ``docs`` are not read.
    """
    by_term = Window.partitionBy("lang", "term")
    # dealt by term once: the sums by source and the windows need no other exchange
    entries = term_counts(docs).repartition("lang", "term").select("lang", "term", F.inline("uses"))
    counts = entries.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = {"held": F.sum("docs").over(by_term), "all": F.sum("n").over(by_term), "groups": F.count(F.lit(1)).over(by_term), "nth": F.row_number().over(by_term.orderBy("source"))}
    kept = scratch.table(counts.withColumns(whole).where((F.col("held") >= least) | (F.col("term") == "")).drop("docs", "held"))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    heavy_terms = F.count_if((F.col("term") != "") & (F.col("nth") == 1) & (F.col("groups") > light))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if((F.col("term") != "") & (F.col("nth") == 1)).alias("v"), heavy_terms.alias("heavy"))
    numbered = sizes.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).join(langs, "lang")
    none = rate(F.lit(1), F.col("n") + F.col("v"))
    groups = scratch.table(numbered.withColumn("absent", F.when(F.col("v") > 0, none).otherwise(F.lit(1).cast("long"))))

    of = groups.select("lang", "source", "gid", "absent", "v", "lang_n", "heavy", F.col("n").alias("size"))
    rates = {"p": rate(F.col("n") + 1, F.col("size") + F.col("v")), "q": rate(F.col("all") + 1, F.col("lang_n") + F.col("v"))}
    rated = kept.where("term != ''").join(of, ["lang", "source"]).withColumns(rates)

    apart = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), apart.alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    shape = rated.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source")
    shape = shape.agg(F.collect_list(F.struct("p", "m")).alias("shape"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("gid", "absent")).alias("peers"))
    nothing = F.array().cast("array<long>")
    against = groups.join(shape, ["lang", "source"], "left").join(peers, "lang").select("lang", "gid", "v", "absent", F.coalesce("shape.p", nothing).alias("rates"), F.coalesce("shape.m", nothing).alias("terms"), F.col("peers.gid").alias("gids"), F.col("peers.absent").alias("absents"))

    shared = rated.select("lang", "term", "groups", "heavy", "gid", "p", "absent")
    few = shared.where((F.col("groups") > 1) & (F.col("groups") <= light)).groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "absent")).alias("x"))  # at most ``light`` each
    few = few.select("lang", F.col("x.gid").alias("gids"), F.col("x.p").alias("rates"), F.col("x.absent").alias("absents"))
    blocks = groups.groupBy("lang").agg((F.floor((F.count(F.lit(1)) - 1) / GROUPS)).cast("int").alias("last"))
    many = shared.where(F.col("groups") > light).join(blocks, "lang").withColumn("mine", F.floor(F.col("gid") / GROUPS).cast("int"))
    many = many.withColumns({"terms": F.pmod(F.xxhash64("term"), F.ceil(F.col("heavy") / TERMS)), "other": F.explode(F.sequence(F.lit(0), F.col("last")))})
    many = many.select("lang", "terms", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "term", "gid", "p", "absent")
    tiles = many.repartition("lang", "terms", "low", "high").sortWithinPartitions("lang", "terms", "low", "high")

    parts = against.mapInArrow(_by_histogram, _SUMS).unionByName(few.mapInArrow(_light, _SUMS)).unionByName(tiles.mapInArrow(_heavy, _SUMS))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda gid, out: groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(out))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))


def op13(spark, sf_dir: str) -> DataFrame:
    """Every group of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op13"))


ORACLE = r"""
WITH w AS (SELECT doc_id, rowid AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
     kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
     g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
     n AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
     size AS (SELECT g.lang, g.source, coalesce(sum(n.c), 0)::HUGEINT AS n FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
     l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
     dense AS (SELECT s.lang, s.source, k.term, coalesce(n.c, 0) AS c, 1 + (1000000000 * (coalesce(n.c, 0) + 1)) // (s.n + l.v) AS p, 1 + (1000000000 * (k.c + 1)) // (l.n + l.v) AS q
               FROM size s JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN n ON n.lang = s.lang AND n.source = s.source AND n.term = k.term),
     sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM dense WHERE c > 0 AND p > q),
     u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
     r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
