"""Toxicity scores through a noisy channel.

Tokens that look obfuscated (digits or signs among letters, letters set apart,
letters repeated) become character lattices: every sign may stand for some
letters, separators may vanish, repeats may collapse. Viterbi decoding under a
character trigram model of the corpus restores the likeliest word; scores are
then read from the restored text with word and word-beginning evidence
learned from labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import words as W
from .common import chunks
from .jaccard import set_key

_U = np.uint64
#: Letters that a sign can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "x"}
SEPARATORS = " .-_*~'`,/"
BEGINNINGS = (4, 5, 6, 7, 8)
FORMS = 1 + len(BEGINNINGS)
_ALPHABET = 28  # 0 the border, 1-26 letters, 27 any other letter
SUBSTITUTE, COLLAPSE, DROP = math.log(0.2), math.log(0.3), math.log(0.5)

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in ".-_*"]] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[W.LETTER] = 27
for _i in range(26):
    _SYMBOL[[0x41 + _i, 0x61 + _i]] = _i + 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the accented Latin-1 capitals (0xC3 0x80-0x9E) in lower case."""
    out = W.LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


@dataclass
class Channel:
    """log P(next | two before) of the characters of words."""

    table: np.ndarray

    def restore(self, token: str) -> str:
        """The likeliest word behind a token: Viterbi over its lattice."""
        table = self.table
        live: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        for i, ch in enumerate(token):
            repeat = token[i - 2 : i + 1] == ch * 3 or token[i - 1 : i + 2] == ch * 3 or token[i : i + 3] == ch * 3
            nexts: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def offer(state: tuple[int, int, str], score: float, path: tuple | None) -> None:
                if state not in nexts or nexts[state][0] < score:
                    nexts[state] = (score, path)

            letter = ch if ch.isalpha() else ""
            options = [(letter, 0.0)] if letter else [(c, SUBSTITUTE) for c in LEET.get(ch, "")]
            for (a, b, last), (score, path) in live.items():
                for c, cost in options:
                    s = 27 if not "a" <= c <= "z" else ord(c) - 96
                    offer((b, s, c), score + cost + table[a, b, s], (path, c))
                    if repeat and c == last:
                        offer((a, b, last), score + cost + COLLAPSE, path)
                if ch in SEPARATORS or not options:
                    offer((a, b, last), score + DROP, path)
            live = nexts
        best = max(((score + table[a, b, 0], path) for (a, b, _), (score, path) in live.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, c = best
            out.append(c)
        return "".join(reversed(out))


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of character triples of the words, borders included."""
    starts, ends, _ = W.split(data, offsets, W.LETTER)
    size = ends - starts
    place = np.cumsum(size + 3) - size - 1  # two borders before a word, one behind
    flat = np.zeros(int((size + 3).sum()), np.int64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(place, size) + within] = _SYMBOL[data[np.repeat(starts, size) + within]]
    code = (flat[:-2] * _ALPHABET + flat[1:-1]) * _ALPHABET + flat[2:] if len(flat) > 2 else np.zeros(0, np.int64)
    counts = np.bincount(code, minlength=_ALPHABET**3)
    counts[0] = 0
    return counts


def channel(docs: DataFrame) -> Channel:
    """The character model of all texts of ``docs`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALPHABET**3, np.int64)
        for _, data, offsets in chunks(batches, "text"):
            total += trigram_counts(data, offsets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    counts = np.full(_ALPHABET**3, 0.02)
    for code, n in docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n")).collect():  # 28**3 rows at most
        counts[code] += n
    counts = counts.reshape((_ALPHABET,) * 3)
    return Channel(np.log(counts / counts.sum(2, keepdims=True)))


def suspects(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, begin, end) of spans that look obfuscated. Whitespace-split words given."""
    if not len(starts):
        return []
    letter, sign = _ASCII_LETTER[raw], _SIGN[raw]
    after = np.append(letter[1:], False)
    before = np.append(False, letter[:-1])
    low = W.LOWER[raw]
    triple = np.zeros(len(raw), bool)
    triple[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    digit = sign & (raw != 0x21) & (raw != 0x2A) & (raw != 0x23) & (raw != 0x25) & (raw != 0x24) & (raw != 0x40)
    gapped = np.zeros(len(raw), bool)  # x.y.z
    if len(raw) > 4:
        gapped[2:-2] = letter[2:-2] & _GAP[raw[1:-3]] & _GAP[raw[3:-1]] & (letter | sign)[:-4] & (letter | sign)[4:]
    mark = (sign & after) | (digit & before) | triple | gapped
    sums = np.concatenate([[0], np.cumsum(mark)])
    odd = sums[ends] > sums[starts]
    has = np.concatenate([[0], np.cumsum(letter)])
    odd &= has[ends] > has[starts]
    out = [(int(rows[i]), int(starts[i]), int(ends[i])) for i in np.flatnonzero(odd)]
    single = (ends - starts == 1) & (letter | sign)[starts]
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (single).astype(np.int8), [0]])))
        for a, b in zip(edge[0::2], edge[1::2]):
            cut = np.flatnonzero(np.diff(rows[a:b])) + a + 1
            for x, y in zip([a, *cut], [*cut, b]):
                if y - x >= 3:
                    out.append((int(rows[x]), int(starts[x]), int(ends[y - 1])))
    return out


@dataclass
class Model:
    """Sorted feature hashes with their share of toxic texts, and the rest's base rate."""

    channel: Channel
    hashes: np.ndarray
    share: np.ndarray
    base: float

    def __post_init__(self) -> None:
        self.screen = np.zeros(1 << 20, bool)
        self.screen[self.hashes & _U((1 << 20) - 1)] = True
        self.cache: dict[bytes, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("channel", "hashes", "share", "base")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()


def restored(raw: np.ndarray, offsets: np.ndarray, model: Channel, cache: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The restored words of each row's suspects, as texts: (bytes, offsets)."""
    starts, ends, first = W.split(raw, offsets, W.NOT_SPACE)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
    memory = raw.tobytes()
    for row, a, b in suspects(raw, starts, ends, rows):
        token = memory[a:b]
        word = cache.get(token)
        if word is None:
            text = token.decode("utf-8", "ignore").lower().strip(".,;:!?\"'()[]{}&#%*")
            word = model.restore(text).encode() if text else b""
            if len(cache) > 200_000:
                cache.clear()
            cache[token] = word
        if word:
            parts[row].append(word)
    joined = [b" ".join(p) for p in parts]
    return np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(j) for j in joined])]).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): of each word, whole and its first 4 to 8 bytes (0 where shorter)."""
    starts, ends, first = W.split(data, offsets, W.LETTER)
    sums = W.prefix_sums(data)
    out = np.zeros((len(starts), FORMS), _U)
    out[:, 0] = W.span_hashes(sums, starts, ends)
    for j, k in enumerate(BEGINNINGS, 1):
        long = ends - starts >= k
        out[long, j] = W.span_hashes(sums, starts[long], starts[long] + k) + _U(j)
    return out, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def all_features(raw: np.ndarray, offsets: np.ndarray, model: Channel, cache: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts as they stand and of their restored words."""
    plain, rows = features(lower(raw), offsets)
    more, more_rows = features(*restored(raw, offsets, model, cache))
    return np.concatenate([plain, more]), np.concatenate([rows, more_rows])


def score_texts(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 - (1 - base) * product over distinct indicating words of (1 - share)."""
    found, rows = all_features(raw, offsets, model.channel, model.cache)
    hit = model.screen[found & _U((1 << 20) - 1)].any(1)
    found, rows = found[hit], rows[hit]
    log_clean = np.full(len(offsets) - 1, math.log1p(-model.base))
    if len(found) and len(model.hashes):
        at = np.minimum(np.searchsorted(model.hashes, found), len(model.hashes) - 1)
        share = np.where(model.hashes[at] == found, model.share[at], 0.0).max(1)
        some = share > 0
        key = np.unique(np.stack([rows[some].astype(_U), found[some, 0]], 1), axis=0, return_index=True)[1]
        np.add.at(log_clean, rows[some][key], np.log1p(-share[some][key]))
    return -np.expm1(log_clean)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, bound: int = 60_000, support: int = 3, least: float = 0.65) -> Model:
    """Learn from labelled rows of ``docs`` (doc_id, text).

    ``labels``: doc_id, toxic (0/1; of several rows the largest counts; null
    is no label). At most about ``bound`` labelled rows, chosen by a hash of
    the id, are used to fit; the character model counts all texts. A word's
    evidence counts texts with distinct sets of shingles, so copies of one text
    count once; a feature needs ``support`` toxic ones and a smoothed share
    of ``least``. With no labelled row every text gets the same low score.
    """
    spark = docs.sparkSession
    speech = channel(docs)
    known = labels.where("doc_id is not null and toxic is not null").where(may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    share = min(1.0, bound / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = F.broadcast(chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic")))  # bounded by ``bound``
    texts = docs.select("doc_id", "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in chunks(batches, "text"):
            starts, ends, first = W.split(raw, offsets, W.NOT_SPACE)
            grams, at = W.shingles(W.span_hashes(W.prefix_sums(raw), starts, ends), first, 3)
            keys = [set_key(np.unique(grams[at[i] : at[i + 1]])) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.array(keys, pa.int64())], ["doc_id", "toxic", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = texts.join(chosen, "doc_id").mapInArrow(sketch, f"doc_id {kind}, toxic int, sketch long")
    distinct = sketched.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    distinct = distinct.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).persist()
    counts = distinct.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.count(F.lit(1))).first()
    taught = texts.join(F.broadcast(distinct), "doc_id").withColumn("screens", (F.col("toxic") > 0) | (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(8)) == 0))  # bounded by ``bound``

    def evidence(wanted: np.ndarray | None, known: np.ndarray) -> DataFrame:
        """(feature, toxic texts, other texts), summed in each task first. Without
        ``wanted``: all features of toxic texts and of an eighth of the others, by id.
        A word that is known to indicate counts for itself only, so that its
        beginnings must earn their share from other words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[bytes, bytes] = {}
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def folded() -> tuple[np.ndarray, ...]:
                u, inv = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                return u, *(np.bincount(inv, np.concatenate([h[i] for h in held]), len(u)).astype(np.int64) for i in (1, 2))

            for rows, raw, offsets in chunks(batches, "text"):
                toxic = rows.column("toxic").to_numpy() > 0
                found, row = all_features(raw, offsets, speech, cache)
                found[np.isin(found[:, 0], known), 1:] = 0
                hashes, row = found.ravel(), np.repeat(row, FORMS)
                if wanted is None:
                    keep = (hashes != 0) & rows.column("screens").to_numpy(zero_copy_only=False)[row]
                else:
                    keep = (hashes != 0) & (wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes)
                pair = np.unique(np.stack([hashes[keep], row[keep].astype(_U)], 1), axis=0)
                yes = toxic[pair[:, 1].astype(np.int64)]
                held.append((pair[:, 0], yes.astype(np.int64), (~yes).astype(np.int64)))
                if len(held) > 12:
                    held[:] = [folded()]
            if held:
                f, yes, no = folded()
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(yes), pa.array(no)], ["f", "yes", "no"])

        return taught.mapInArrow(run, "f long, yes long, no long").groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))

    yes_rows = counts[0] or 0
    prior, weight = (yes_rows + 0.1) / ((counts[1] or 0) + 1.0), min(4.0, max(2.0, yes_rows / 100))
    none = np.zeros(0, _U)
    # a feature that more of the screening texts have than toxic ones stays below any share asked for; the rest is counted in all texts
    first = evidence(None, none).where((F.col("yes") >= support) & (F.col("no") <= F.col("yes") + 2))
    wanted = np.sort(first.select("f").toArrow().column("f").to_numpy().view(_U))
    indicating: dict[int, float] = {}
    for known in (none, None) if len(wanted) else ():
        known = np.array(sorted(indicating), _U) if known is None else known
        for f, yes, no in zip(*(c.to_numpy().tolist() for c in evidence(wanted, known).toArrow().columns)):
            f, share = int(f) % (1 << 64), (yes + weight * prior) / (yes + no + weight)
            indicating.pop(f, None)
            if share >= least:
                indicating[f] = min(0.999, share)
    distinct.unpersist()
    hashes = np.array(sorted(indicating), _U)
    return Model(speech, hashes, np.array([indicating[int(h)] for h in hashes], float), min(0.3, prior / 4))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """The given columns and ``score_col`` (double, 0 to 1); a null or empty text
    gets the base score, a column of that name that ``docs`` has is replaced.
    Rows are judged one by one: repeated rows and ids get equal scores."""
    rest = [c for c in docs.columns if c != score_col]
    schema = StructType([*docs.select(*[f"`{c}`" for c in rest]).schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score_texts(model, raw, offsets))], [*rows.schema.names, score_col])

    return docs.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def below(docs: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all its columns, whose score is below ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in chunks(batches, text_col):
            yield rows.filter(pa.array(score_texts(model, raw, offsets) < limit))

    return docs.mapInArrow(run, docs.schema)


def fold(of: str = "doc_id") -> Column:
    """crc32(id as text) mod 3; rows of remainder 1 are held out."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % 3


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs.select(F.col("doc_id"), F.col("text")), labels.select("doc_id", "toxic"), fold() != 1)


def op6(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = with_scores(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(True)).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
