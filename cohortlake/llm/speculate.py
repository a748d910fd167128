"""Byte-level BPE by speculation: greedy longest matches, verified pair by pair.

A sequence of tokens is the encoding of its word exactly when every token is the
encoding of its own bytes and every two neighbours are the encoding of theirs
joined (no merge across a border ever comes before the merges that use up the
pieces beside it). So a block of words is cut greedily into the longest tokens,
all words at once in numpy; all pairs of neighbours are checked at once; and only
words with a pair that fails are merged rank by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import chunks
from .encode import _byte_of

#: Characters on whose classes all libraries agree; texts with others are cut by the library's own splitter.
USUAL = re.compile("[\0-ɏ‐-‧€]*")
#: Words that a worker remembers, the longest of them in characters, and the bytes of a block.
CACHE, LONG, BLOCK = 700_000, 256, 1 << 20
NEVER = np.int64(1) << 40


def _splitter() -> re.Pattern:
    """The pattern of byte-level splitters over the usual characters, their classes spelt out."""
    usual = [chr(i) for i in range(0x2028) if USUAL.fullmatch(chr(i))] + ["€"]
    named = lambda kind: "".join(re.escape(c) for c in usual if unicodedata.category(c)[0] == kind)
    letter, number, space = named("L"), named("N"), "\\t-\\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Speculator:
    """Encoder and decoder of one file of the tokenizers library: plain byte-level
    BPE in which each token is made by one merge, after its parts. Other files raise."""

    def __init__(self, path: str):
        with open(path) as f:
            data = json.load(f)
        model, split = data["model"], data.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or data.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or (data.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("not a plain byte-level BPE file")
        added = data.get("added_tokens", [])
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.split = _splitter()
        self.byte = _byte_of()

        vocab = {w: i for w, i in model["vocab"].items()}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes = [b""] * size
        for w, i in [*vocab.items(), *self.added.items()]:
            self.bytes[i] = bytes(self.byte[c] for c in w) if all(c in self.byte for c in w) else w.encode()
        self.single = np.array([vocab[c] for c in sorted(self.byte, key=self.byte.__getitem__)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array(c, np.int64) for c in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])) if pairs else [np.zeros(0, np.int64)] * 3
        #: When each token is made (bytes: before all merges) and of what.
        self.born, self.left, self.right = np.full(size, NEVER), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.born[self.single] = -1
        if len(np.unique(made)) < len(made) or np.isin(made, self.single).any():
            raise ValueError("a token is made by two merges")
        self.born[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        if (np.maximum(self.born[left], self.born[right]) >= self.born[made]).any():
            raise ValueError("a token is made before its parts")
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merges = {(a, b): (i, c) for i, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist()))}
        whole = self.born < 0
        for i in made[self.compatible(left, right, self.born[made])].tolist():  # in order of rank: parts come first
            whole[i] = whole[self.left[i]] and whole[self.right[i]]
        self._trie([(self.bytes[i], i) for i in np.flatnonzero(whole).tolist()])
        self.cache: dict[str, bytes] = {}

    def _trie(self, tokens: list[tuple[bytes, int]]) -> None:
        """Nodes as sorted (node, byte) keys; only tokens that encode their own bytes are ends."""
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        for text, i in tokens:
            node = 0
            for b in text:
                node = edges.setdefault(node << 8 | b, len(edges) + 1)
            ends[node] = i
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge, self.child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.end = np.full(len(edges) + 1, -1, np.int64)
        self.end[list(ends)] = list(ends.values())

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b, side by side, stay as they are when their bytes are
        encoded (by the merges ranked under ``before`` only, if given).

        Walks back in time from the two tokens to the bytes at their border: each
        state is a pair of pieces that lie side by side between two merges. A pair
        that merges while both are there breaks the border; of merges of equal rank
        the leftmost comes first.
        """
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        used_a = np.full(len(a), NEVER) if before is None else before.copy()
        used_b = used_a.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            rank = np.where(self.keys[at] == key, self.order[at], NEVER) if len(self.keys) else np.full(len(live), NEVER)
            out[live[(rank < used_a[live]) & (rank <= used_b[live])]] = False
            since_a, since_b = self.born[x], self.born[y]
            go = out[live] & (np.maximum(since_a, since_b) >= 0)
            back_a = go & (since_a > since_b)
            back_b = go & ~back_a
            used_a[live[back_a]], a[live[back_a]] = since_a[back_a], self.right[x[back_a]]
            used_b[live[back_b]], b[live[back_b]] = since_b[back_b], self.left[y[back_b]]
            live = live[go]
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of each word's first id): every word cut greedily into its longest tokens."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(size) - size
        stop = np.repeat(starts + size, size)
        ids, length = self.single[flat].copy(), np.ones(len(flat), np.int64)
        live, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        while len(live):  # the longest token from every place, a byte deeper each time
            key = node << 8 | flat[live + depth]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            live, node, depth = live[hit], self.child[at[hit]], depth + 1
            token = self.end[node]
            full = token >= 0
            ids[live[full]], length[live[full]] = token[full], depth
            on = live + depth < stop[live]
            live, node = live[on], node[on]
        taken = np.zeros(len(flat) + 1, bool)
        taken[starts] = True
        jump = np.append(np.arange(len(flat)) + length, len(flat))
        for _ in range(int(size.max(initial=0)).bit_length()):  # places reached in 1, 2, 4 ... tokens
            taken[jump[np.flatnonzero(taken)]] = True
            jump = jump[jump]
        at = np.flatnonzero(taken[:-1])
        return ids[at], np.searchsorted(at, np.append(starts, len(flat)))

    def exact(self, word: bytes) -> list[int]:
        """One word by its merges: least rank first, leftmost of equals."""
        token = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, token[i], token[i + 1]) for i in range(n - 1) if (m := self.merges.get((token[i], token[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (ahead[i], i):
                if k >= 0 and after[k] < n and (m := self.merges.get((token[k], token[after[k]]))):
                    heapq.heappush(heap, (m[0], k, token[k], token[after[k]]))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word (none is empty)."""
        out: list[bytes] = []
        at = np.cumsum([0, *map(len, words)])
        start = 0
        while start < len(words):
            end = max(start + 1, int(np.searchsorted(at, at[start] + BLOCK, "right")) - 1)
            part, start = words[start:end], end
            ids, first = self.propose(part)
            owner = np.repeat(np.arange(len(part)), np.diff(first))
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, which = np.unique(ids[inside] << 32 | ids[inside + 1], return_inverse=True)
            fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
            raw, cut = ids.astype("<u4").tobytes(), (4 * first).tolist()
            got = [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]
            for i in np.unique(owner[inside[fails]]).tolist():
                got[i] = np.array(self.exact(part[i]), "<u4").tobytes()
            out += got
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii() or USUAL.fullmatch(text):
            return self.split.findall(text)
        return [bytes(map(self.byte.__getitem__, piece)).decode() for piece, _ in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens added; null is empty."""
        cut: list[list[str | int]] = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.marks and self.marks.search(text):
                cut.append([w for i, part in enumerate(self.marks.split(text)) for w in ([self.added[part]] if i % 2 else self.words(part))])
            else:
                cut.append(self.words(text))
        cache, extra = self.cache, {}
        new = list({w for words in cut for w in words if w not in cache})
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({w for words in cut for w in words})
        for w in [w for w in new if isinstance(w, int)]:
            cache[w] = w.to_bytes(4, "little")
        fresh = [w for w in new if not isinstance(w, int)]
        for w, ids in zip(fresh, self.encode_words([w.encode() for w in fresh])):
            (cache if len(w) <= LONG else extra)[w] = ids
        find = (lambda w: cache.get(w) or extra[w]) if extra else cache.__getitem__
        return [b"".join(map(find, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; ids beyond the vocabulary are left out, bytes that are no UTF-8 replaced."""
        have = self.bytes
        return b"".join([have[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(have)]).decode("utf-8", "replace")


@lru_cache(2)
def speculator(path: str) -> Speculator:
    """One per worker process and file."""
    return Speculator(path)


def _mapped(df: DataFrame, column: str, out: str, kind: str, slices, make) -> DataFrame:
    """``df`` with a column more, made of each slice's rows; columns of any names are carried."""
    names = [*df.columns, out]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    mine = f"c{df.columns.index(column)}"
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, mine):
            yield pa.RecordBatch.from_arrays([*rows.columns, make(rows.column(mine))], [*rows.schema.names, "made"])

    return plain.mapInArrow(run, f"{kinds}, made {kind}").toDF(*names)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` (array of long): the ids of each whole text.
    Null and empty texts give an empty array; rows that repeat give equal ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def make(texts: pa.Array) -> pa.Array:
        ids = speculator(path).encode(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))

    return _mapped(docs, text_col, out, "array<long>", lambda batches, c: (rows for rows, _, _ in chunks(batches, c, 1 << 20)), make)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out`` (string): the text of each array of ids, special
    tokens kept. Null arrays are empty; null ids and ids beyond the vocabulary are left out."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    slices = lambda batches, _: (batch.slice(i, 500) for batch in batches for i in range(0, len(batch), 500))

    def make(ids: pa.Array) -> pa.Array:
        one, most = speculator(path), 1 << 32
        lists = [[i for i in x.as_py() or [] if i is not None and 0 <= i < most] for x in ids]
        return pa.array([one.decode(np.array(x, "<u4").tobytes()) for x in lists], pa.string())

    return _mapped(df, ids_col, out, "string", slices, make)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row: encoded and
    decoded in one pass, digests only. A null text is empty; ids are only carried,
    so null and repeated ones are rows like others. No rows give no rows."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = speculator(path)
        for rows, _, _ in chunks(batches, "text", 1 << 20):
            ids = one.encode(rows.column("text").to_pylist())
            back = [hashlib.sha256(one.decode(i).encode()).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12(spark, sf_dir: str) -> DataFrame:
    """All whole texts, by the 50k byte-level file."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
