"""Byte-level BPE by DuckDB recursive queries inside each task.

Pre-tokens not seen before by the worker become (word, position, token) rows;
a recursive query joins neighbouring tokens with the merge table and contracts
each word's leftmost pair of least rank until no pair merges. Decoding joins
ids with the vocabulary and concatenates bytes by ordered aggregation.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default of ``long``: longer pre-tokens (in bytes) are contracted with a heap, as
#: a recursive query copies a word once per merge. The recursion takes any length
#: and gives the same ids, as tests check at both ends of the parameter.
LONG = 256
#: Words and bytes of one recursive query, ids of one decoding query.
BLOCK, BLOCK_BYTES, BLOCK_IDS = 20_000, 1 << 20, 1 << 18
CACHE = 700_000

_MERGE = """
WITH RECURSIVE s AS (
  SELECT w, pos, tok, false AS done FROM base
  UNION ALL
  (WITH p AS (SELECT w, pos, tok, lead(tok) OVER o AS following, lag(pos) OVER o AS before
              FROM s WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY pos)),
        q AS (SELECT p.w, p.pos, p.tok, p.before, m.id FROM p LEFT JOIN merges m ON p.tok = m.l AND p.following = m.r),
        b AS (SELECT w, min((id::BIGINT << 32) + pos) AS best FROM q GROUP BY w)
   SELECT q.w, q.pos, CASE WHEN q.pos = (best & 4294967295) THEN (best >> 32)::INTEGER ELSE q.tok END, best IS NULL
   FROM q JOIN b ON q.w = b.w
   WHERE best IS NULL OR q.before IS NULL OR q.before <> (best & 4294967295))
)
SELECT w, tok FROM s WHERE done ORDER BY w, pos
"""
_DECODE = """
SELECT t.d, string_agg(v.hex, '' ORDER BY t.p) AS hex FROM tokens t JOIN vocab v ON t.id = v.id GROUP BY t.d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank file, with a private in-memory database."""

    def __init__(self, path: str, pattern: str, long: int = LONG):
        self.long = long
        self.pattern = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.names = [str(i) for i in range(max(self.ranks.values()) + 1)]
        self.cache: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # blocks are small: nothing is spilled to a local folder
        splits = [(l, r, i) for b, i in self.ranks.items() for k in range(1, len(b)) if (l := self.ranks.get(b[:k])) is not None and (r := self.ranks.get(b[k:])) is not None]
        merges = pa.table([pa.array(c, pa.int32()) for c in zip(*splits)] if splits else [pa.array([], pa.int32())] * 3, ["l", "r", "id"])  # noqa: F841
        vocab = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [b.hex() for b in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")

    def _recursive(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        at = np.cumsum([0, *map(len, words)])
        start = 0
        while start < len(words):
            end = min(start + BLOCK, max(start + 1, int(np.searchsorted(at, at[start] + BLOCK_BYTES, "right")) - 1))
            part, start = words[start:end], end
            sizes = np.array([len(b) for b in part])
            w = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            pos = (np.arange(len(w)) - (np.cumsum(sizes) - sizes)[w]).astype(np.int32)
            base = pa.table({"w": w, "pos": pos, "tok": self.single[np.frombuffer(b"".join(part), np.uint8)]})  # noqa: F841
            got = self.db.sql(_MERGE).to_arrow_table()
            ids = got.column("tok").to_numpy().astype("<i4")
            ends = np.searchsorted(got.column("w").to_numpy(), np.arange(len(part) + 1)) * 4
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return out

    def _heap(self, word: bytes) -> bytes:
        """The same contraction for one long pre-token, in n log n steps."""
        n, ranks = len(word), self.ranks
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < n:
                rank = ranks.get(word[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or right[i] >= n or end[right[i]] != stop:
                continue
            j = right[i]
            alive[j], end[i], right[i] = False, end[j], right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = right[i]
        return np.array(out, "<i4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, as bytes; a pre-token that is in the vocabulary is one token."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: dict[str, bytes] = {}
        short: list[int] = []
        for i, (w, b) in enumerate(zip(words, raw)):
            rank = self.ranks.get(b)
            if rank is not None:
                out[w] = rank.to_bytes(4, "little")
            elif len(b) > self.long:
                out[w] = self._heap(b)
            else:
                short.append(i)
        for i, ids in zip(short, self._recursive([raw[i] for i in short])):
            out[words[i]] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text, without special tokens; null is empty."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        cache = self.cache
        new = list({w for words in split for w in words if w not in cache})
        extra: dict[str, bytes] = {}
        if new:
            got = self._learn(new)
            if len(cache) + len(got) > CACHE:
                cache.clear()
                got |= self._learn(list({w for words in split for w in words} - got.keys()))
            extra = {w: b for w, b in got.items() if len(w) > LONG}
            cache.update((w, b) for w, b in got.items() if len(w) <= LONG)
        find = (lambda w: cache.get(w) or extra[w]) if extra else cache.__getitem__
        return [np.frombuffer(b"".join(map(find, words)), "<i4") for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids. An id that isn't in the vocabulary raises."""
        sizes = np.array([len(i) for i in ids], np.int64)
        whole = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        out = [b""] * len(ids)
        for start in range(0, len(whole), BLOCK_IDS):  # a text may go on in the next block
            flat, d = whole[start : start + BLOCK_IDS], owner[start : start + BLOCK_IDS]
            tokens = pa.table({"d": d, "p": np.arange(len(flat), dtype=np.int32), "id": flat})  # noqa: F841
            if self.db.sql("SELECT count(*) FROM tokens t ANTI JOIN vocab v ON t.id = v.id").fetchall()[0][0]:
                raise ValueError("an id is not in the vocabulary")
            for i, text in self.db.sql(_DECODE).fetchall():
                out[i] += bytes.fromhex(text)
        return out


@lru_cache(2)
def codec(path: str, pattern: str, long: int = LONG) -> Codec:
    """One per worker process and file."""
    return Codec(path, pattern, long)


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.nan_to_num(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], float)))
    start = 0
    while start < len(batch):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, out: str = "ids", long: int = LONG) -> DataFrame:
    """``docs`` with a column ``out`` (array of int): the ids of each text; null and
    empty texts give an empty array. Texts of any length are encoded whole, rows
    that repeat give equal ids. ``long``: see ``LONG``."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = [*docs.columns, out]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern, long)
        for batch in batches:
            for rows in _slices(batch, text, 1 << 20):
                ids = one.encode(rows.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], [*rows.schema.names, "ids"])

    return plain.mapInArrow(run, f"{kinds}, ids array<int>").toDF(*names)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN, out: str = "decoded") -> DataFrame:
    """``df`` with a column ``out`` (binary): the bytes of each array of ids; null is empty."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    names = [*df.columns, out]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    ids = f"c{df.columns.index(ids_col)}"
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in batches:
            for start in range(0, len(batch), 500):
                rows = batch.slice(start, 500)
                got = one.decode([np.array(x.as_py() or [], np.int32) for x in rows.column(ids)])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.binary())], [*rows.schema.names, "decoded"])

    return plain.mapInArrow(run, f"{kinds}, decoded binary").toDF(*names)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row: encode and
    decode in one pass, digests only. A null text is empty; ids are only carried."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in batches:
            for rows in _slices(batch, "text", 1 << 20):
                ids = one.encode(rows.column("text").to_pylist())
                back = one.decode(ids)
                digests = [hashlib.sha256(",".join(map(one.names.__getitem__, i.tolist())).encode()).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(digests), pa.array([hashlib.sha256(b).hexdigest() for b in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark, sf_dir: str) -> DataFrame:
    """All whole texts, by the multilingual rank file."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text")))
