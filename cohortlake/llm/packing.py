"""Shortest-pack-first histogram packing of tokenised documents.

Only the histogram of piece lengths (at most ``capacity`` entries) is packed,
on the driver; packs are patterns with counts. Pieces are then given ranks
within their length and read their place from the patterns by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .encode import encoder

CAPACITY, END = 2048, 1
LANES, FULL_LANES = 64, 1024


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, copies) patterns that hold every length as often as it occurs.

    Lengths are placed longest first, each into the shortest packs that still
    have room; a pattern of which only some copies take the length splits.
    """
    by_total: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for total in range(1, capacity - length + 1):
            if not left:
                break
            for pattern in list(by_total[total]):
                n = min(left, by_total[total][pattern])
                if n == by_total[total][pattern]:
                    del by_total[total][pattern]
                else:
                    by_total[total][pattern] -= n
                grown = pattern + (length,)
                by_total[total + length][grown] = by_total[total + length].get(grown, 0) + n
                left -= n
                if not left:
                    break
        if left:
            by_total[length][(length,)] = by_total[length].get((length,), 0) + left
    return [(p, n) for packs in by_total for p, n in packs.items()]


def slots(patterns: list[tuple[tuple[int, ...], int]], first_id: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, sequence id of that rank, offset) in rank order."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for pattern, copies in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, first_id, offset))
            used[length] = rank + copies
            offset += length
        first_id += copies
    return {k: np.array(v, np.int64) for k, v in out.items()}


def token_pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """(doc_id, doc_tokens, crcs): ids of the text and ``end``, cut every ``capacity`` ids; a crc32 per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            sizes, crcs = [], []
            for text in batch.column("text"):
                ids = encode(text.as_py() or "") + last
                sizes.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[a : a + 4 * capacity]) for a in range(0, len(ids), 4 * capacity)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives the end id alone. Pieces of ``capacity``
    ids fill a sequence each; what is left of each document is packed whole.
    Ids may be null or repeated: every row of ``docs`` is its own document.
    No rows give no pieces.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    mine = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sized = scratch.table(token_pieces(mine, path, capacity, end))
    rest, full = F.col("doc_tokens") % capacity, F.floor(F.col("doc_tokens") / capacity)
    key = F.xxhash64("doc_id", "crcs")
    lanes = sized.withColumns({"rest": rest.cast("int"), "full": full.cast("long"), "lane": F.pmod(key, F.lit(LANES)).cast("int"), "row": F.pmod(F.xxhash64(key), F.lit(FULL_LANES)).cast("int")})
    counts = lanes.groupBy("rest", "lane").agg(F.count(F.lit(1))).collect()  # capacity * LANES rows at most
    fulls = dict(lanes.groupBy("row").agg(F.sum("full")).collect())  # FULL_LANES rows at most
    before_row, total = np.zeros(FULL_LANES, np.int64), 0
    for lane in range(FULL_LANES):
        before_row[lane] = total
        total += fulls.get(lane) or 0
    table = np.zeros((capacity, LANES), np.int64)
    for length, lane, n in counts:
        table[length, lane] = n
    before_lane = np.cumsum(table, axis=1) - table
    places = slots(pack_histogram({i: int(n) for i, n in enumerate(table.sum(1)) if i and n}, capacity), total)

    by_lane = Window.partitionBy("rest", "lane").orderBy("doc_id", "crcs")
    by_row = Window.partitionBy("row").orderBy("doc_id", "crcs").rowsBetween(Window.unboundedPreceding, -1)
    ranked = lanes.withColumn("rank", F.row_number().over(by_lane)).withColumn("before", F.coalesce(F.sum("full").over(by_row), F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, lane, rank, row, before, tokens = (batch.column(c).to_numpy() for c in ("rest", "lane", "rank", "row", "before", "doc_tokens"))
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(batch)), pieces)
            nth = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
            length = np.minimum(capacity, tokens[doc] - nth * capacity)
            sequence = before_row[row[doc]] + before[doc] + nth
            offset = np.zeros(len(doc), np.int64)
            at = np.flatnonzero(length < capacity)
            index = before_lane[rest[doc[at]], lane[doc[at]]] + rank[doc[at]] - 1
            for value in np.unique(length[at]):
                mine = at[length[at] == value]
                wanted = index[length[at] == value]
                rows = places[int(value)]
                slot = np.searchsorted(rows[:, 0], wanted, "right") - 1
                sequence[mine] = rows[slot, 1] + wanted - rows[slot, 0]
                offset[mine] = rows[slot, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (nth * capacity, length)), batch.column("crcs").flatten(), *(pa.array(x.astype(np.int64)) for x in (tokens[doc], sequence, offset))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = sized.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "doc_tokens", "crcs", "rest", "lane", "rank", "row", "before").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op4"))
