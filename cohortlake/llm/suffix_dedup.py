"""Repeated-passage removal by blockwise suffix sorting with a difference cover.

Every byte position that can start a ``length``-byte string is a suffix; it
belongs to the suffix bucket of its window's minimiser (the leftmost smallest
hash among the k-byte grams inside the window), so equal strings always share
a bucket, and buckets are spread over the cluster by that hash. Suffixes that
follow each other under one minimiser travel as one segment; equal segments
collapse to one with a weight before bytes are shipped. A task then takes one
block of buckets at a time: suffixes at difference-cover positions are ranked
first (31 bytes, then by doubling), and all suffixes of the block are sorted,
long ties being resolved by those ranks, which bounds memory by the block.
Neighbours in suffix order that agree on ``length`` bytes are repeats. A bucket
that many places share (a line that stands in a third of all texts) is split
by the bytes beside the minimiser: of equal strings both sides of it are equal,
so each start follows the longer side, and equal strings stay together. What no
split divides, a string of the full length that very many texts share, is not
gathered: its starts are counted by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, chunks, give_back, partitions

#: A perfect difference set modulo 31: every distance is a difference of two members.
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
_NEXT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
_SLOT = np.full(PERIOD, -1)
_SLOT[COVER] = np.arange(len(COVER))
_U = np.uint64
#: Bytes that are sorted at once; their ranks and hashes take many times as much.
BLOCK = 1 << 19
#: Places of one minimiser beyond which its bucket is split, and how often.
HOT, SPLITS = 512, 3


def text_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each row's bytes."""
    sums = W.prefix_sums(data)
    one = W.span_hashes(sums, offsets[:-1], offsets[1:])
    twisted = W.prefix_sums(((data.astype(np.uint16) * 167 + 13) & 255).astype(np.uint8) ^ np.roll(data, 1)) if len(data) else sums
    begin = np.minimum(offsets[:-1] + 1, offsets[1:])
    two = W.span_hashes(twisted, begin, offsets[1:]) ^ W.mix(one + _U(77))
    return one.view(np.int64), two.view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i that has a whole window."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray] | None:
    """Runs of window starts that share a minimiser: row, s0, s1 (last start,
    both from the row's begin), anchor (minimiser's place after s0), the
    minimiser's hash and the segment's hash."""
    if len(data) < length:
        return None
    sums = W.prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    h = W.mix((sums[gram:] - sums[: len(at)]) * W._power("down", len(at)))
    low = max(20, int(len(at)).bit_length())
    packed = (h >> _U(low) << _U(low)) | at.astype(_U)
    best = (sliding_min(packed, length - gram + 1) & _U((1 << low) - 1)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.maximum(0, np.diff(offsets) - length + 1))
    if not len(rows):
        return None
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    starts = offsets[rows] + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    best = best[starts]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (best[1:] != best[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    s0, s1, row = starts[first], starts[last], rows[first]
    return {"row": row, "s0": s0 - offsets[row], "s1": s1 - offsets[row], "anchor": best[first] - s0, "hash": h[best[first]].view(np.int64), "seg": W.span_hashes(sums, s0, s1 + length).view(np.int64)}


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks in the order of the keys, the first one counting most."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_starts(pieces: list[bytes], anchors: np.ndarray, weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment of a block, whether the string at each of its starts stands elsewhere too."""
    sizes = np.array([len(p) for p in pieces])
    base = np.empty(len(pieces), np.int64)
    place = 0
    for j in range(len(pieces)):  # every anchor lies at a multiple of the period, so equal strings have equal residues
        place += -(place + int(anchors[j])) % PERIOD
        base[j] = place
        place += int(sizes[j])
    text = np.zeros(place + 2 * PERIOD + length, np.uint8)
    for j, p in enumerate(pieces):
        text[base[j] : base[j] + sizes[j]] = np.frombuffer(p, np.uint8)
    # ranks of the cover's suffixes: 31 bytes, doubled up to depth PERIOD * steps
    cover = (np.arange(place // PERIOD + 1)[:, None] * PERIOD + COVER).ravel()
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    load = lambda p: words[p].view(">u8").ravel().astype(_U)
    rank = _ranks([load(cover), load(cover + 8), load(cover + 16), load(cover + PERIOD - 8)])
    steps, have, total = (length - 2 * PERIOD // 2 + 3) // PERIOD, {1: rank}, 0

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        b = np.append(b[shift * len(COVER) :], np.zeros(min(shift * len(COVER), len(b)), np.int64))[: len(a)]
        return _ranks([a * (int(b.max()) + 1) + b]) if len(a) else a

    depth = 1
    while depth * 2 <= steps:
        have[depth * 2] = joined(have[depth], have[depth], depth)
        depth *= 2
    full = None
    for d in sorted(have, reverse=True):
        if total + d <= steps:
            full = have[d] if full is None else joined(full, have[d], total)
            total += d
    starts_per = sizes - length + 1
    owner = np.repeat(np.arange(len(pieces)), starts_per)
    inside = np.arange(len(owner)) - (np.cumsum(starts_per) - starts_per)[owner]
    at = base[owner] + inside
    step = _NEXT[at % PERIOD]
    sample = at + step
    deep = full[sample // PERIOD * len(COVER) + _SLOT[sample % PERIOD]]
    sums = W.prefix_sums(text)
    # what the rank leaves open: the bytes before the sample and those after its depth
    rest = W.span_hashes(sums, at, sample) ^ W.mix(W.span_hashes(sums, sample + total * PERIOD, at + length) + _U(1))
    order = np.lexsort((rest, deep))
    deep, rest = deep[order], rest[order]
    same = (deep[1:] == deep[:-1]) & (rest[1:] == rest[:-1])
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.empty(len(order), bool)
    out[order] = hit
    out |= weights[owner] > 1
    return np.split(out, np.cumsum(starts_per)[:-1])


def split_piece(key: int, piece: bytes, anchor: int, length: int, gram: int, splits: int = SPLITS) -> list[tuple[int, int, bytes]]:
    """(bucket, first start, bytes): the piece's starts by what stands beside its
    minimiser, ``splits`` times halving the bytes of a string that the bucket
    leaves open. Equal strings come to equal buckets."""
    out = []
    stack = [(key, 0, len(piece) - length, anchor, anchor + gram, splits)]
    while stack:
        key, first, last, low, high, left = stack.pop()
        open_ = length - (high - low)
        if not left or open_ < 2:
            out.append((key, first, piece[first : last + length]))
            continue
        half = (open_ + 1) // 2
        if first <= low - half:  # starts with so many bytes before the known ones
            stack.append((_key(key, piece[low - half : high], 1), first, min(last, low - half), low - half, high, left - 1))
        if last > low - half:
            stack.append((_key(key, piece[low : high + half], 2), max(first, low - half + 1), last, low, high + half, left - 1))
    return out


def _key(key: int, raw: bytes, side: int) -> int:
    return xxhash.xxh64_intdigest(raw, (key * 4 + side) & ((1 << 64) - 1)) - (1 << 63)


def _spans(flags: np.ndarray, length: int) -> list[int]:
    """Covered intervals [begin, end) of marked starts, flat."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    begin, end = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + length
    return np.stack([begin, end], 1).ravel().tolist()


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = 400, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): for each distinct text of ``texts`` (text) that has any,
    the merged byte ranges covered by a ``length``-byte string that also starts
    elsewhere, as a flat array begin, end, begin, end, ... in order."""
    spark = texts.sparkSession
    gram = max(8, length * 2 // 5)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, "text"):
            found = segments(data, offsets, length, gram)
            if found:
                k1, k2 = text_keys(data, offsets)
                row = found["row"]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found["hash"], found["seg"], k1[row], k2[row], found["s0"], found["s1"], found["anchor"])], ["hash", "seg", "k1", "k2", "s0", "s1", "anchor"])

    made = texts.select("text").where("text is not null").mapInArrow(runs, "hash long, seg long, k1 long, k2 long, s0 long, s1 long, anchor long")
    placed = made.groupBy("hash", "seg", "k1", "k2", "s0", "s1", "anchor").agg(F.count(F.lit(1)).alias("n"))
    # minimisers that occur more than once; what is counted combines before it is shuffled, and of two tables Spark splits large keys in the join
    every = scratch.table(placed)
    shared = scratch.table(every.groupBy("hash").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("segments")).where("places > 1").select("hash", (F.col("segments") > hot).alias("hot")))
    placed = scratch.table(every.join(shared, "hash"))
    scratch.drop(every)
    # a weighted segment stands for its equal copies; one text is chosen to show its bytes
    chosen = placed.groupBy("hash", "seg").agg(F.sum("n").alias("weight"), F.min(F.struct("k1", "k2", "s0", "s1", "anchor")).alias("at"), F.first("hot").alias("hot"))
    asked = chosen.select("at.k1", "at.k2", F.struct("at.s0", "at.s1", "at.anchor", "hash", "seg", "weight", "hot").alias("want")).groupBy("k1", "k2").agg(F.collect_list("want").alias("wants"))
    asked = scratch.table(asked)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a text is shown once per task
        for rows, data, offsets in chunks(batches, "text"):
            k1, k2 = text_keys(data, offsets)
            fresh = []
            for pair in zip(k1.tolist(), k2.tolist()):
                fresh.append(pair not in seen)
                if len(seen) < 1_000_000:
                    seen.add(pair)
            mask = pa.array(fresh, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(k1).filter(mask), pa.array(k2).filter(mask), rows.column("text").filter(mask)], ["k1", "k2", "text"])

    long_texts = texts.select("text").where(F.octet_length("text") >= length).mapInArrow(keyed, "k1 long, k2 long, text string")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, wants in zip(batch.column("text"), batch.column("wants")):
                raw = text.as_buffer()
                for w in wants.as_py():
                    piece = raw[w["s0"] : w["s1"] + length].to_pybytes()
                    parts = split_piece(w["hash"], piece, w["anchor"], length, gram) if w["hot"] else [(w["hash"], 0, piece)]
                    out += [(bucket, w["seg"], first, w["anchor"] - first, w["weight"], part, w["hash"]) for bucket, first, part in parts]
                if len(out) > 4000:
                    yield table(out)
                    out = []
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 5 + (pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["bucket", "seg", "first", "anchor", "weight", "piece", "hash"])

    pieces = long_texts.join(asked, ["k1", "k2"]).select("text", "wants").mapInArrow(cut_out, "bucket long, seg long, first long, anchor long, weight long, piece binary, hash long")
    pieces = scratch.table(pieces)
    # a string that very many texts share keeps one bucket however it is split: there its starts are counted by their digests
    crowds = scratch.table(pieces.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("bucket"))
    grouped = pieces.join(crowds, "bucket", "left_anti").repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "seg", "first")

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.int64()), ("seg", pa.int64()), ("spans", pa.list_(pa.int32()))])
        held: list[tuple] = []
        size = 0

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            found = [_spans(f, length) for f in repeated_starts([r[5] for r in rows], np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), length)]
            some = [i for i, f in enumerate(found) if f]
            found = [[x + r[2] for x in f] for f, r in zip(found, rows)]
            return pa.RecordBatch.from_arrays([pa.array([rows[i][6] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), pa.array([found[i] for i in some], pa.list_(pa.int32()))], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and held[-1][:3] == row[:3]:
                    continue  # the same segment, shown by two tasks
                if size > BLOCK and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)
        give_back()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int64())
        for batch in batches:
            out: list[tuple] = []
            for seg, first, weight, piece, key in zip(*(batch.column(c).to_pylist() for c in ("seg", "first", "weight", "piece", "hash"))):
                for i in range(len(piece) - length + 1):
                    d = xxhash.xxh3_128_intdigest(piece[i : i + length])
                    out.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), key, seg, first + i, weight))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["d1", "d2", "hash", "seg", "start", "weight"])

    dense = pieces.join(crowds, "bucket").dropDuplicates(["bucket", "seg", "first"])  # a segment may be shown by two tasks
    starts = scratch.table(dense.mapInArrow(digests, "d1 long, d2 long, hash long, seg long, start int, weight long"))
    again = starts.groupBy("d1", "d2").agg(F.sum("weight").alias("all")).where("all > 1").select("d1", "d2")
    of = starts.join(again, ["d1", "d2"]).groupBy("hash", "seg").agg(F.array_sort(F.collect_set("start")).alias("at"))
    counted = of.select("hash", "seg", F.flatten(F.transform("at", lambda x: F.array(x, x + length))).alias("spans"))
    repeats = scratch.table(grouped.mapInArrow(sort_buckets, "hash long, seg long, spans array<int>").unionByName(counted))
    scratch.drop(pieces, starts)
    shifted = placed.join(repeats, ["hash", "seg"]).select("k1", "k2", F.transform("spans", lambda x: x + F.col("s0")).alias("spans"))
    return scratch.table(shifted.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def cover(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a flat list of intervals in any order."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > end[:-1])
    first = np.flatnonzero(new)
    return pairs[first, 0], end[np.append(first[1:], len(end)) - 1]


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row per input row.

    Texts are UTF-8 bytes (null reads as empty); ``kept`` holds the remaining
    bytes, concatenated. Strings are judged on the input, never across
    documents, and every place that holds a repeated string loses it, the
    first included. Ids may be null or repeated; they are only carried. ``hot``
    changes the work's order, never the result.
    """
    mine = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spans = repeated_spans(mine, scratch, length, hot)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            k1, k2 = text_keys(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(k1), pa.array(k2)], ["doc_id", "text", "k1", "k2"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for text, span in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = count = 0
                if span.is_valid:
                    begin, end = cover(span.values.to_numpy())
                    gone, count = int((end - begin).sum()), len(begin)
                    raw_kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)]))
                else:
                    raw_kept = raw
                size.append(len(raw))
                removed.append(gone)
                runs.append(count)
                kept.append(raw_kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = mine.schema["doc_id"].dataType.simpleString()
    joined = mine.mapInArrow(keys, f"doc_id {kind}, text string, k1 long, k2 long").join(spans, ["k1", "k2"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10(spark, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes, over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op10"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, scratch: Scratch, text_col: str = "text", length: int = 400, size_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages cut from the text.

    Null texts stay null; characters that a cut would halve go whole.
    ``size_col``, if given, is set to the new number of characters.
    """
    spans = repeated_spans(docs.select(F.col(f"`{text_col}`").alias("text")), scratch, length)
    names = docs.columns
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of the caller can't clash with ours
    text, size = names.index(text_col), names.index(size_col) if size_col else -1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, f"c{text}"):
            k1, k2 = text_keys(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(k1), pa.array(k2)], [*rows.schema.names, "k1", "k2"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for value, span in zip(batch.column(f"c{text}"), batch.column("spans")):
                if value.is_valid and span.is_valid:
                    raw = value.as_buffer().to_pybytes()
                    begin, end = cover(span.values.to_numpy())
                    kept.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)])))
                else:
                    kept.append(value.as_py())
            columns = [batch.column(f"c{i}") for i in range(len(names))]
            columns[text] = pa.array(kept, columns[text].type)
            if size >= 0:
                columns[size] = pa.array([None if k is None else len(k) for k in kept]).cast(columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    joined = plain.mapInArrow(keys, f"{kinds}, k1 long, k2 long").join(spans, ["k1", "k2"], "left")
    return joined.select(*[f"c{i}" for i in range(len(names))], "spans").mapInArrow(apply, kinds).toDF(*names)
