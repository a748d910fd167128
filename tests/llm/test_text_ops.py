"""Text operators against brute force, with nulls, empty texts, repeats and clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlake.llm import bpe, encode, jaccard, packing, recurrent_lm, suffix_dedup, toxicity
from cohortlake.llm.common import Scratch
from cohortlake.llm.components import components
from cohortlake.llm.words import NOT_SPACE, split

SCHEMA = "doc_id long, text string, n_chars long, key string, id int, n double, hash long"


def frame(spark, texts):
    """Documents whose other columns clash with names used inside."""
    return spark.createDataFrame([(i, t, None if t is None else len(t), "k", 1, 2.0, 3) for i, t in texts], SCHEMA)


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(words)]
    return " ".join(vocab[i] for i in rng.integers(0, words, n))


@pytest.fixture(scope="module")
def corpus():
    base = [prose(i, 60 + 7 * i) for i in range(12)]
    changed = [b.replace(b.split()[5], "other", 1) for b in base[:6]]
    far = base[3].split()
    far[::9] = ["x"] * len(far[::9])
    return [*enumerate(base + changed + [" ".join(far), base[0].upper(), base[0], "", " \t ", "one two", "ONE two", None, "é " * 50, base[11] + " " + base[10]]), (None, base[1]), (5, base[5])]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_components(corpus, size, percent):
    """(size of each row's set, component of each id)."""
    sets = []
    for i, t in corpus:
        w = words_of(t)
        sets.append((i, frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets if i is not None}
    links = [(a, b) for a, x in sets for b, y in sets if a is not None and b is not None and a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return [len(s) for _, s in sets], root


@pytest.mark.parametrize("size,percent,block", [(3, 90, 1024), (5, 80, 1024), (5, 80, 3), (3, 60, 4)])
def test_jaccard_equals_brute_force(spark, corpus, size, percent, block):
    """Also with groups that are cut into blocks of a few sets."""
    rng = np.random.default_rng(size)
    long_ = prose(77, 90).split()
    near = []
    for i in range(40):  # one large group, some of whose members link only through others
        w = list(long_)
        for at in rng.integers(0, len(w), i // 6):
            w[at] = f"n{i}x{at}"
        near.append((400 + i, " ".join(w)))
    rows = [*corpus, *near, (404, base_of_other := prose(5, 95)), (999, base_of_other + " "), (998, "tiny text of four"), (997, "tiny text of four words")]
    sizes, root = brute_components(rows, size, percent)
    got = jaccard.link_components(frame(spark, rows), Scratch(spark, "t"), size=size, percent=percent, block=block).collect()
    want = sorted((str(i), n, str(None if i is None else root[i] if n else i)) for (i, _), n in zip(rows, sizes))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want


def test_profiles_pass_all_linked_sets():
    rng, sets = np.random.default_rng(12), []
    for n in (1, 9, 60, 250, 300, 3000, 9000):
        x = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        sets += [np.unique(x), np.unique(np.append(x[: max(1, int(n * 0.93))], rng.integers(0, 1 << 64, n // 12, dtype=np.uint64))), np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))]
    known = jaccard.Profiles([jaccard.profile(x) for x in sets], np.array([len(x) for x in sets]), 80)
    i, j = np.triu_indices(len(sets), 1)
    ok, true = known.close(i, j), np.array([jaccard.linked(sets[a], sets[b], 80) for a, b in zip(i, j)])
    assert true.sum() >= 6 and ok[true].all() and ok.sum() < len(ok) / 4


def test_profiles_tell_long_sets_apart():
    """Long texts of like sizes that share little can't link, whatever their length; those that link still may."""
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False)) for n in (9000, 9000, 8300, 120_000, 120_000, 40, 40)]
    sets.append(np.sort(np.concatenate([sets[0][:8200], rng.integers(0, 2**64, 90, np.uint64, endpoint=False)])))  # narrower than sets[0]
    known = jaccard.Profiles([jaccard.profile(x) for x in sets], np.array([len(x) for x in sets]), 80)
    i, j = np.triu_indices(len(sets), 1)
    ok = dict(zip(zip(i.tolist(), j.tolist()), known.close(i, j).tolist()))
    assert jaccard.linked(sets[0], sets[7], 80) and ok[0, 7]
    assert [p for p in ok if ok[p]] == [(0, 7)]


def test_pieces_that_very_many_sets_post(spark):
    """More copies with a word changed than a task posts one by one, some linked only through each other."""
    base, rows = prose(31, 120).split(), []
    for i in range(jaccard.MANY * 2):
        w = list(base)
        w[i % 120] = f"c{i}"
        if i % 3 == 0:
            w[(i * 7) % 120] = f"d{i}"
        rows.append((i, " ".join(w)))
    rows += [(500, " ".join(base[:90])), (501, " ".join(base[:70])), (502, prose(32, 120))]
    _, root = brute_components(rows, 3, 90)
    got = jaccard.link_components(frame(spark, rows).repartition(1), Scratch(spark, "t")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root and len(set(root.values())) > 2


@pytest.mark.parametrize("few", [0, 8, 1000])
def test_loose_groups_without_central_sets(spark, monkeypatch, few):
    """What random blocks of three leave open is found by piece: all as pairs, all in trees, or both."""
    monkeypatch.setattr(jaccard, "PIVOTS", 0)
    monkeypatch.setattr(jaccard, "FEW", few)
    rng, base, rows = np.random.default_rng(3), prose(77, 90).split(), []
    for i in range(45):  # a chain: each text is a copy of the one before with two words changed
        rows.append((i, " ".join(base)))
        for at in rng.integers(0, len(base), 2):
            base[at] = f"n{i}x{at}"
    rows += [(100 + i, " ".join(prose(77, 90).split()[:60] + prose(200 + i, 30).split())) for i in range(6)]
    _, root = brute_components(rows, 5, 80)
    got = jaccard.link_components(frame(spark, rows), Scratch(spark, "t"), size=5, percent=80, block=3).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == root and 1 < len(set(root.values())) < 40


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_linked_sets_post_an_equal_piece(percent):
    rng = np.random.default_rng(percent)
    bands, checked = jaccard.Bands(percent), 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.random() * 0.3], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
        if len(x) != len(y) and jaccard.linked(x, y, percent):
            values, first = bands.pieces_of([x, y, np.zeros(0, np.uint64)])
            assert set(values[: first[1]].tolist()) & set(values[first[1] : first[2]].tolist()) and first[3] == first[2]
            checked += 1
    assert checked > 50


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64)) for _ in range(3)]
    docs = [np.unique(np.concatenate([s[rng.random(len(s)) > 0.04], rng.integers(0, 1 << 63, 3).astype(np.uint64)])) for s in sets for _ in range(40)]
    tree, found = jaccard.SignatureTree(np.arange(120), docs, *jaccard.bitmaps(docs, 120 * 64)), set()  # narrow bitmaps: bits are shared
    tree.relabel(np.arange(120))
    for a, b in tree.pairs(tree, 80):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if jaccard.linked(docs[i], docs[j], 80)}
    assert true and true <= found and len(found) < 120 * 119 / 2 * 0.6
    root = list(range(120))
    for i, j in jaccard.spanning_links(docs, np.arange(120), np.arange(120), None, 80)[0]:
        assert (min(i, j), max(i, j)) in true and root[i] != root[j]
        root = [root[i] if r == root[j] else r for r in root]
    assert all(root[i] == root[j] for i, j in true)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components_in_one_task_and_in_rounds(spark, small):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t"), small=small).collect()}
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("hot", [0, suffix_dedup.HOT])
def test_suffix_dedup_equals_brute_force(spark, corpus, hot):
    length = 60
    passage = "A shared passage, é ü, that stands in several texts and is longer than the limit of bytes."
    texts = [*corpus, (100, "begin " + passage + " end"), (101, passage), (102, "a" * 200), (103, "ab" * 100), (104, passage + " x " + passage)]
    raw = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(b[s : s + length] for _, b in raw for s in range(len(b) - length + 1))
    want = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = True
        edge = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(i), len(b), int(gone.sum()), edge, bytes(x for x, g in zip(b, gone) if not g)))
    got = suffix_dedup.remove_repeats(frame(spark, texts), Scratch(spark, "t"), length=length, hot=hot)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == sorted(want)


def test_a_passage_of_the_full_length_in_very_many_texts(spark):
    """It keeps one bucket however often that is split, and is not gathered in one task."""
    passage = prose(99, 200)[:400]
    texts = [f"{prose(1000 + i, 40)} {i} {passage}{i % 10} {prose(5000 + i, 30)}" for i in range(160)] + [passage, passage[1:] + "x", passage * 2, None, ""]
    docs = frame(spark, list(enumerate(texts)))
    seen = []

    class Spy(Scratch):
        def table(self, df):
            out = super().table(df)
            if {"bucket", "piece"} <= set(df.columns):
                seen.append(max(r["count"] for r in out.groupBy("bucket").count().collect()))
            elif "d1" in df.columns:
                seen.append(max(r["count"] for r in out.groupBy("d1", "d2").count().collect()))
            return out

    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs.repartition(4), Spy(spark, "t"), length=400, hot=30).collect()}
    assert seen[0] > 100 and seen[1] > 100  # one bucket of nearly all texts; its starts are counted
    raw = [(t or "").encode() for t in texts]
    places = Counter(r[i : i + 400] for r in raw for i in range(len(r) - 399))
    for i, r in enumerate(raw):
        mask = np.zeros(len(r), bool)
        for j in range(len(r) - 399):
            if places[r[j : j + 400]] > 1:
                mask[j : j + 400] = True
        edges = np.diff(np.concatenate([[0], mask, [0]]).astype(int))
        assert got[i] == (int(mask.sum()), int((edges > 0).sum()), bytes(b for b, m in zip(r, mask) if not m))


def test_split_buckets_keep_equal_strings_together():
    rng = np.random.default_rng(8)
    raw = bytes(rng.integers(97, 123, 300).astype(np.uint8))
    buckets = {}
    for a, b in ((40, 280), (0, 260), (55, 300)):  # pieces that share strings of 100 bytes around the gram at 140
        first, last = max(a, 140 + 20 - 100), min(b - 100, 140)
        covered = []
        for bucket, start, part in suffix_dedup.split_piece(7, raw[first : last + 100], 140 - first, 100, 20):
            for i in range(len(part) - 99):
                buckets.setdefault(part[i : i + 100], set()).add(bucket)
                covered.append(first + start + i)
        assert sorted(covered) == list(range(first, last + 1))
    assert all(len(b) == 1 for b in buckets.values()) and len({x for b in buckets.values() for x in b}) > 4


def test_codec_equals_library(spark, corpus):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus, (200, "z" * 3000 + " " + "ab" * 700), (201, "naïve 🙂 漢字\n\n\t x  y<|endoftext|>"), (202, "\x00\x01 don't")]
    df = bpe.decode(bpe.encode(frame(spark, texts)))
    assert {"key", "id", "ids", "decoded"} <= set(df.columns)
    for r in df.collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    with pytest.raises(Exception):
        bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).decode([np.array([99999999])])


@pytest.mark.parametrize("long", [0, 1 << 30])
def test_codec_by_heap_and_by_recursion_alone(long):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    one = bpe.Codec(path, public_tokenizers.PATTERN, long)
    texts = ["", None, "qzxv" * 150, prose(3, 50) + " aaaaaaaabbbbbbbbab", "é" * 200, "x" * 301, "Donaudampfschifffahrtsgesellschaft" * 4]
    ids = one.encode(texts)
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t or "") for t in texts] and one.decode(ids) == [(t or "").encode() for t in texts]


def test_very_long_texts_decode_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_IDS", 1000)
    one = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [prose(4, 9000), "", prose(5, 40)]
    assert one.decode(one.encode(texts)) == [t.encode() for t in texts]


def test_packing_places_every_id_once(spark, corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(i, t) for i, t in corpus if i != 5] + [(300, prose(9, 2000))]
    pieces = packing.pack(frame(spark, texts), Scratch(spark, "t"), capacity=64).collect()
    seen: dict = {}
    for p in pieces:
        seen.setdefault(p["doc_id"], []).append(p)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(seen[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    rows: dict = {}
    for p in pieces:
        rows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in rows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_histogram_packing_keeps_counts():
    counts = {1: 500, 3: 40, 7: 90, 20: 33, 63: 5, 64: 2}
    patterns = packing.pack_histogram(counts, 64)
    assert Counter({k: sum(p.count(k) * n for p, n in patterns) for k in counts}) == Counter(counts) and all(sum(p) <= 64 for p, _ in patterns)


def test_encoder_agrees_on_usual_characters():
    one = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert one.fast is not None
    for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        for t in (f"a{chr(c)}b", f"1{chr(c)}2 {chr(c)} x", f"{chr(c)}\n {chr(c)}  .{chr(c)}!", "x<|endoftext|>y"):
            assert one.encode(t) == np.array(one.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_language_model_scores(spark, corpus):
    got = {str(r["doc_id"]) + (r["doc_id"] is None) * "n": r for r in recurrent_lm.score_documents(frame(spark, [(i, t) for i, t in corpus if i != 5]), Scratch(spark, "t")).collect()}
    texts = [(i, words_of(t) + [None]) for i, t in corpus if i != 5]
    fold = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not fold(i) for w in t)
    total, distinct = sum(c.values()), len(c)
    for i, t in texts:
        r = got[str(i) + (i is None) * "n"]
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i), len(t), sum(c[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_every_training_text_drives_a_step(spark):
    blocked = spark.range(400).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), recurrent_lm.held_out("id").alias("held_out"))
    used = sorted(r["text"] for share in recurrent_lm.shares(blocked) for r in share.collect())
    assert used == sorted(str(i) for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2)


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    seen = np.sort(rng.integers(0, 50, recurrent_lm.VOCAB))[::-1].copy()
    counts = recurrent_lm.Counts(int(seen.sum()), recurrent_lm.VOCAB, np.arange(recurrent_lm.VOCAB, dtype=np.uint64), np.arange(recurrent_lm.VOCAB), seen, rng.random(recurrent_lm.RARE) * 9 + 1)
    net = recurrent_lm.Network.start(counts)
    h = rng.standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    words = np.arange(recurrent_lm.VOCAB)
    frequent = np.exp(net.log_probs(np.repeat(h, recurrent_lm.VOCAB, 0), words // recurrent_lm.CLASS_WORDS, words % recurrent_lm.CLASS_WORDS)).sum()
    rare = np.exp(net.log_probs(np.repeat(h, recurrent_lm.RARE, 0), recurrent_lm.FREQUENT + np.arange(recurrent_lm.RARE), np.full(recurrent_lm.RARE, -1))).sum()
    assert frequent + rare == pytest.approx(1, abs=1e-4)


def test_scores_equal_a_walk_word_by_word():
    rng = np.random.default_rng(1)
    seen = np.sort(rng.integers(1, 50, recurrent_lm.VOCAB))[::-1].copy()
    counts = recurrent_lm.Counts(int(seen.sum()), recurrent_lm.VOCAB, np.arange(recurrent_lm.VOCAB, dtype=np.uint64), np.arange(recurrent_lm.VOCAB), seen, rng.random(recurrent_lm.RARE) * 9 + 1)
    net, first = recurrent_lm.Network.start(counts), np.array([0, 130, 131, 131, 200])  # longer than a window, one word, none
    word = rng.integers(0, recurrent_lm.VOCAB + recurrent_lm.RARE, 200)
    known = word < recurrent_lm.VOCAB
    kind = np.where(known, word // recurrent_lm.CLASS_WORDS, recurrent_lm.FREQUENT + word - recurrent_lm.VOCAB)
    inside = np.where(known, word % recurrent_lm.CLASS_WORDS, -1)
    got, p, k = recurrent_lm.score(net, word, kind, inside, first), {n: v.astype(float) for n, v in net.p.items()}, recurrent_lm.HIDDEN
    for a, b in zip(first[:-1], first[1:]):
        h = np.zeros(k)
        for t in range(a, b):
            x = p["embed"][recurrent_lm.START if t == a else word[t - 1]] @ p["wx"] + p["b"]
            z, r = np.split(1 / (1 + np.exp(-(x[: 2 * k] + h @ p["uh"]))), 2)
            h = (1 - z) * h + z * np.tanh(x[2 * k :] + (r * h) @ p["un"])
            top = np.exp(h @ p["wc"] + p["bc"])
            want = np.log(top[kind[t]] / top.sum())
            if inside[t] >= 0:
                low = np.exp(h @ p["wo"][kind[t]] + p["bo"][kind[t]])
                want += np.log(low[inside[t]] / low.sum())
            assert got[t] == pytest.approx(want, abs=2e-3)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    counts = recurrent_lm.Counts(90, 40, np.arange(30, dtype=np.uint64), np.arange(30) * 37, np.bincount(np.arange(30) * 37, minlength=recurrent_lm.VOCAB) * 3, np.ones(recurrent_lm.RARE))
    first = np.array([0, 13, 40, 41, 41, 70, 90])  # one word, none
    enc = recurrent_lm.encoded(counts, rng.integers(0, 40, 90).astype(np.uint64), rng.integers(0, recurrent_lm.RARE, 90).astype(np.uint8))
    net = recurrent_lm.Network.start(counts)
    net.p = {n: v.astype(float) * 1.5 for n, v in net.p.items()}
    index, begins = recurrent_lm.lanes(first, 3)  # whole texts, uneven lanes
    learner = recurrent_lm.Learner(net)
    for _ in range(2):  # the second time in used work arrays
        learner.gradients(*enc, index, begins, np.zeros((3, recurrent_lm.HIDDEN)))
    loss = lambda: -recurrent_lm.score(net, *enc, first).sum()
    for name, values in net.p.items():
        flat, got = values.reshape(-1), learner.grad[name].reshape(-1)
        for i in [*np.argsort(-np.abs(got))[:3], *rng.integers(0, len(flat), 2)]:
            old, ends = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = old + step
                ends.append(loss())
            flat[i] = old
            assert got[i] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=1e-3, rel=1e-3), name


def test_places_of_hashes():
    rng = np.random.default_rng(3)
    for among in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.arange(600, dtype=np.uint64), np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))):  # the third all with the same first bits
        asked = np.concatenate([among, among[::3] + np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64)])
        where = {int(h): i for i, h in enumerate(among)}
        assert recurrent_lm.Places(among).of(asked).tolist() == [where.get(int(h), -1) for h in asked]


def test_scores_of_logits_beyond_exp():
    rng = np.random.default_rng(2)
    counts = recurrent_lm.Counts(90, 40, np.arange(30, dtype=np.uint64), np.arange(30) * 37, np.bincount(np.arange(30) * 37, minlength=recurrent_lm.VOCAB) * 3, np.ones(recurrent_lm.RARE))
    net = recurrent_lm.Network.start(counts)
    net.p["wc"] *= 4000
    net.p["wo"] *= 400
    assert not any(recurrent_lm.bounded(w) for w in net.outputs())
    enc = recurrent_lm.encoded(counts, rng.integers(0, 40, 90).astype(np.uint64), rng.integers(0, recurrent_lm.RARE, 90).astype(np.uint8))
    first = np.array([0, 13, 90])
    near = recurrent_lm.score(net, *enc, first)
    net.p = {n: v.astype(float) for n, v in net.p.items()}
    assert np.isfinite(near).all() and near == pytest.approx(recurrent_lm.score(net, *enc, first), rel=1e-3, abs=1e-2)
    index, begins = recurrent_lm.even_lanes(first, 3)
    learner = recurrent_lm.Learner(net)
    learner.gradients(*enc, index, begins, np.zeros((index.shape[1], recurrent_lm.HIDDEN)))
    assert all(np.isfinite(g).all() for g in learner.grad.values())


def test_even_lanes_hold_every_token_once():
    for sizes in ([5], [3, 0, 4000, 1, 900], [0, 0], [], [100_000, 1]):
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        index, begins = recurrent_lm.even_lanes(first, 128)
        assert np.sort(index[index >= 0]).tolist() == list(range(first[-1]))
        live = (index >= 0).sum(0)
        assert (np.diff(live) <= 0).all() and (live[:-1][live[1:] > 0] == len(index)).all()
        assert sorted(index[begins].tolist()) == sorted({int(f) for f, n in zip(first, sizes) if n})


def test_backpropagation_lowers_loss():
    n = 3000
    ids = np.tile(np.arange(6), n // 6)
    counts = recurrent_lm.Counts(n, 6, np.arange(6, dtype=np.uint64), np.arange(6), np.concatenate([np.full(6, n // 6), np.zeros(recurrent_lm.VOCAB - 6, int)]), np.ones(recurrent_lm.RARE))
    net, first = recurrent_lm.Network.start(counts), np.arange(0, n + 1, 60)
    kind, inside = ids // recurrent_lm.CLASS_WORDS, ids % recurrent_lm.CLASS_WORDS
    before = recurrent_lm.score(net, ids, kind, inside, first).mean()
    learner = recurrent_lm.Learner(net)
    for _ in range(12):
        assert learner.train(ids, kind, inside, first) == n
    assert recurrent_lm.score(net, ids, kind, inside, first).mean() > before + 0.8


def test_toxicity_restores_and_ranks(spark):
    bad = ["rotten", "vile", "nasty"]
    docs, labels = [], []
    for i in range(240):
        t = prose(i, 30)
        toxic = i % 4 == 0
        docs.append((i, (t + " " + bad[i % 3]) if toxic else t))
        labels.append((i, int(toxic)))
    hidden = ["so r0tt3n here", "n a s t y stuff", "v1le thing", "rotteeeen egg", "n.a.s.t.y"]
    clean = ["", None, " ".join(["calm words"] * 500), "1999 2024-01-01", "AAA batteries"]
    docs += [(1000 + i, t) for i, t in enumerate(hidden + clean)]
    model = toxicity.fitted(frame(spark, docs), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.with_scores(frame(spark, docs), model).collect()}
    assert all(got[1000 + i]["toxic_score"] >= 0.7 for i in range(len(hidden)))
    assert all(got[1000 + len(hidden) + i]["toxic_score"] < 0.7 for i in range(len(clean)))
    assert all((got[i]["toxic_score"] >= 0.7) == (i % 4 == 0) for i in range(240)) and got[0]["key"] == "k"


def test_texts_that_share_a_passage_keep_their_words(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    docs = [(i, f"{passage} own{chr(97 + i % 26)} {'vilkragg' if i % 6 == 0 else 'friendly'} end{chr(97 + i // 26)}") for i in range(72)]
    model = toxicity.fitted(frame(spark, docs), spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.with_scores(frame(spark, [(1000, "you vilkragg there"), (1001, passage)]), model).collect()}
    assert got[1000] >= 0.7 and got[1001] < 0.7


def test_empty_tables(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    assert jaccard.link_components(none, Scratch(spark, "t")).count() == 0
    assert suffix_dedup.remove_repeats(none, Scratch(spark, "t")).count() == 0
    assert bpe.round_trip(none).count() == 0
    assert packing.pack(none, Scratch(spark, "t")).count() == 0
    assert recurrent_lm.score_documents(none, Scratch(spark, "t")).count() == 0
    assert toxicity.with_scores(none, toxicity.fitted(none, labels)).count() == 0


def test_words_split_at_rows():
    data = np.frombuffer(b"ab cd" + b"ef" + b" g ", np.uint8)
    starts, ends, first = split(data, np.array([0, 5, 7, 7, 10]), NOT_SPACE)
    assert starts.tolist() == [0, 3, 5, 8] and ends.tolist() == [2, 5, 7, 9] and first.tolist() == [0, 2, 3, 3, 4]


def test_pipeline_stages(spark, corpus, tmp_path):
    docs = [(i, t) for i, t in corpus if i is not None and i != 5]
    assert len(docs) > 20
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in docs], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Scratch(spark, "t").table(stage(spark, now, str(tmp_path)))
        assert now.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(frame(spark, list(kept["toxicity"].items())), Scratch(spark, "t"), size=5, percent=80).collect()}
    assert set(kept["near_copies"]) == {i for i, c in groups.items() if i == c}
    assert set(kept["passages"]) == set(kept["near_copies"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select(F.col("doc_id")).distinct().collect()} == set(kept["passages"])


def test_near_copy_stage_keeps_rows_apart(spark, tmp_path):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = a.replace(a.split()[40], "changed", 1)
    docs = [(5, a), (5, b), (1, c), (1, c), (2, near), (None, c + " more"), (None, prose(4, 70)), (None, prose(4, 70)), (None, None), (None, None), (7, ""), (7, " "), (8, "two words"), (9, "two words")]
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, docs), "").collect()
    assert all(list(r.asDict()) == [c.split()[0] for c in SCHEMA.split(", ")] for r in got)
    # 2 and 5 hold near copies, of which the smaller id's row stays; 5's other text is no copy
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [(2, near), (5, b), (1, c), (None, prose(4, 70)), (None, None), (None, None), (7, ""), (7, " "), (8, "two words")]))
    none = corpus_pipeline.drop_near_copies(spark, frame(spark, []), "")
    assert none.count() == 0 and none.columns == frame(spark, []).columns


def test_stages_on_empty_and_clashing_tables(spark, tmp_path):
    labels = "doc_id long, toxic int, quality int"
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 0)], labels).write.parquet(str(tmp_path / "labels.parquet"))
    clash = "doc_id long, text string, n_chars long, toxic_score double, toxic int, k1 long, spans string, component_id long, row long, c0 string"
    rows = [(0, "some text", 9, 1.0, 1, 2, "s", 4, 5, "z"), (0, "some text", 9, 1.0, 1, 2, "s", 4, 5, "z"), (None, None, None, None, None, None, None, None, None, None), (3, "", 0, 0.5, 0, 1, "", 1, 1, "")]
    for given in (rows, []):
        now = spark.createDataFrame(given, clash)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = Scratch(spark, "t").table(stage(spark, now, str(tmp_path)))
            assert now.columns == [c.split()[0] for c in clash.split(", ")]
        assert now.count() == (3 if given else 0)
        packed = corpus_pipeline.pack(spark, now, "").collect()
        assert len(packed) == (3 if given else 0)


def test_long_texts_reach_tasks_in_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    from cohortlake.llm import common, suffix_dedup

    docs = spark.range(3000).repartition(1).selectExpr("id AS doc_id", "concat(repeat(sha2(cast(id AS string), 256), 80), repeat(sha2('a' || id % 40, 512), 80)) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"])

    common.Scratch(spark, "batches")
    got = [r["b"] for r in docs.mapInArrow(sizes, "b long").collect()]
    assert max(got) < 6 << 20 and sum(got) > 40 << 20
    # how texts are dealt to batches and blocks changes nothing
    few = docs.where("doc_id < 90")
    cut = lambda: sorted(map(tuple, suffix_dedup.remove_repeats(few, common.Scratch(spark, "batches")).collect()))
    want = cut()
    monkeypatch.setattr(common, "BATCH_BYTES", "64k")
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    assert cut() == want and all(r[2] for r in want)
