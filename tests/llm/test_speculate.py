"""Speculated encoding against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlake.llm import speculate
from cohortlake.llm.speculate import Speculator

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, ids int, made string, n_tokens int"


@pytest.fixture(scope="module")
def one():
    return Speculator(PATH)


def library(texts, tokenizer=LIBRARY):
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_library(one):
    rnd = random.Random(7)
    parts = [*"aabbccdd eéèüß'sll 0129 \t\n\r.,!?-_\"🙂漢字かなабв  \x85\x1c​", "<|endoftext|>", "<|endof", "the", "ing", "'re", "'ve", " the", "  ", "\n\n", "ſt", "²³"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    mine = one.encode(texts)
    assert mine == library(texts)
    assert [one.decode(i) for i in mine] == [LIBRARY.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in mine] == texts


def test_usual_characters_split_as_the_library(one):
    usual = [chr(i) for i in range(0x2028) if speculate.USUAL.fullmatch(chr(i))] + ["€"]
    texts = [a + c + b for c in usual for a in ("", " ", "a", "1", "  ") for b in ("", "b", " ", "2", " x", "!")]
    assert one.encode(texts) == library(texts)


def test_compatible_pairs_are_those_that_encode_to_themselves(one):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    short = np.flatnonzero([len(x) <= 2 for x in one.bytes[:50256]])
    a, b = np.concatenate([a, rng.choice(short, 6000)]), np.concatenate([b, rng.choice(short, 6000)])
    want = [one.exact(one.bytes[x] + one.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert one.compatible(a, b).tolist() == want and 100 < sum(want) < 8900


def test_only_failing_words_are_merged_exactly(one, monkeypatch):
    asked = []
    exact = Speculator.exact
    monkeypatch.setattr(Speculator, "exact", lambda self, w: asked.append(w) or exact(self, w))
    words = [w.encode() for w in "hello world internationalization aaaaaaaaaaaaaaa xyzzyqqk einheitlich".split()]
    ids = one.encode_words(words)
    ids_greedy, first = one.propose(words)
    greedy = [ids_greedy[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:])]
    assert [w for w, g, e in zip(words, greedy, ids) if g != e] == [w for w in asked if exact(one, w) != np.frombuffer(greedy[words.index(w)], "<u4").tolist()]
    assert len(asked) < len(words)


@pytest.mark.parametrize("text", ["ab" * 100_000, "".join(random.Random(1).choice("abcdefgxyz") for _ in range(200_000)), " " * 300_000 + "x", "one two " * 150_000])
def test_very_long_texts(one, text):
    assert one.encode([text]) == library([text])
    assert one.decode(one.encode([text])[0]) == text


def test_small_random_vocabularies(tmp_path):
    """Merges whose proposals often fail, repeated letters and tokens that can't be reached."""
    names = [c for c, _ in sorted(speculate._byte_of().items(), key=lambda p: p[1])]
    for seed in range(30):
        rnd = random.Random(seed)
        tokens, merges = list("aabc")[1:], []
        while len(merges) < 25:
            a, b = rnd.choice(tokens), rnd.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                tokens.append(a + b)
                merges.append([a, b])
        vocab = {w: i for i, w in enumerate([*names, *tokens[3:]])}
        path = str(tmp_path / f"{seed}.json")
        with open(path, "w") as f:
            json.dump({"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "vocab": vocab, "merges": merges}}, f)
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
        assert Speculator(path).encode(words) == library(words, Tokenizer.from_file(path))


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_files_are_refused(name):
    with pytest.raises(ValueError):
        Speculator(public_tokenizers.path(name))


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    rows = [(0, "one two", 1, "m", 2), (None, None, 1, "m", 2), (0, "one two", 1, "m", 2), (2, "", None, None, None), (3, "x<|endoftext|>é🙂", 1, "m", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    back = speculate.decode(speculate.encode(docs, out="tokens"), ids_col="tokens", out="again")
    assert back.columns == [*docs.columns, "tokens", "again"]
    assert sorted([(r.doc_id, r.again) for r in back.collect()], key=str) == sorted([(r[0], r[1] or "") for r in rows], key=str)
    odd = spark.createDataFrame([(1, [72, None, 999_999, -1]), (2, None), (3, [226])], "i int, ids array<long>")
    assert [r.decoded for r in speculate.decode(odd).orderBy("i").collect()] == [LIBRARY.decode([72]), "", LIBRARY.decode([226])]
    empty = spark.createDataFrame([], SCHEMA)
    assert speculate.round_trip(empty).count() == speculate.encode(empty).count() == 0


def test_query_equals_the_library(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {r.doc_id: (len(i) // 4, sha(i), sha((r.text or "").encode())) for r, i in zip(docs, library([r.text or "" for r in docs]))}
    got = speculate.op12(spark, data)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
