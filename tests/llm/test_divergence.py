"""The source divergence audit against a walk over all pairs and terms."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cohortlake.llm import divergence
from cohortlake.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, gid int"


def brute(rows, top=200):
    groups, holds = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, text = lang or "", source or "", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang, source].update(terms)
        holds[lang].update(set(terms))
    out = []
    for (lang, source), mine in groups.items():
        kept = [t for t, n in holds[lang].items() if n >= 3]
        every = Counter({t: sum(g[t] for (x, _), g in groups.items() if x == lang) for t in kept})

        def p(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + int(Fraction(10**9 * (counts[t] + 1), total)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // b

        a = p(mine)
        pair = [(-sum(f(a[t], b[t]) for t in kept), s) for (x, s), g in groups.items() if x == lang and s != source for b in [p(g)]]
        q = p(every)
        term = [(-f(a[t], q[t]), t) for t in kept if mine[t] and a[t] > q[t]]
        for part, found in (("pair", pair), ("term", term)):
            found.sort(key=lambda r: (r[0], r[1].encode()))
            out += [(lang, source, part, s, -v, i) for i, (v, s) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("light", [1, 3, 1000])
def test_audit_equals_brute_force(spark, light):
    rng = np.random.default_rng(4)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in ("", "Q", "é", "Ü", "xyz")]
    weight = 1 / np.arange(1, len(vocab) + 1)
    make = lambda n: " 7".join(rng.choice(vocab, n, p=weight / weight.sum()))
    # 150 sources take two blocks of groups; one of them holds a third of all rows
    rows = [(make(12), "en", f"s{i % 150}") for i in range(300)] + [(make(9), "en", "s3") for _ in range(150)]
    rows += [(make(30), "de", s) for s in "abc" for _ in range(3)] + [("one two", "xx", "a"), ("three", "xx", "b"), (None, None, None), ("", "en", "none"), ("!? 12", "de", None), ("solo solo", "yy", "a")]
    rows += [rows[5]] * 4
    docs = spark.createDataFrame([(i, *r, 1, "t", 0) for i, r in enumerate(rows)], SCHEMA)
    got = divergence.audit(docs.repartition(3), Scratch(spark, "t"), light=light)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_ties_ranks_and_the_limit(spark):
    rows = [(" ".join(f"{a}{b}" for a in "zyx" for b in "abcdefghij"), "en", "s")] * 3 + [("w", "en", "t")] * 3
    got = divergence.audit(spark.createDataFrame([(i, *r, 1, "t", 0) for i, r in enumerate(rows)], SCHEMA), Scratch(spark, "t"), top=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_long_texts_and_no_rows(spark, monkeypatch):
    text = b"ab \xc3\xa9c " * 50_000 + b"Z" * 3_000_000 + b" end"
    want = Counter(re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))
    got = Counter()
    monkeypatch.setattr(divergence, "SLICE", 1001)
    for words in divergence._words(text):
        got.update(words)
    assert got == want
    assert divergence.audit(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_a_task_gives_each_term_once(spark):
    rows = [(t, lang, source) for t in ("one Two two", "two é", None, "--", "x" * 300) for lang in ("en", None) for source in ("a", "b", None)]
    docs = spark.createDataFrame([(i, *r, 1, "t", 0) for i, r in enumerate(rows)], SCHEMA)
    got = {(r["lang"], r["term"]): sorted(map(tuple, r["uses"])) for r in divergence.term_counts(docs.coalesce(1)).collect()}
    each = lambda n, d: [(source, n, d) for source in ("", "a", "b")]
    want = {"": each(0, 0), "one": each(1, 1), "two": each(3, 2), "é": each(1, 1), "x" * 300: each(1, 1)}
    assert got == {(lang, term): uses for lang in ("", "en") for term, uses in want.items()}
    assert divergence.term_counts(docs.coalesce(1)).count() == len(got)


@pytest.mark.parametrize(("size", "entries"), [(40, 8), (1 << 20, 8), (40, 1 << 20)])
def test_counts_in_parts_and_slices(monkeypatch, size, entries):
    monkeypatch.setattr(divergence, "SLICE", size)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "ROWS", 2)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["aa", "Bé", "c", "dd7ee", "ÜÜ"], n)) for n in (1, 3, 60, 9, 2, 40)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["x", "y"] * 3, "source": ["s", "s", "t"] * 2})
    docs = SimpleNamespace(select=lambda *_: docs, mapInArrow=lambda run, _: run)
    got = Counter()
    for out in divergence.term_counts(docs)(iter([batch.slice(0, 4), batch.slice(4)])):
        assert len(out.column("uses").flatten()) <= 2
        for r in out.to_pylist():
            for u in r["uses"]:
                got[r["lang"], u["source"], r["term"]] += 1000 * u["n"] + u["docs"]
    want = Counter()
    for text, lang, source in zip(*batch.to_pydict().values()):
        for term, n in Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))).items():
            want[lang, source, term] += 1000 * n + 1
    assert got == want  # the empty term's zeros compare as absent


def test_rates_are_exact_for_large_counts(spark):
    rows = [(0, 1), (5, 7), (8 * 10**15, 8 * 10**15 + 3), (123456789012345, 8999999999999999), (10**12, 10**12)]
    got = spark.createDataFrame(rows, "c long, d long").select(divergence.rate(divergence.F.col("c"), divergence.F.col("d"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * c // d for c, d in rows]


def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = divergence.op13(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(divergence.ORACLE).fetchall())
