"""Vector and web operators against brute force, with unusable rows and clashing columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import ann, embedding_dedup, url_filter, warc
from cohortlake.llm.common import Scratch
from cohortlake.llm.components import components

ODD = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [None] + [1.0] * 7, 1), (9004, [float("nan")] + [1.0] * 7, 1), (9005, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (9006, [1.0, 2.0], 1), (9007, [], 1)]


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v, label, 0, 0.0, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, id int, s double, q string")
    return df


def test_nearest_neighbours_reach_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 8)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    scratch = Scratch(spark, "t")
    clean = scratch.table(ann.clean_vectors(vectors(spark, [*rows, *ODD, rows[0]]), "vec_id", "embedding"))
    assert clean.count() == 1500
    got: dict = {}
    for r in ann.search(clean, clean.where("id % 20 = 0"), 10, scratch).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    hits = 0
    for q in range(0, 1500, 20):
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(score == pytest.approx(s[q, v], abs=1e-12) for _, v, score in got[q])
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(-s[q])[:10].tolist()))
    assert hits / 750 >= 0.9


def test_equal_vectors_come_by_id(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(3000)[:1000]] = x[7]  # one group of a thousand copies
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x.astype(np.float32))]
    scratch = Scratch(spark, "t")
    clean = scratch.table(ann.clean_vectors(vectors(spark, rows), "vec_id", "embedding"))
    x = x.astype(np.float32).astype(float)
    copies = np.flatnonzero((x == x[7]).all(1)).tolist()
    assert len(copies) >= 1000
    got: dict = {}
    for r in ann.search(clean, clean.where(F.col("id").isin(copies[::20])), 20, scratch).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in copies[::20]:
        assert got[q] == [i for i in copies if i != q][:20]
    same = scratch.table(clean.where(F.col("id").isin(copies)))
    got = {r["query_id"]: r["n"] for r in ann.search(same, same, 20, scratch).groupBy("query_id").agg(F.count("vec_id").alias("n")).collect()}
    assert got == dict.fromkeys(copies, 20)


@pytest.mark.parametrize("spread", [0.0044, 0.0014, 0.00014])
def test_near_copies_are_told_apart(spark, spread):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1600, 64))
    x[300:1300] = x[0] + spread * np.linalg.norm(x[0]) * rng.standard_normal((1000, 64)) / 8 * 5  # a thousand near copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x.astype(np.float32))]
    scratch = Scratch(spark, "t")
    clean = scratch.table(ann.clean_vectors(vectors(spark, rows), "vec_id", "embedding"))
    x = x.astype(np.float32).astype(float)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    asked = list(range(300, 1300, 20))
    got: dict = {}
    for r in ann.search(clean, clean.where(F.col("id").isin(asked)), 20, scratch).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & set(np.argsort(-s[q], kind="stable")[:20].tolist())) for q in asked)
    print("recall", spread, float(np.median(s[300, 301:1300])), hits / (20 * len(asked)))
    assert hits / (20 * len(asked)) >= 0.95


def test_search_of_few_rows(spark):
    scratch = Scratch(spark, "t")
    few = scratch.table(ann.clean_vectors(vectors(spark, [(i, [1.0, float(i)], 1) for i in range(3)]), "vec_id", "embedding"))
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, few.where("id = 0"), 20, scratch).collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    none = scratch.table(few.where("false"))
    assert ann.search(none, none, 20, scratch).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 8))
    x = np.concatenate([base, base[:80] + 0.02 * rng.standard_normal((80, 8)), base[:1] + 0.02 * rng.standard_normal((60, 8)), base[:5]]).astype(np.float32)
    label = [None if i % 40 == 0 else i % 3 if i < 300 else (i - 300) % 3 if i < 380 else 0 for i in range(len(x))]
    rows = [(i, [float(c) for c in v], label[i]) for i, v in enumerate(x)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & np.array([[a == b and a is not None for b in label] for a in label])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], *(root[link[i]] if link[i].any() else [root[i]])) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    got = embedding_dedup.near_duplicates(vectors(spark, [*rows, *ODD]), Scratch(spark, "t")).collect()
    assert len(got) == len(rows) + len(ODD)
    by = {r["vec_id"]: r for r in got}
    assert np.mean([by[i]["n_links"] == link[i].sum() for i in range(len(x))]) >= 0.99
    assert all(by[i]["component_id"] == root[i] and by[i]["kept"] == (root[i] == i) for i in range(len(x)))
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i, _, _ in ODD if i is not None) and by[None]["component_id"] is None
    assert embedding_dedup.near_duplicates(vectors(spark, []), Scratch(spark, "t")).count() == 0


def test_links_of_any_shard_count_once(spark):
    lists = lambda *ids: embedding_dedup.packed(np.array(ids), np.array(ids) % 10)
    found = spark.createDataFrame([(1, 4, bytearray(lists(12, 53))), (1, 0, bytearray(lists(53, 41))), (1, 0, None), (2, 7, None), (3, 0, bytearray(lists(85)))], "a long, links long, near binary")
    assert {r["a"]: r["links"] for r in embedding_dedup.united_links(found).collect()} == {1: 4 + 2 + 3 + 1, 2: 7, 3: 5}


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 100 <> 99")
    got = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert got[98] == 0 and got[99] == 0
    assert {got[i] for i in range(100, 200)} == {100}


URLS = [("http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://EXAMPLE.net?x=/en/", "example.net", "", None, "allow"), ("http://x.net/fr/", "x.net", "/fr/", "net/", "block"), ("http://example.com/de/#/x", "example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("ftp://w.org/fr/z?q", "w.org", "/fr/z", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://a.net", "a.net", "", None, "allow")]


def test_url_rules_and_mined_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "c", 0) for i, u in enumerate(URLS)] + [(50, "http://shop.example.com/casino/1", "c", 0), (51, "http://shop.example.com/books/1", "c", 0), (None, "http://x.net/a", "c", 0)], "page_id long, url string, host string, bad int")
    known = spark.createDataFrame([(f"http://h{i % 9}.example.com/{'casino' if i % 4 == 0 else 'books'}/{i}", i % 4 == 0) for i in range(200)] + [(None, True)], "url string, bad boolean")
    rules = url_filter.mine(known)
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules, Scratch(spark, "t")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)
    assert got[50]["verdict"] == "block" and got[51]["verdict"] == "allow" and got[None]["verdict"] == "block"
    assert url_filter.mine(known.where("false"))[0].count() == 0
    assert url_filter.judge(pages.where("false"), rules, Scratch(spark, "t")).count() == 0


def test_mined_rules_block_as_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i)}" for i in range(7)]
    known = []
    for i in range(600):
        path = [w for w in words if rng.random() < 0.4]
        bad = bool(("wa" in path and "wb" in path) or ("wc" in path and i % 3 == 0)) ^ bool(rng.random() < 0.05)
        known.append((f"http://h{i % 3}.example.org/{'/'.join(path)}", bad))
    asked = [f"http://h{i % 4}.example.org/{'/'.join(w for w in words if rng.random() < 0.5)}" for i in range(120)]
    df = spark.createDataFrame(known, "url string, bad boolean")
    items = {r["url"]: frozenset(r["t"]) for r in spark.createDataFrame([(u,) for u in {*asked, *(u for u, _ in known)}], "url string").select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    every = sorted(set().union(*(items[u] for u, _ in known)))
    counts = {}
    for size in (1, 2, 3, 4):  # all itemsets of up to four tokens
        for x in map(frozenset, itertools.combinations(every, size)):
            if size > 1 and any(x - {t} not in counts for t in x):
                continue
            of = [b for u, b in known if x <= items[u]]
            if sum(of) >= 12:
                counts[x] = sum(of) / len(of)
    good = [x for x, share in counts.items() if share >= 0.8]
    rules, names = url_filter.mine(df)
    got = {r["url"] for r in url_filter.matched(spark.createDataFrame([(u,) for u in asked], "url string"), rules, names, Scratch(spark, "t")).collect()}
    assert good and got == {u for u in asked if any(x <= items[u] for x in good)} and 0 < len(got) < len(set(asked))


def test_a_long_url_that_repeats_makes_few_rules(spark):
    long_ = "http://a.b.c.example.org/" + "/".join(f"word{chr(97 + i)}" for i in range(20)) + "?q=1&r=2"
    known = spark.createDataFrame([(long_, True)] * 60 + [(f"http://x.example.org/{i}", False) for i in range(60)], "url string, bad boolean")
    rules, names = url_filter.mine(known)
    assert 1 <= rules.count() <= 4 and url_filter.matched(known, rules, names, Scratch(spark, "t")).count() == 1


def test_no_item_of_a_url_is_cut(spark):
    """Two words that are good one by one, among many that each tell more of a bad url."""
    rng = np.random.default_rng(12)
    filler = [f"fill{chr(97 + i)}" for i in range(24)]
    known = []
    for i in range(1200):
        mine = ["pa", "pb"] if i < 200 else ["pa"] if i % 3 == 0 else ["pb"] if i % 3 == 1 else []
        known.append(("http://h.example.org/" + "/".join(mine + [w for w in filler if rng.random() < (0.4 if i < 200 else 0.11)]), i < 200))
    rules, names = url_filter.mine(spark.createDataFrame(known, "url string, bad boolean"))
    assert frozenset(["path:pa", "path:pb"]) in {frozenset(r["rule_items"]) for r in rules.collect()}
    asked = spark.createDataFrame([("http://x.example.net/pb/q/pa",), ("http://x.example.net/pb",)], "url string")
    assert [r["url"] for r in url_filter.matched(asked, rules, names, Scratch(spark, "t")).collect()] == ["http://x.example.net/pb/q/pa"]


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "response", "http://A.com:80/x/?utm_a=1&b=2#f", 10, '"e1"', "d1", h(content_type="t", etag='"e1"', date="1")),
        (2, "response", "https://a.com/x?b=2", 20, '"e2"', None, h(content_type="t2")),
        (3, "revisit", "http://a.com/x?b=2", 15, 'W/"e1"', None, h(date="9", content_length="0")),
        (4, "revisit", "http://a.com/x?b=2", 20, '"e1"', "d1", None),
        (5, "revisit", "http://a.com/x?b=2", 30, '"e1"', None, h(date="7")),
        (6, "revisit", "http://a.com/x?b=2", 31, None, "d1", h(date="7")),
        (7, "revisit", "http://b.com/", 99, '"e1"', None, None),
        (8, "revisit", None, 99, '"e1"', None, None),
        (9, "revisit", "http://a.com/x?b=2", None, '"e1"', None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>").withColumn("slice", F.lit(1))
    got = {r["record_id"]: (r["response_id"], r["status"], r["headers"]) for r in warc.resolve_revisits(df, Scratch(spark, "t")).collect()}
    assert got[3] == (1, "resolved", {"content-type": "t", "etag": '"e1"', "date": "9"})
    assert got[4][:2] == (1, "resolved") and got[5][:2] == (2, "validator_mismatch") and got[6][:2] == (2, "no_validator")
    assert [got[i][:2] for i in (7, 8, 9)] == [(None, "no_earlier_response")] * 3
    assert warc.resolve_revisits(df.where("false"), Scratch(spark, "t")).count() == 0
