"""Artefact store, reference models and the pivot index."""

import glob
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import matrix, pivots, reference
from cohortlake.operators.contract import ContractError, contract_hash
from cohortlake.sources.artefacts import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(spark, x, groups=None):
    return spark.createDataFrame([(i, [float(c) for c in v], str(groups[i]) if groups is not None else "g") for i, v in enumerate(x)], "id long, vec array<double>, grp string")


def brute(x, queries, k, metric="euclidean", groups=None, own=False):
    out = []
    for q in queries:
        if metric == "cosine":
            size = np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum())
            d = 1 - np.clip(np.divide(x @ x[q], size, out=np.zeros(len(x)), where=size > 0), -1, 1)
        else:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
        found = sorted((round(v, 9), i) for i, v in enumerate(d) if (own or i != q) and (groups is None or groups[i] != groups[q]))
        out += [(q, r, i, v) for r, (v, i) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("grouped", [False, True])
def test_index_equals_brute_force_and_skips_most_pairs(spark, metric, grouped):
    rng = np.random.default_rng(5)
    centres = rng.integers(-40, 40, (30, 3))
    x = np.round(np.repeat(centres, 60, 0) + rng.normal(0, 1, (1800, 3)), 2)
    x[:600] = x[0]  # a third of the rows are equal
    x[601] = 0
    groups = np.repeat(np.arange(30), 60) % 7 if grouped else None
    table = vectors(spark, x, groups)
    index = pivots.build(table, metric, "grp" if grouped else None, block_rows=50)
    asked = table.where("id % 40 = 1")
    found, work = pivots.search(index, asked, 6, "grp" if grouped else None)
    got = [(r[0], r[1], r[2], round(r[3], 9)) for r in sorted(found.collect())]
    want = brute(x, range(1, 1800, 40), 6, metric, groups)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=2e-9)
    assert metric == "cosine" or got == want
    n = work.first()
    assert n.n_all == 45 * 1800 and n.n_compared < n.n_all / (2 if metric == "cosine" or grouped else 4)
    assert index.n.max() <= 150 and index.n.sum() == 1800


def test_boxes_bound_the_blocks_of_few_dimensions(spark):
    """Groups in parallel planes: the nearest rows of other groups lie no nearer the more rows there are, but fewer blocks come as near."""
    rng, n = np.random.default_rng(21), 4000
    x = np.column_stack([rng.integers(0, 12, n) / 5, rng.normal(size=(n, 2)) * 3])
    x[:200] = x[0]  # equal rows
    table = spark.createDataFrame([(i, v.tolist(), int(v[0] * 5 + 0.5)) for i, v in enumerate(x)], "id long, vec array<double>, grp int")
    found, work = pivots.search(pivots.build(table, group="grp", block_rows=50), table.where("id % 10 = 0"), 4, "grp")
    got = {(r["query_id"], r["rank"]): (r["neighbour_id"], round(r["distance"], 9)) for r in found.collect()}
    want, of = {}, np.round(x[:, 0] * 5)
    for i in range(0, n, 10):
        d = np.where(of == of[i], np.inf, np.sqrt(((x - x[i]) ** 2).sum(1)))
        want |= {(i, rank): (int(j), round(float(d[j]), 9)) for rank, j in enumerate(np.lexsort((np.arange(n), d))[:4], 1)}
    assert got == want
    assert work.first()["n_pairs"] < 9 * n / 10


def test_search_of_few_rows_and_none(spark):
    table = vectors(spark, np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 1.0]]))
    index = pivots.build(table)
    found, work = pivots.search(index, table, 5)
    assert [tuple(r) for r in sorted(found.collect())] == [(0, 1, 2, 0.0), (0, 2, 1, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (2, 1, 0, 0.0), (2, 2, 1, 1.0)]
    found, work = pivots.search(index, table.where("id < 0"), 5)
    assert found.count() == 0 and tuple(work.first()) == (0, 0, 0)
    found, _ = pivots.search(index, table.where("id = 0"), 1, own=True)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 0, 0.0)]
    with pytest.raises(Exception, match="components"):
        pivots.search(index, vectors(spark, np.array([[1.0]])), 1)[0].collect()
    with pytest.raises(ValueError):
        pivots.build(table.where("id < 0"))


def test_versions_are_whole_and_never_overwritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = spark.range(5).withColumn("x", F.when(F.col("id") > 1, F.col("id") / 2))
    assert store.versions("m") == [] and store.save("m", {"t": one}, {"a": [1, "é"]}) == 1
    assert Store(spark.newSession(), store.root).save("m", {"t": one.limit(2)}, {"a": 2}) == 2
    got = Store(spark.newSession(), store.root).load("m")
    assert (got.version, got.facts, got.tables["t"].count()) == (2, {"a": 2}, 2)
    assert rows(store.load("m", 1).tables["t"]) == rows(one) and store.load("m", 1).facts == {"a": [1, "é"]}
    for name, version in (("m", 3), ("other", None)):
        with pytest.raises(ContractError, match="no version"):
            store.load(name, version)
    with pytest.raises(ValueError):
        store.save("../m", {"t": one}, {})
    assert store.save("m", {"t": one.limit(0)}, {}) == 3 and store.load("m").tables["t"].count() == 0


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    store.save("m", {"t": spark.range(1)}, {})
    known = store.versions
    calls = []
    monkeypatch.setattr(store, "versions", lambda name: [] if not calls and not calls.append(1) else known(name))  # looked before the other wrote
    assert store.save("m", {"t": spark.range(2)}, {}) == 2
    assert store.load("m", 1).tables["t"].count() == 1 and store.load("m", 2).tables["t"].count() == 2


def test_broken_versions_are_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    Store(spark, root).save("m", {"t": spark.range(5), "u": spark.range(3)}, {"a": 1})
    manifest, data = f"{root}/m/v00000001.json", glob.glob(f"{root}/m/data-*")[0]

    def refused(change, match, verify=True):
        copy = str(tmp_path / f"copy-{len(list(tmp_path.iterdir()))}")
        shutil.copytree(root, copy)
        change(copy)
        with pytest.raises(ContractError, match=match):
            Store(spark, copy).load("m", verify=verify)

    def rewritten(text):
        def change(copy):
            for f in glob.glob(f"{copy}/m/.v*.crc"):
                shutil.move(f, f + ".gone")
            with open(manifest.replace(root, copy), "w") as f:
                f.write(text)

        return change

    whole = open(manifest).read()
    refused(rewritten(whole[: len(whole) // 2]), "can't be read")
    refused(rewritten(whole.replace('"a": 1', '"a": 2')), "was changed")
    refused(lambda copy: shutil.rmtree(f"{data.replace(root, copy)}/t"), "is lost")
    other = lambda df: lambda copy: df.write.mode("overwrite").parquet(f"{data.replace(root, copy)}/t")
    refused(other(spark.range(5).withColumn("y", F.lit(1))), "another schema")
    refused(other(spark.range(4)), "other rows")
    refused(other(spark.range(1, 6)), "other rows")


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    cells = [(i, f"f{j}", None if (i + j) % 9 == 0 else float(round(rng.normal(j, 1 + j), 3))) for i in range(240) for j in range(5)] + [(i, "rare", 1.0) for i in range(9)]
    long = spark.createDataFrame(cells, "row long, feature string, value double").persist()
    named = long.select("row").distinct().withColumn("project", F.concat(F.lit("p"), (F.col("row") % 4).cast("string")))
    return reference.fit(long, named, {"f1": "continuous"}, components=2, metrics=["euclidean", "cosine"], block_rows=20), {(r[0], r[1]): r[2] for r in cells}


def cases_of(spark, given):
    values = spark.createDataFrame([(c, "a.tsv", f, v) for c, row in given.items() for f, v in row.items()], "case_id long, source_file string, feature_name string, raw_value string")
    return values, spark.createDataFrame([(c,) for c in given], "case_id long")


GIVEN = {0: {"f0": "0.5", "f3": "-2", "odd": "9"}, 7: {"f1": "1", "f2": "2", "f4": "4.25"}}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_cases_projected_by_index_and_directly(spark, model, tmp_path, metric):
    fitted, cells = model
    store = Store(spark, str(tmp_path / "store"))
    assert reference.save(fitted, store, "atlas") == 1
    fresh = spark.newSession()
    loaded = reference.load(Store(fresh, store.root), "atlas")
    assert loaded.warnings == [] and set(loaded.indexes) == {"euclidean", "cosine"}
    values, cases = cases_of(fresh, GIVEN)
    by_index, direct = reference.project(loaded, values, cases, 12, metric), reference.project(loaded, values, cases, 12, metric, direct=True)
    assert (by_index.method, direct.method, by_index.warnings, direct.warnings) == ("index", "direct", [], ["direct distances were asked for"])
    near = lambda p: [(r[0], r[1], r[2], round(r[3], 9)) for r in sorted(p.neighbours.collect())]
    # the same by hand
    x = np.array([[np.nan if cells[i, f"f{j}"] is None else cells[i, f"f{j}"] for j in range(5)] for i in range(240)])
    median = np.nanmedian(x, 0)
    x = np.where(np.isnan(x), median, x)
    mean, std = x.mean(0), x.std(0)
    x = (x - mean) / std
    want, scores = [], {}
    _, _, axes = np.linalg.svd(x - x.mean(0))
    for case, row in GIVEN.items():
        y = (np.array([float(row.get(f"f{j}", median[j])) for j in range(5)]) - mean) / std
        d = np.sqrt(((x - y) ** 2).sum(1)) if metric == "euclidean" else 1 - x @ y / np.sqrt((x * x).sum(1) * (y @ y))
        order = sorted(range(240), key=lambda i: (round(d[i], 9), i))[:12]
        want += [(case, r, i, round(d[i], 9)) for r, i in enumerate(order, 1)]
        scores[case] = axes[:2] @ (y - x.mean(0))
    assert near(by_index) == near(direct) == [(a, b, c, pytest.approx(float(d), abs=2e-9)) for a, b, c, d in want]
    for r in by_index.coordinates.collect():
        assert np.allclose(np.abs(r["scores"]), np.abs(scores[r["id"]]))
    assert {(r.case_id, r.status) for r in by_index.audit.where("not expected_in_reference").collect()} == {(0, "extra_not_in_reference_ignored")}
    shares = reference.label_shares(by_index.neighbours, loaded.rows, "project").collect()
    assert sum(r.n_neighbours for r in shares) == 24 and sum(r.share for r in shares) == pytest.approx(2)


def changed(fitted, store, name, tables=None, facts=None, lose=()):
    """The model saved with some parts replaced."""
    caught = {}

    class Catch:
        def save(self, name, t, f):
            caught.update(t=t, f=f)
            return 0

    reference.save(fitted, Catch(), name)
    t, f = caught["t"], json.loads(json.dumps(caught["f"]))
    for part, change in (facts or {}).items():
        f[part] = change(f[part]) if callable(change) else change
    for part, change in (tables or {}).items():
        t[part] = change(t[part])
    store.save(name, {k: v for k, v in t.items() if k not in lose}, f)


def other(part):
    return part | {"contract": contract_hash({})}


REFUSALS = {
    "lacks": dict(lose=("coordinates",)),
    "repeat": dict(tables={"features": lambda d: d.withColumn("feature_name", F.lit("f0"))}),
    "no order": dict(tables={"features": lambda d: d.withColumn("position", F.col("position") + 1)}),
    "features are of another feature contract": dict(tables={"features": lambda d: d.withColumn("feature_type", F.lit("count"))}),
    "axes are of another feature contract": dict(facts={"axes": other}),
    "coordinates are of another feature contract": dict(facts={"coordinates": other}),
    "not positive": dict(tables={"features": lambda d: d.withColumn("std", F.lit(0.0))}),
    "not finite": dict(tables={"features": lambda d: d.withColumn("mean", F.lit(float("nan")))}),
    "principal axes": dict(tables={"axes": lambda d: d.withColumn("loading", F.slice("loading", 1, 3))}),
    "rows are of another set": dict(tables={"rows": lambda d: d.where("id <> 3")}),
    "coordinates are of another set": dict(tables={"coordinates": lambda d: d.withColumn("id", F.col("id") + 1)}),
    "values that are not finite": dict(tables={"rows": lambda d: d.withColumn("vec", F.when(F.col("id") == 3, F.array_repeat(F.lit(float("inf")), 5)).otherwise(F.col("vec")))}),
    "another length": dict(tables={"coordinates": lambda d: d.withColumn("scores", F.slice("scores", 1, 1))}),
}


@pytest.mark.parametrize("match", REFUSALS)
def test_models_whose_parts_differ_are_refused(spark, model, tmp_path, match):
    store = Store(spark, str(tmp_path / "store"))
    changed(model[0], store, "m", **REFUSALS[match])
    with pytest.raises(ContractError, match=match):
        reference.load(store, "m")


FALLBACKS = {
    "is lost": dict(lose=("pivots_euclidean",)),
    "of another feature contract": dict(facts={"indexes": lambda i: {k: other(v) for k, v in i.items()}}),
    "of another set of rows": dict(tables={"index_euclidean": lambda d: d.where("id > 0")}),
    "no euclidean index": dict(facts={"indexes": {}}),
}


@pytest.mark.parametrize("why", FALLBACKS)
def test_indexes_that_do_not_fit_give_way_to_direct_distances(spark, model, tmp_path, why):
    store = Store(spark, str(tmp_path / "store"))
    changed(model[0], store, "m", **FALLBACKS[why])
    values, cases = cases_of(spark, GIVEN)
    done = reference.project(reference.load(store, "m"), values, cases, 3)
    assert done.method == "direct" and why in done.warnings[0]
    assert rows(done.neighbours.select("query_id", "rank", "neighbour_id")) == rows(reference.project(model[0], values, cases, 3).neighbours.select("query_id", "rank", "neighbour_id"))


def test_cases_that_are_refused(spark, model):
    fitted, _ = model
    with pytest.raises(ContractError, match="no known feature"):
        reference.project(fitted, *cases_of(spark, {1: {"odd": "1"}, 2: {"f0": "1"}}))
    middle = {r["feature_name"]: repr(r["mean"]) for r in fitted.features.collect()}
    with pytest.raises(ContractError, match="no cosines"):
        reference.project(fitted, *cases_of(spark, {1: middle}), metric="cosine")
    with pytest.raises(ValueError):
        reference.project(fitted, *cases_of(spark, GIVEN), k=0)
    assert reference.project(fitted, *cases_of(spark, GIVEN), k=1000).neighbours.count() == 480


def test_project_arrays_equals_project(spark):
    table = vectors(spark, np.arange(12.0).reshape(4, 3) ** 1.5).select("id", "vec")
    mean, loadings, _, _ = matrix.pca(table, 2)
    a = {r["id"]: (r["PC1"], r["PC2"]) for r in matrix.project(table, mean, loadings).collect()}
    assert {r["id"]: tuple(r["scores"]) for r in matrix.project_arrays(table, mean, loadings).collect()} == a
