"""Scans that cut only what is asked for, exact quantiles and mixtures over partial sums."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import cluster, mixtures, quantiles
from cohortlake.sources import scans


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def split(spark):
    """A session that cuts files into blocks of 300 bytes."""
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.files.maxPartitionBytes", "300")
    fresh.conf.set("spark.sql.files.openCostInBytes", "1")
    return fresh


def matrix_lines():
    lines = ['"gene_id"\tS1\t"S2"\tS3\tS1.2']
    for i in range(60):
        lines.append(f'"g{i % 50}|{i}"\t{i}\t"{i / 4}"\tNA\t{i * 10}' if i % 9 else f"g{i}.3\t{i}\t7")
    lines[21] = "G20\t1\t2\t3\t"  # an empty last field is no field
    lines[32] = "?|G31\t1e3\tx1_0\t2_0\tnan"
    return lines


@pytest.mark.parametrize("packed", [False, True])
def test_wide_scan_cuts_wanted_cells_only(split, tmp_path, packed, monkeypatch):
    lines = matrix_lines()
    path = str(tmp_path / ("m.tsv.gz" if packed else "m.tsv"))
    with (gzip.open if packed else open)(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    wanted = ["G1", "G2", "G31", "G20", "G9", "nothing"]
    got = scans.scan_wide(split, path, ["S2", "S1.2"], wanted)
    assert got.columns == ["S2", "S1.2"]
    cells = {(i, c): v for i, cs in {1: (0.25, 10), 51: (12.75, 510), 2: (0.5, 20), 52: (13.0, 520), 59: (14.75, 590)}.items() for c, v in zip((2, 4), cs)}
    want = [(f"G{i % 50}", c, got.columns[c // 3], float(v)) for (i, c), v in cells.items()] + [("G31", 2, "S2", None), ("G31", 4, "S1.2", None)]
    assert rows(got.cells) == sorted(want, key=str)
    # short rows are reported by number, wanted or not
    assert rows(got.short) == sorted([(i + 1, f"G{i}", 3) for i in range(0, 60, 9)] + [(21, "G20", 4)], key=str)
    few = scans.scan_wide(split, path, lambda c: c == "S1", None)
    assert few.short.count() == 0 and few.rows.count() == 60
    assert scans.scan_wide(split, path, [], None).rows.count() == 0
    monkeypatch.setattr(scans, "FEW", 2)
    assert rows(scans.scan_wide(split, path, ["S2", "S1.2"], wanted).cells) == rows(got.cells)
    samples = split.createDataFrame([("S2", "a"), ("S1.2", "a")], "column string, sample string")
    assert ("G1", "a", ((0.25 + 12.75) / 2 + 260) / 2) in rows(scans.collapsed(got.cells, samples))
    with pytest.raises(ValueError):
        open(tmp_path / "empty.tsv", "w").close()
        scans.scan_wide(split, str(tmp_path / "empty.tsv"))


def test_row_name_is_tested_before_the_row_is_cut(split, tmp_path):
    path = str(tmp_path / "m.tsv")
    with open(path, "w") as f:
        f.write("\n".join(matrix_lines()))
    plan = scans.scan_wide(split, path, ["S2"], ["G1"]).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Filter") and "split(" not in plan


ALIASES = {"sample": ["sample", "id"], "start": ["start", "locstart"], "mean": ["segmentmean", "mean"]}


def test_headed_files_in_one_plan(split, tmp_path):
    files = {"a.tsv": "Sample\tStart\tSegment_Mean\n" + "".join(f"a{i}\t{i}\t{i / 2}\n" for i in range(80)), "b.csv": '# by hand\n\n"mean","ID",x,"loc.start"\n1.5,"b",,7\nNA,b2,y\n# no row\n', "c.txt": "start;id\n1;c\n", "d.tsv": "", "e.tsv": "# nothing\n", "f.tsv": "id\tstart\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got, warnings = scans.scan_headed(split, str(tmp_path), ALIASES, ["sample", "start"])
    base = lambda df: df.withColumn("file", F.element_at(F.split("file", "/"), -1))
    want = [("a.tsv", f"a{i}", str(i), str(i / 2)) for i in range(80)] + [("b.csv", "b", "7", "1.5"), ("b.csv", "b2", None, None), ("c.txt", "c", "1", None)]
    assert rows(base(got)) == sorted(want, key=str)
    assert rows(base(warnings)) == [("d.tsv", "empty_file"), ("e.tsv", "empty_file")]
    _, warnings = scans.scan_headed(split, str(tmp_path), ALIASES, ["mean", "start"])
    assert rows(base(warnings)) == [("c.txt", "missing_required_columns_mean"), ("d.tsv", "empty_file"), ("e.tsv", "empty_file"), ("f.tsv", "missing_required_columns_mean")]


def test_one_plan_for_a_thousand_files(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i}.tsv").write_text(f"start\tid\n{i}\ts{i}\n" if i % 2 else f"id,start\ns{i},{i}\n")
    got, _ = scans.scan_headed(spark, str(tmp_path), ALIASES, ["sample", "start"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 2  # headers and lines
    assert sorted(int(r.start) for r in got.collect() if r.sample == f"s{r.start}") == list(range(1000))


def test_quantiles_are_exact_in_bounded_buffers(spark):
    rng = np.random.default_rng(0)
    groups = {"norm": rng.normal(size=1500), "ties": rng.integers(0, 4, 1500), "wide": 10.0 ** rng.uniform(-300, 300, 900), "one": np.ones(700), "few": [2.0, 1.0, 4.0], "peak": np.concatenate([np.full(1800, 2.0), rng.normal(3, 1, 100)]), None: rng.exponential(size=800)}
    data = [(g, float(v), 1) for g, x in groups.items() for v in x] + [("few", None, 1), ("few", float("nan"), 1), ("none", None, 1)]
    shares = [0.5, 0, 0.1, 0.96, 1, 0.5]
    got = quantiles.exact_quantiles(spark.createDataFrame(data, "_x string, x double, n int").repartition(3), ["_x"], "x", shares, few=40).collect()
    assert {r[0]: r["n"] for r in got} == {g: len(x) for g, x in groups.items()} | {"none": 0}
    for r in got:
        assert r["quantiles"] == (None if r[0] == "none" else pytest.approx(list(np.quantile(groups[r[0]], shares)), rel=1e-12))
    whole = quantiles.exact_quantiles(spark.createDataFrame([(float(i),) for i in range(301)], "x double"), [], "x", [0.25], few=10).first()
    assert (whole["n"], whole["quantiles"]) == (301, [75.0])
    assert quantiles.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(spark.createDataFrame([], "x double"), [], "x", [1.5])


def test_large_profiles_take_exact_medians(spark, monkeypatch):
    from cohortlake.operators import matrix

    long = spark.createDataFrame([(i, f"f{i % 3}", None if i % 10 == 0 else float((i * 37) % 101)) for i in range(600)], "row int, feature string, value double")
    small = rows(matrix.feature_profile(long, 600).drop("n_distinct"))
    monkeypatch.setattr(matrix, "LARGE", 100)
    assert rows(matrix.feature_profile(long, 600).drop("n_distinct")) == small


def test_mixtures_over_partial_sums_equal_the_local_form(spark):
    rng = np.random.default_rng(1)
    groups = {"two": np.concatenate([rng.normal(0.2, 0.02, 90), rng.normal(0.7, 0.02, 60)]), None: rng.normal(5, 1, 120), "small": rng.normal(size=60), "tiny": rng.normal(size=9)}
    data = [(g, f"{g}{i}", float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("two", "null", None), ("two", "nan", float("nan"))]
    df = spark.createDataFrame(data, "x string, g string, n double").repartition(3)
    got = mixtures.mixtures(df, "x", "g", "n", large=100, most=3)
    assert got.columns == ["x", "g", "n", "cluster", "method"]
    local = {g: cluster.mixture_labels(np.array(x), most=3) for g, x in groups.items()}
    assert rows(got) == sorted([(g, f"{g}{i}", float(v), int(local[g][0][i]), local[g][1]) for g, x in groups.items() for i, v in enumerate(x)], key=str)
    top = {r["cluster"] for r in got.where("x = 'two' AND n > 0.5").collect()}
    assert top == {1} and local["two"][1] == "mixture_2"  # the greatest mean is cluster 1
    assert rows(mixtures.mixtures(df, "x", "g", "n", most=3)) == rows(got)
    with pytest.raises(ValueError):
        mixtures.mixtures(df, "x", "g", "n", large=10)


def test_nearest_under_many_weights_in_one_pass(spark):
    from cohortlake.operators import matrix

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 1)
    x[10:20] = x[0]
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")
    sets = {"all": [1, 1, 1, 1, 1], "head": [1, 1, 0, 0, 0], "soft": [0.5, 0.5, 2, 0, 1]}
    got = [(r[0], r[1], r[2], r[3], round(r[4], 9)) for r in matrix.nearest_sets(table, table.where("id % 7 = 0"), 4, sets, block_rows=20).collect()]
    want = []
    for name, w in sets.items():
        for q in range(0, 90, 7):
            d = np.sqrt(((x - x[q]) ** 2) @ np.array(w, float))
            want += [(name, q, r, i, round(v, 9)) for r, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(d) if i != q)[:4], 1)]
    assert [g[:3] for g in sorted(got)] == [g[:3] for g in sorted(want)] and np.allclose([g[4] for g in sorted(got)], [g[4] for g in sorted(want)])
    assert sum(a[3] == b[3] for a, b in zip(sorted(got), sorted(want))) >= len(want) - 4  # near ties may round apart
    for bad in ({}, {"none": [0, 0, 0, 0, 0]}, {"less": [1, 1, 1, 1, -1]}):
        with pytest.raises(ValueError):
            matrix.nearest_sets(table, table, 1, bad)


def test_weighting_moves_members(spark):
    from cohortlake.operators import matrix

    rows_ = [(m, f, float(v)) for m, vs in {"a": (0, 0, 9), "b": (0, 1, 0), "c": (9, 9, 9), "d": (9, 8, 0), "e": (9, 9, 8)}.items() for f, v in zip(("x", "y", "z"), vs)]
    long = spark.createDataFrame(rows_, "row string, feature string, value double")
    classes = spark.createDataFrame([("x", "one"), ("y", "one"), ("z", "two")], "feature string, class string")
    weights = spark.createDataFrame([("base", "one", 1.0), ("base", "two", 1.0), ("two", "two", 1.0), ("same", "one", 2.0), ("same", "two", 2.0)], "scenario string, class string, weight double")
    distances = matrix.gower_scenarios(long, classes, weights)
    plain = {(r["a"], r["b"]): r["distance"] for r in matrix.gower(long).collect()}
    got = {(r["a"], r["b"]): r["distance"] for r in distances.where("scenario = 'base'").collect()}
    assert got == pytest.approx(plain) and len(got) == 10
    summary, members = cluster.weighting_sensitivity(distances, "base", 2)
    assert [(s, c) for s, _, c in summary] == [("base", []), ("same", []), ("two", ["a", "b", "c", "d", "e"])]
    assert [round(i, 6) for _, i, _ in summary][:2] == [1.0, 1.0] and summary[2][1] < 0.5 and len(members) == 15
    with pytest.raises(ValueError):
        cluster.weighting_sensitivity(distances, "none")


def test_ranks_within_bins_equal_whole_ranks(spark):
    rng = np.random.default_rng(8)
    data = [(f, int(g), None if rng.random() < 0.05 else float(v)) for f, spread in (("ties", 3), ("wide", 4000)) for g, v in zip(rng.integers(0, 3, 700), rng.integers(0, spread, 700))] + [(None, 0, 1.0), (None, 1, 2.0), ("one", 0, 5.0)]
    df = spark.createDataFrame(data, "feature string, g int, value double")
    few, many = (cluster.kruskal(df, "g", bins=b) for b in (2, 64))
    near = lambda d: sorted(((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in d.collect()), key=str)
    assert near(few) == near(many)
    for name in ("ties", "wide"):
        known = [(v, g) for f, g, v in data if f == name and v is not None]
        value = np.array([v for v, _ in known])
        rank = np.array([(value < v).sum() + ((value == v).sum() + 1) / 2 for v in value])
        n = len(value)
        h = 12 / (n * (n + 1)) * sum(rank[[g == i for _, g in known]].sum() ** 2 / sum(g == i for _, g in known) for i in range(3)) - 3 * (n + 1)
        _, counts = np.unique(value, return_counts=True)
        h /= 1 - (counts**3 - counts).sum() / (n**3 - n)
        assert dict((r[0], r[3]) for r in near(many))[name] == pytest.approx(h)


def test_aliases_are_whole_words_in_configured_order(spark):
    from cohortlake.operators import aliases

    groups = [("late", ["lung"]), ("first", ["Non-small cell lung", "cell"]), ("fold", ["Größe", ""]), ("overlap", ["small cell", "cell lung cancer"]), ("never", ["cel", "!!"])]
    texts = ["non small CELL lung cancer", "cells", None, "", "a groesse? Größe.", "small; cell", "lung", "cell lung cance"]
    df = spark.createDataFrame([(t, [1], "x") for t in texts], "plain string, found array<int>, text string")
    got = [r["matches"] for r in aliases.match_aliases(df, "plain", groups).collect()]
    assert got == [["late", "first", "overlap"], [], [], [], ["fold"], ["first", "overlap"], ["late"], ["late", "first"]]
    assert [r["matches"] for r in aliases.match_aliases(df, "plain", []).collect()] == [[]] * len(texts)


def test_first_value_in_row_order(spark):
    from cohortlake.operators import standardise

    base = spark.createDataFrame([("s1", None, None), ("s2", 5.0, None)], "k string, x double, y double")
    source = spark.createDataFrame([("s1", None, 3.0), ("s1", 0.9, 4.0), ("s1", 0.2, None), ("s2", 1.0, None)], "k string, x double, y double").coalesce(1)
    got, warnings = standardise.assembled(base, [("a", source), ("b", base.select("k"))], "k", ["x", "y"])
    assert rows(got.select("k", "x", "y")) == [("s1", 0.9, 3.0), ("s2", 5.0, None)] and len(warnings) == 1
    got, _ = standardise.assembled(base, [("a", source.withColumn("n", -F.monotonically_increasing_id()))], "k", ["x", "y"], order="n")
    assert rows(got.select("k", "x", "y")) == [("s1", 0.2, 4.0), ("s2", 5.0, None)]


def test_quality_rows_of_no_rows_and_null_groups(spark):
    from cohortlake.operators import aggregates

    df = spark.createDataFrame([("a", 1), (None, 2)], "g string, x int")
    measures = {"n": F.count(F.lit(1)), "most": F.max("x")}
    assert rows(aggregates.quality_rows(df, "g", measures)) == sorted([("global", "ALL", "n", "2"), ("global", "ALL", "most", "2"), ("per_project", "a", "n", "1"), ("per_project", "a", "most", "1"), ("per_project", "NA", "n", "1"), ("per_project", "NA", "most", "2")], key=str)
    assert rows(aggregates.quality_rows(df.limit(0), "g", measures)) == []


def test_groups_are_fitted_together_and_equal_values_once(monkeypatch):
    rng = np.random.default_rng(7)
    groups = [np.round(rng.normal([0.2, 0.6][i % 2], 0.05, 30 + i) * (1 + i % 3), 2) for i in range(60)] + [np.ones(60), np.zeros(3), np.concatenate([rng.normal(0, 0.1, 80), rng.normal(2, 0.1, 40)])]
    calls, one = [], cluster._mixture

    def counted(x, *rest):
        calls.append(x.size)
        return one(x, *rest)

    monkeypatch.setattr(cluster, "_mixture", counted)
    got = cluster.group_labels(groups, least=30)
    assert len(calls) <= 12 and got[60][1] == "mixture_1" and got[61][1] == "skipped_too_few" and got[62][1] == "mixture_2"
    calls.clear()
    # alone, and with the values repeated, a group gets the same labels as among others
    alone = [cluster.group_labels([x], least=30)[0] for x in groups]
    assert all(a[1] == b[1] and (a[0] == b[0]).all() for a, b in zip(got, alone))
    calls.clear()
    many = np.tile(groups[59], 500)
    cluster.mixture_labels(many)
    assert max(calls) == len(np.unique(many))


def test_mixture_steps_equal_plain_em():
    """The form that took one group and one number of components at a time."""

    def plain(x, k, rounds=300):
        mean, var, share, last = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, x.var() / k + 1e-6), np.full(k, 1 / k), -np.inf
        for _ in range(rounds):
            logs = np.log(share) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
            total = np.log(np.exp(logs - logs.max(1, keepdims=True)).sum(1)) + logs.max(1)
            r, like = np.exp(logs - total[:, None]), total.sum()
            weight = r.sum(0) + 1e-12
            mean, share = (r * x[:, None]).sum(0) / weight, weight / weight.sum()
            var = (r * (x[:, None] - mean) ** 2).sum(0) / weight + 1e-6
            if abs(like - last) < 1e-6 * len(x):
                break
            last = like
        return like, r.argmax(1)

    rng = np.random.default_rng(2)
    for n in (12, 57, 400):
        x = np.round(rng.exponential(50, n), 0 if n == 400 else 2)
        u, place, count = np.unique(x, return_inverse=True, return_counts=True)
        padded, counts = np.append(u, [u[-1]] * 5)[None], np.append(count, [0] * 5)[None].astype(float)
        for k in (1, 2, 5):
            like, labels = cluster._mixture(padded, counts, cluster._quantiles(np.sort(x), (np.arange(k) + 0.5) / k)[None], np.array([x.var() / k + 1e-6]))
            want = plain(x, k)
            assert np.isclose(like[0], want[0], rtol=1e-9) and (labels[0][place] == want[1]).all()
