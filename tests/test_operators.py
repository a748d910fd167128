"""Edge cases of the operators on hand-made rows."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import scalars as S
from cohortlake.operators import cluster as C
from cohortlake.operators import aggregates, casework, contract, features, joins, manifest, matrix, reshape, rules, select, standardise, vote
from cohortlake.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_interval_edges(spark):
    points = spark.createDataFrame([("s", "1", p, i) for i, p in enumerate([10, 20, 21, 15, 40, None, 5])] + [("t", "1", 15, 9)], "s string, c string, pos long, n int")
    segments = spark.createDataFrame([("s", "1", 10, 20, 0.1), ("s", "1", 12, 14, 0.2), ("s", "1", 30, 35, 0.3), ("s", "1", 30, 45, 0.4)], "s string, c string, a long, b long, v double")
    out = {r["n"]: (r["v"], r["matched"]) for r in joins.asof_interval(points, segments, ["s", "c"], "pos", "a", "b", ["v"]).collect()}
    # the last segment that starts before the point decides, even if an earlier one still covers it; equal starts: the longer
    assert out == {0: (0.1, True), 1: (None, False), 2: (None, False), 3: (None, False), 4: (0.4, True), 5: (None, False), 6: (None, False), 9: (None, False)}


def test_interval_without_segments_or_points(spark):
    points = spark.createDataFrame([("s", 1)], "s string, pos long")
    none = spark.createDataFrame([], "s string, a long, b long, v double")
    assert [tuple(r) for r in joins.asof_interval(points, none, ["s"], "pos", "a", "b", ["v"]).collect()] == [("s", 1, None, False)]
    assert joins.asof_interval(points.where("false"), none, ["s"], "pos", "a", "b", ["v"]).count() == 0


def test_checked_join_refuses_repeats(spark):
    one, many = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(joins.CardinalityError):
        joins.checked_join(many, one, ["k"])
    assert joins.checked_join(one, many, ["k"], "left", "many_to_one").count() == 2


def test_key_levels(spark):
    universe = spark.createDataFrame([("A-1-01A",), ("A-1-01B",), ("B-2-01A",)], "full string")
    table = spark.createDataFrame([("A-1-01A",), ("B-2-01",), ("A-1-01",), ("C",), (None,)], "given string")
    out = joins.harmonise_keys(table, universe, "given", "full", [(F.col("given"), F.col("full"), "exact"), (F.substring("given", 1, 6), F.substring("full", 1, 6), "prefix")])
    assert {r["given"]: (r["resolved"], r["match_level"]) for r in out.collect()} == {"A-1-01A": ("A-1-01A", "exact"), "B-2-01": ("B-2-01A", "prefix"), "A-1-01": (None, None), "C": (None, None), None: (None, None)}


def test_scalars(spark):
    df = spark.createDataFrame([("chr1", "yes"), ("23", "T"), ("1.0", "no"), ("chrM", None), (None, "1"), ("gl", "x")], "c string, b string")
    assert [tuple(r) for r in df.select(S.chromosome(F.col("c")), S.boolean(F.col("b")), S.boolean(F.col("b"), "narrow")).collect()] == [("1", True, True), ("X", True, False), ("1", False, False), ("MT", False, False), ("NA", True, True), ("GL", False, False)]
    one = spark.createDataFrame([("Possible Melanoma vs. lung-cancer, Sarkom or melanoma", "TP53|7157", "?|9", "1e400", "2.5")], "d string, g string, h string, n string, m string")
    assert tuple(one.select(S.alternatives(F.col("d")), S.gene_symbol(F.col("g")), S.gene_symbol(F.col("h")), S.number(F.col("n")), S.number(F.col("m"))).first()) == (["melanoma", "lung cancer", "sarkom"], "TP53", "9", None, 2.5)


def test_missingness_limit_is_strict(spark):
    cells = [(r, "at", 1.0 * r) for r in range(7)] + [(r, "above", 1.0 * r) for r in range(6)] + [(r, "flat", 2.0) for r in range(10)] + [(0, "empty", None)]
    long = spark.createDataFrame(cells, "row int, feature string, value double")
    out, params = matrix.impute_scale(long, spark.range(10).select(F.col("id").cast("int").alias("row")))
    assert {r["feature"] for r in params.collect()} == {"at", "flat"}
    assert out.where("feature = 'flat'").agg(F.max("scaled")).first()[0] == 0
    assert out.where("imputed").count() == 3


def test_nearest_forms_agree(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in p], i // 2) for i, p in enumerate(rng.integers(0, 3, (40, 4)))], "id long, vec array<double>, g int")
    for metric in ("euclidean", "cosine"):
        a = {(r["query_id"], r["rank"]): round(r["distance"], 9) for r in matrix.nearest(v, v, 5, metric).collect()}
        b = {(r["query_id"], r["rank"]): r["distance"] for r in matrix.nearest_sql(v.select("id", "vec"), v, 5, metric).collect()}
        assert a == pytest.approx(b)
    apart = matrix.nearest(v, v, 5, group="g").collect()
    assert all(r["query_id"] // 2 != r["neighbour_id"] // 2 for r in apart)


def test_trees_and_mixtures():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0.0]])
    merges = C.average_linkage(d)
    assert C.cut_tree(merges, 4, 2) == [1, 1, 2, 2] and C.newick(merges, list("abcd")).endswith(";")
    assert C.neighbour_joining(d, list("abcd")).count("(") == 2
    assert abs(C.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12 and abs(C.chi2_tail(20, 3) - 0.00016974243555282) < 1e-12
    rng = np.random.default_rng(0)
    labels, method = C.mixture_labels(np.concatenate([rng.normal(0.2, 0.02, 80), rng.normal(0.4, 0.02, 60)]))
    assert method == "mixture_2" and sorted(np.bincount(labels)[1:]) == [60, 80]
    assert C.mixture_labels(np.ones(5))[1] == "skipped_too_few"


def test_rules_have_three_values(spark):
    given = [{"rule_id": "all", "condition": {"all": [{"feature": "a", "operator": "gt", "threshold": 1}, {"feature": "b", "operator": "gt", "threshold": 1}]}}, {"rule_id": "any", "condition": {"any": [{"feature": "a", "operator": "gt", "threshold": 1}, {"feature": "b", "operator": "gt", "threshold": 1}]}}]
    rules.validate_rules(given, ["a", "b"], [])
    values = spark.createDataFrame([(1, "a", 0.0, True), (1, "b", 9.0, False), (2, "a", 2.0, True), (2, "b", 9.0, False), (3, "a", 2.0, True), (3, "b", 2.0, True)], "case_id int, feature string, value double, supplied boolean")
    got = {(r["case_id"], r["rule_id"]): (r["evaluable"], r["triggered"]) for r in rules.evaluate(rules.clause_table(spark, given), values).collect()}
    assert got == {(1, "all"): (False, False), (1, "any"): (False, False), (2, "all"): (False, False), (2, "any"): (True, True), (3, "all"): (True, True), (3, "any"): (True, True)}
    with pytest.raises(ValueError):
        rules.validate_rules([{"rule_id": "x", "condition": {"all": [], "any": []}}], [], [])


def test_true_label_absent(spark):
    near = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0)], "query_id long, neighbour_id long, distance double")
    labels = spark.createDataFrame([(0, "z"), (1, "x"), (2, "y")], "id long, label string")
    one = vote.predictions(vote.votes(near, labels), labels).first()
    assert (one["predicted"], one["true_rank"], one["correct"]) == ("x", 3, False) and abs(one["margin"] - 1 / 3) < 1e-12


def test_selection_and_contracts(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in "ab" for i in range(5)], "g string, i int, s double")
    assert select.diverse_top(df, "g", ["b"], [F.desc("s"), F.col("g"), F.col("i")], 2, 3).count() == 3
    alloc = select.proportional_allocation(spark.createDataFrame([("a", 5), ("b", 1), ("c", 30)], "stratum string, n long"), 10)
    assert sum(r["allocated"] for r in alloc.collect()) == 10
    with pytest.raises(contract.ContractError):
        contract.check_finite(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])
    assert reshape.same_members(df, df, ["g"]) and contract.contract_hash({"b": 1, "a": 2}) == contract.contract_hash({"a": 2, "b": 1})


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.5), (None, None)], "k string, v double")
    sinks.write_tsv(df, str(tmp_path / "a.tsv"), single=True)
    back = readers.read_delimited(spark, str(tmp_path / "a.tsv"))
    assert rows(back) == [("x", "1.5"), (None, None)][::-1] or rows(back) == [("x", "1.5"), (None, None)] or set(rows(back)) == {("x", "1.5"), (None, None)}
    assert readers.first_present(["Sample Name", "Start"], ["sample", "sample_name"]) == "Sample Name"
    assert readers.optional_source(spark, str(tmp_path / "none.parquet"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        sinks.check_outputs(spark, [str(tmp_path / "none")])
    assert "| k | v |" in sinks.markdown_table(df)


def test_words_match_literally(spark):
    df = spark.createDataFrame([("a c++ b", "c++"), ("xc++", "c++"), ("a.b", "a.b"), ("aXb", "a.b"), ("(x) y", "(x)"), ("lungs", "lung"), ("lung ca", "lung"), ("\\E end", "\\E")], "t string, w string")
    assert [r[0] for r in df.select(S.has_word(F.col("t"), F.col("w"))).collect()] == [True, False, True, False, True, False, True, True]


def test_plain_text_folds_as_unicode_does(spark):
    texts = ["Ångström Čapek", "ﬁne ½ Ǆ", "e\u0301te\u0301", "ＦＵＬＬ width", "ß ø ł", "Việt ẞ", None]
    want = [" ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).split()) if t else "" for t in texts]
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.plain_text(F.col("t"))).collect()] == want


def test_opposing_rules_count_against(spark):
    hit = spark.createDataFrame([(1, "a", True, True), (1, "b", True, True), (1, "c", True, False), (2, "b", True, True)], "case_id int, rule_id string, evaluable boolean, triggered boolean")
    told = spark.createDataFrame([("a", "fa", "weak", ["x"], ["y"]), ("b", "fb", "strong", ["y"], ["x"]), ("c", "fc", "strong", ["x"], [])], "rule_id string, finding string, strength string, supports array<string>, argues_against array<string>")
    got = {(r["case_id"], r["target"]): (r["n_rules"], r["n_against"], r["strength"], round(r["net"], 6), r["findings"], r["findings_against"]) for r in rules.evidence(hit, told).collect()}
    assert got == {(1, "x"): (1, 1, "weak", -0.666667, "fa", "fb"), (1, "y"): (1, 1, "strong", 0.666667, "fb", "fa"), (2, "x"): (0, 1, None, -1.0, "", "fb"), (2, "y"): (1, 0, "strong", 1.0, "fb", "")}
    with pytest.raises(ValueError):
        rules.validate_rules([{"rule_id": "x", "condition": {"all": [{"feature": "f", "operator": "gt", "threshold": 1}]}, "argues_against": ["nobody"]}], ["f"], ["x"])


@pytest.mark.parametrize("by", [(), ("g",)])
def test_false_discovery_rates(spark, by):
    rng = np.random.default_rng(3)
    given = [(i, "ab"[i % 2], None if i % 17 == 0 else float(round(rng.random() ** 3, 2))) for i in range(900)]  # many ties
    got = {r["k"]: r["fdr"] for r in C.benjamini_hochberg(spark.createDataFrame(given, "k int, g string, p double"), "p", "k", by, bins=16).collect()}
    for group in ("a", "b") if by else (None,):
        mine = sorted([(p, k) for k, g, p in given if p is not None and group in (None, g)])
        least = 1.0
        for r in range(len(mine), 0, -1):
            p, k = mine[r - 1]
            least = min(least, p * len(mine) / r)
            assert got[k] == pytest.approx(least)
    assert all(got[k] is None for k, _, p in given if p is None)


def test_nearest_breaks_many_ties_by_id(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60, 0, -1)] + [(100, [3.0, 1.0])], "id long, vec array<double>")
    got = {}
    for r in matrix.nearest(same, same, 4, block_rows=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
    assert sorted(got[100]) == [(1, 1, 2.0), (2, 2, 2.0), (3, 3, 2.0), (4, 4, 2.0)] and [x[1] for x in sorted(got[2])] == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        matrix.bounded_rows(same.select(F.col("id").alias("row")), "row", 20)


def test_prevalence_of_groups_without_records(spark):
    events = spark.createDataFrame([("a", 1, "x", True), ("a", 1, "x", False), ("a", 2, "y", False), ("a", 3, None, True)], "g string, e int, f string, h boolean")
    got = rows(aggregates.prevalence(events, spark.createDataFrame([("a",), ("b",)], "g string"), "g", "e", "f", F.col("h")).select("g", "f", "n_hits", "n_entities"))
    assert got == [("a", "x", 1, 3), ("a", "y", 0, 3), ("b", "x", 0, 0), ("b", "y", 0, 0)]


def test_alleles_step_by_step(spark):
    df = spark.createDataFrame([("turned", "3", "1", "2", None), ("major", "3", None, "1", None), ("minor", "3.02", "2", None, "Yes"), ("total", None, "2", "0", None), ("negative", "1", None, "2", None), ("wrong", "5", "2", "1", "weird"), ("none", "2.4", None, "x", ""), ("lost", "0", "0", "0", None)], "k string, t string, a string, b string, l string")
    got = {r["k"]: (r["total_cn"], r["major_cn"], r["minor_cn"], r["loh_status"], r["notes"]) for r in standardise.allele_copies(df, "t", "a", "b", "l").collect()}
    assert got == {
        "turned": (3, 2, 1, "no_LOH", "alleles_ordered;loh_from_minor"), "major": (3, 2, 1, "no_LOH", "major_from_total;loh_from_minor"), "minor": (3, 2, 1, "LOH", "minor_from_total"), "total": (2, 2, 0, "LOH", "total_from_alleles;loh_from_minor"),
        "negative": (None, None, None, None, "major_from_total;inconsistent_copies"), "wrong": (None, None, None, "reported:weird", "inconsistent_copies"), "none": (None, None, None, None, "none"), "lost": (0, 0, 0, "complete_copy_loss", "loh_from_minor"),
    }


def test_cases_that_break_the_contract(spark):
    reference = spark.createDataFrame([("b", "binary", 0.0, 0.5, 0.5), ("n", "count", 1.0, 1.0, 2.0), ("x", "continuous", 5.0, 4.0, 2.0)], "feature_name string, feature_type string, median double, mean double, std double")
    cases, kinds = spark.createDataFrame([("c",)], "case_id string"), "case_id string, source_file string, feature_name string, raw_value string"
    for bad in ([("c", "1", "b", "0.5")], [("c", "1", "n", "-1")], [("c", "1", "n", "1.5")], [("c", "1", "x", "text")], [("c", "1", "x", "1"), ("c", "2", "x", "2")]):
        with pytest.raises(contract.ContractError):
            casework.harmonise_cases(spark.createDataFrame(bad, kinds), cases, reference)
    audit = casework.harmonise_cases(spark.createDataFrame([("c", "2", "x", "8"), ("c", "1", "x", "8.0"), ("c", "1", "n", None), ("c", "1", "more", "z")], kinds), cases, reference)
    got = {r["feature_name"]: (r["source_file"], r["supplied"], r["value_used"], r["scaled_value"], r["status"]) for r in audit.collect()}
    assert got == {"x": ("1;2", True, 8.0, 2.0, "supplied"), "b": ("none", False, 0.0, -1.0, "imputed_missing_feature"), "n": ("none", False, 1.0, 0.0, "imputed_missing_feature"), "more": ("1", True, None, None, "extra_not_in_reference_ignored")}
    assert casework.case_summary(audit).first()["warnings"] == "imputed_features;extra_features;low_coverage"
    with pytest.raises(contract.ContractError):
        casework.harmonise_cases(spark.createDataFrame([], kinds), cases, reference.withColumn("std", F.lit(0.0)))


def test_hits_without_ids_and_modes(spark):
    shape = "file_id string, file_name string, cases array<struct<project:string,submitter_id:string,samples:array<struct<submitter_id:string>>>>"
    hits = spark.createDataFrame([("f", None, None), ("g", "x_AB-01-C-01A.seg", [("P", "", None)])], shape)
    got = {r["file_id"]: (r["case_ids"], r["sample_ids"]) for r in manifest.hit_ids(hits, "[A-Z]{2}-[0-9]{2}-[A-Z](?:-[0-9]{2}[A-Z])?", 9).collect()}
    assert got == {"f": ([], []), "g": ([], ["AB-01-C-01A"])}
    with pytest.raises(ValueError):
        manifest.capped(hits, "else", 1, [F.col("file_id")])
    with pytest.raises(ValueError):
        features.definition_table(spark, {"purity_ploidy": ["a"], "expression_pca": ["a"]})
    with pytest.raises(ValueError):
        features.described(spark.createDataFrame([("a", "nothing")], "name string, feature_class string"))
    with pytest.raises(contract.ContractError):
        contract.check_columns(hits, {"file_id": "bigint"})


def test_components_of_principal_axes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) * [3, 2, 1, 0.1] + 5
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    mean, loadings, variances, shares = matrix.pca(v, 2)
    _, s, vt = np.linalg.svd(x - x.mean(0))
    assert variances == pytest.approx(s[:2] ** 2 / 79) and shares == pytest.approx(s[:2] ** 2 / (s**2).sum())
    got = np.array([[r["PC1"], r["PC2"]] for r in matrix.project(v, mean, loadings).orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs((x - x.mean(0)) @ vt[:2].T))


def test_average_linkage_by_hand():
    d = np.array([[0, 2, 6, 10], [2, 0, 5, 9], [6, 5, 0, 4], [10, 9, 4, 0.0]])
    merges = C.average_linkage(d)  # 0-1 at 2, 2-3 at 4, then the mean of 6, 10, 5, 9
    assert [round(float(m[2]), 9) for m in merges] == [2, 4, 7.5] and C.cut_tree(merges, 4, 3) == [1, 1, 2, 3]
