"""Parts of standardisers, keys and driver-side helpers on hand-made rows."""

import json

import numpy as np
import pytest

from cohortlake.operators import cluster, contract, joins, matrix, standardise
from cohortlake.operators.contract import ContractError
from cohortlake.operators.joins import assert_unique  # noqa: F401
from cohortlake.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_samples_by_themselves_or_by_their_patient(spark):
    members = spark.createDataFrame([("aa-00-0001-01a", "aa-00-0001"), ("AA-00-0002-01A", "AA-00-0002"), ("AA-00-0002-02A", "AA-00-0002"), ("AA-00-0001-01A", "AA-00-0001")], "sample_barcode string, patient_barcode string")
    df = spark.createDataFrame([("AA-00-0001-01A-11D",), ("aa-00-0001-09B",), ("AA-00-0002-02A",), ("AA-00-0002-05A",), ("AA-00-0009-01A",), (None,)], "named string")
    got = {r["named"]: r["sample_barcode"] for r in standardise.resolved_samples(df, "named", members).collect()}
    assert got == {"AA-00-0001-01A-11D": "AA-00-0001-01A", "aa-00-0001-09B": "AA-00-0001-01A", "AA-00-0002-02A": "AA-00-0002-02A", "AA-00-0002-05A": None, "AA-00-0009-01A": None, None: None}


def test_usable_copies(spark):
    good = ("s", "1", 5, 5, None, None, 0.0)
    bad = [(None, *good[1:]), ("s", "NA", *good[2:]), ("s", "MT", *good[2:]), ("s", None, *good[2:]), ("s", "1", 6, 5, 1.0, 1.0, 0.0), ("s", "1", None, 5, 1.0, None, None), ("s", "1", 5, None, 1.0, None, None), ("s", "1", 5, 6, None, None, None)]
    df = spark.createDataFrame([good, *bad], "sample_barcode string, chromosome string, start int, end int, total_cn double, major_cn double, minor_cn double")
    assert rows(standardise.usable_copies(df)) == [good]


def test_projects_by_id_or_code(spark):
    expected = spark.createDataFrame([("TCGA-AA", "AA"), ("TCGA-BB", "BB")], "project_id string, project_code string")
    by_id = spark.createDataFrame([(1, "TCGA-AA", "zz"), (2, "TCGA-CC", "bb"), (3, None, "bb"), (4, "", "bb")], "i int, project_id string, cohort string")
    assert rows(standardise.project_annotations(by_id, expected).select("i", "project_id", "project_code")) == [(1, "TCGA-AA", "AA"), (2, None, None), (3, None, None), (4, None, None)]
    by_code = by_id.replace("TCGA-CC", "other", "project_id")
    assert rows(standardise.project_annotations(by_code, expected).select("i", "project_id", "project_code")) == [(1, None, None), (2, "TCGA-BB", "BB"), (3, "TCGA-BB", "BB"), (4, "TCGA-BB", "BB")]
    with pytest.raises(ContractError, match="no expected"):
        standardise.project_annotations(by_id.where("i > 1"), expected)
    with pytest.raises(ContractError, match="no column"):
        standardise.project_annotations(by_id.select("i"), expected)


def test_places_keep_their_order_and_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], "k string, v int")
    order = spark.createDataFrame([(0, "b"), (1, "gone"), (2, "a"), (3, "b")], "ordinal int, k string")
    assert rows(joins.aligned(df, "k", order)) == [(0, "b", 2), (1, "gone", None), (2, "a", 1), (3, "b", 2)]
    with pytest.raises(Exception):
        joins.aligned(df.unionAll(df), "k", order)


def test_partitions_of_a_universe(spark):
    mapping, universe = spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string"), spark.createDataFrame([(1,), (2,), (2,)], "k int")
    contract.check_partition(mapping, universe, "k")
    for bad in ((mapping.where("k = 1"), universe), (mapping, universe.where("k = 1")), (mapping.unionAll(mapping), universe)):
        with pytest.raises(Exception):
            contract.check_partition(*bad, "k")


def test_configurations_are_read_through_the_file_system(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": [1, "é"], "b": {"c": None}}, indent=2))
    assert readers.load_config(spark, str(path)) == {"a": [1, "é"], "b": {"c": None}}
    (tmp_path / "none.json").write_text("")
    with pytest.raises(ValueError):
        readers.load_config(spark, str(tmp_path / "none.json"))


def test_pairs_singletons_and_bins(spark):
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0.0]])
    merges = cluster.average_linkage(d)
    assert cluster.closest_pairs(merges, list("abcd"), 3) == [("a", "b", 1.0), ("c", "d", 2.0), ("a", "c", 4.5)]
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "m string, g int")
    assert rows(cluster.singletons(df, "g")) == [("a", 1, False), ("b", 1, False), ("c", 2, True)]
    assert rows(cluster.changed_members(df, df.replace(2, 1, "g"), "m", "g")) == [("c", 2, 1)]
    x = np.arange(40.0)
    labels, method = cluster.quantile_labels(x, 3, 10)
    assert method == "quantile_3" and labels[0] == 3 and labels[-1] == 1 and sorted(np.bincount(labels)[1:]) == [13, 13, 14]
    assert cluster.quantile_labels(np.ones(30), 3, 10) == (pytest.approx(np.ones(30)), "single")


def test_scaling_keeps_distances():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    y = matrix.classical_scaling(d)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), d)
    with pytest.raises(ValueError):
        matrix.classical_scaling(np.zeros((matrix.SMALL + 1, 1)))
