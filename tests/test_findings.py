"""Queries on tables that the driver's small ones have nothing of: ties, strays, groups of many rows."""

import os

import duckdb

from cohortlake.plans import catalogue, models, standards  # noqa: F401

DATA = "/root/testdata/sf0.001"


def folder(tmp_path, **changed):
    """The smallest tables with some replaced by SQL over them."""
    con = duckdb.connect()
    for f in os.listdir(DATA):
        os.symlink(f"{DATA}/{f}", tmp_path / f)
    for name, sql in changed.items():
        os.unlink(tmp_path / f"{name}.parquet")
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for f in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tmp_path}/{f}'")
    return str(tmp_path), con


def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def same(spark, name, path, con):
    df = catalogue.QUERIES[name](spark, path)
    cursor = con.execute(catalogue.ORACLES[name])
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    mine, theirs = sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


def test_scores_on_half_thousandths_equal_sql(spark, tmp_path):
    orders = f"SELECT o.* REPLACE ((100000 + r)::BIGINT AS o_orderkey, (r % 150)::BIGINT AS o_custkey, (160010 + r // 210 * 20)::DOUBLE AS o_totalprice) FROM (SELECT * FROM '{DATA}/orders.parquet' LIMIT 1) o, range(210 * 120) t(r)"
    same(spark, "candidate_score", *folder(tmp_path, orders=orders))


def test_scores_leave_out_line_items_of_unknown_parts(spark, tmp_path):
    part = f"SELECT * FROM '{DATA}/part.parquet' WHERE p_partkey % 3 > 0"
    same(spark, "candidate_score", *folder(tmp_path, part=part))


def test_neighbours_in_small_products_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(catalogue.M, "PAIRS", 100)
    for name in ("feature_ablation", "knn_topk_cosine", "knn_topk_euclidean"):
        same(spark, name, DATA, duck())


def test_line_items_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(catalogue.J, "TASK_ROWS", 700)
    assert catalogue.Tables(spark, DATA).mutations.rdd.getNumPartitions() == 9
    for name in ("tmb_by_sample", "mutation_prevalence_wide"):
        same(spark, name, DATA, duck())


def test_headed_parts_are_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(catalogue.J, "TASK_ROWS", 200)
    whole, files = models.SC.scan_headed, []

    def scan(session, path, *rest):
        files.extend(session.read.text(path).inputFiles())
        return whole(session, path, *rest)

    monkeypatch.setattr(models.SC, "scan_headed", scan)
    same(spark, "headed_files_scan", DATA, duck())
    assert len(files) == 32
