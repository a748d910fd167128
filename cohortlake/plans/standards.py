"""Queries of the standardisers, feature tables, casework, manifests, sources and
sinks on the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import casework as CW
from ..operators import contract as CO
from ..operators import features as FE
from ..operators import joins as J
from ..operators import manifest as MA
from ..operators import matrix as M
from ..operators import reshape as R
from ..operators import select as SE
from ..operators import standardise as ST
from ..sources import readers, sinks
from ..sources.readers import shared_path
from .catalogue import _LONG, _NATIONS, SAMPLES, Tables, _knn, _long, _nations, query, r6

_ID = "[A-Z]{2}-[0-9]{2}-[A-Z0-9]+(?:-[0-9]{2}[A-Z]?)?(?:-[A-Z0-9]+)?"


def case(key, *values):
    """values by key modulo their number."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, F.lit(v)).otherwise(out)
    return out


# ---- standardisers


_EFFECT = "CASE l_linenumber WHEN 1 THEN 'Missense_Mutation' WHEN 2 THEN 'Silent' WHEN 3 THEN 'Splice_Site' ELSE 'Intron' END"


@query(f"""WITH raw AS (SELECT 'P' || lpad(l_orderkey::VARCHAR, 11, '0') || '-' || lpad(l_linenumber::VARCHAR, 3, '0') || '-xy' AS sample, 'G' || (l_partkey % 50) AS gene, {_EFFECT} AS effect, CASE WHEN l_tax > 0 THEN l_linestatus END AS project FROM lineitem)
SELECT sample, project, substr(sample, 1, 16) AS sample_barcode, substr(sample, 1, 12) AS patient_barcode, gene, effect, NULL::VARCHAR AS protein, effect IN ('Missense_Mutation', 'Splice_Site') AS is_nonsynonymous, gene IN ('G1', 'G2', 'G3') AS is_driver_gene FROM raw WHERE project IS NOT NULL""")
def mutation_standardise(t: Tables) -> DataFrame:
    sample = F.concat(F.lit("P"), F.lpad(F.col("l_orderkey").cast("string"), 11, "0"), F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("-xy"))
    raw = t.lineitem.select(sample.alias("sample"), F.concat(F.lit("G"), (F.col("l_partkey") % 50).cast("string")).alias("gene"), F.expr(_EFFECT).alias("effect"), F.when(F.col("l_tax") > 0, F.col("l_linestatus")).alias("project"))
    drivers = t.spark.createDataFrame([("G1",), ("G2",), ("G3",), ("G3",)], "gene string")
    return ST.mutation_table(raw, "sample", "gene", "effect", "project", drivers, optional=["protein"])


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, (l_partkey % 5)::DOUBLE AS ref_count, CASE WHEN l_linenumber = 6 THEN NULL ELSE (l_suppkey % 4)::DOUBLE END AS alt_count FROM lineitem)
SELECT l_orderkey, l_linenumber, ref_count, alt_count, ref_count + alt_count AS depth, CASE WHEN ref_count + alt_count > 0 THEN round(alt_count / (ref_count + alt_count), 6) END AS vaf, l_orderkey * 10 AS start_position, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_orderkey * 10 + 1 END AS end_position FROM m""")
def mutation_measures(t: Tables) -> DataFrame:
    n, text = F.col("l_linenumber"), lambda c: c.cast("string")
    raw = t.lineitem.select("l_orderkey", "l_linenumber", text(F.col("l_partkey") % 5).alias("r"), F.when(n == 6, ".").otherwise(text(F.col("l_suppkey") % 4)).alias("a"), text(F.col("l_orderkey") * 10).alias("s"), F.when(n == 2, "NA").otherwise(text(F.col("l_orderkey") * 10 + 1)).alias("e"))
    return ST.mutation_measures(raw, "r", "a", "s", "e").withColumn("vaf", r6("vaf")).drop("r", "a", "s", "e")


_SEGMENTS = """raw AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'zz-' ELSE 'aa-' END || lpad((user_id % 100)::VARCHAR, 2, '0') || '-b' || user_id || '-01a-x' AS sample, CASE WHEN event_id % 2 = 0 THEN 'chr' ELSE '' END || (event_id % 24 + 1) AS chromosome, event_id * 10::DOUBLE AS a, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 10::DOUBLE + floor(value) - 5 END AS b, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 50 - 1 END AS v FROM events),
seg AS (SELECT array_to_string(string_split(upper(sample), '-')[1:4], '-') AS sample_barcode, regexp_replace(chromosome, '^chr', '') AS chromosome, a AS start, b AS "end", NULL::DOUBLE AS num_probes, v AS segment_mean, 'events' AS source_file, array_to_string(string_split(upper(sample), '-')[1:3], '-') AS patient_barcode FROM raw WHERE b IS NOT NULL AND v IS NOT NULL AND b >= a AND sample LIKE 'aa-%')"""


def _segments(t: Tables) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    sample = F.concat(F.when(u % 10 == 0, "zz-").otherwise("aa-"), F.lpad((u % 100).cast("string"), 2, "0"), F.lit("-b"), u.cast("string"), F.lit("-01a-x"))
    raw = t.events.select(sample.alias("Sample"), F.concat(F.when(e % 2 == 0, "chr").otherwise(""), (e % 24 + 1).cast("string")).alias("Chromosome"), (e * 10.0).alias("Start"), F.when(e % 11 != 0, e * 10.0 + F.floor("value") - 5).alias("End"), F.when(e % 7 != 0, F.col("value") / 50 - 1).alias("Segment_Mean"))
    return ST.segment_table(raw, {"sample": "Sample", "chromosome": "Chromosome", "start": "Start", "end": "End", "segment_mean": "Segment_Mean"}, "AA-", "events")


@query(f"WITH {_SEGMENTS} SELECT * REPLACE (round(segment_mean, 6) AS segment_mean) FROM seg")
def segment_standardise(t: Tables) -> DataFrame:
    return _segments(t).withColumn("segment_mean", r6("segment_mean"))


@query(f"""WITH {_SEGMENTS} SELECT sample_barcode, count(*) AS n_segments, sum((chromosome IN ({", ".join(f"'{i}'" for i in range(1, 23))}))::INT)::BIGINT AS n_autosomal_segments, round(median(segment_mean), 6) AS median_segment_mean, round(stddev_samp(segment_mean), 6) AS sd_segment_mean, round(max(abs(segment_mean)), 6) AS max_abs_segment_mean,
round(avg((segment_mean >= 0.2)::INT), 6) AS fraction_gain_like, round(avg((segment_mean <= -0.2)::INT), 6) AS fraction_loss_like, count(*) >= 40 AS has_segment_level_cn, CASE WHEN count(*) >= 40 THEN 'usable_segment_cn' ELSE 'insufficient_segments' END AS segment_cn_quality_flag FROM seg GROUP BY 1""")
def segment_quality(t: Tables) -> DataFrame:
    out = ST.segment_quality(_segments(t), least=40)
    return out.withColumns({c: r6(c) for c, kind in out.dtypes if kind == "double"})


@query(f"""WITH {_SEGMENTS}, k AS (SELECT DISTINCT sample_barcode, CASE WHEN substr(sample_barcode, 5, 1) = '1' THEN NULL ELSE 'known' END AS project FROM seg), s AS (SELECT sample_barcode, min(chromosome) AS project, count(*) AS n FROM seg GROUP BY 1)
SELECT s.sample_barcode, coalesce(k.project, s.project) AS project, n FROM s LEFT JOIN k USING (sample_barcode)""")
def join_coalesce_sides(t: Tables) -> DataFrame:
    seg = _segments(t)
    known = seg.select("sample_barcode", F.when(F.substring("sample_barcode", 5, 1) != "1", "known").alias("project")).distinct()
    mine = seg.groupBy("sample_barcode").agg(F.min("chromosome").alias("project"), F.count(F.lit(1)).alias("n"))
    return J.coalesced_join(mine, known, ["sample_barcode"], ["project"])


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 2 THEN l_quantity % 5 + 0.3 ELSE l_quantity % 5 + 0.02 END AS t, CASE WHEN l_linenumber IN (1, 5) THEN NULL ELSE l_suppkey % 4 END AS a, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_partkey % 3 END AS b, CASE WHEN l_linenumber = 7 THEN 'Retained' WHEN l_linenumber = 6 THEN ' odd ' END AS loh, l_discount * CASE WHEN l_linenumber = 2 THEN 1000 ELSE 1 END AS f FROM lineitem),
s0 AS (SELECT *, CASE WHEN t >= 0 AND abs(t - round(t)) <= 0.05 THEN round(t) END AS t0 FROM r), s1 AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) ELSE a END AS a1, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE b END AS b1, coalesce(a < b, false) AS turned FROM s0),
s2 AS (SELECT *, a1 IS NULL AND t0 IS NOT NULL AND b1 IS NOT NULL AS fa, CASE WHEN a1 IS NULL THEN t0 - b1 ELSE a1 END AS a2 FROM s1), s3 AS (SELECT *, b1 IS NULL AND t0 IS NOT NULL AND a2 IS NOT NULL AS fb, CASE WHEN b1 IS NULL THEN t0 - a2 ELSE b1 END AS b2 FROM s2), s4 AS (SELECT *, t0 IS NULL AND a2 IS NOT NULL AND b2 IS NOT NULL AS ft, CASE WHEN t0 IS NULL THEN a2 + b2 ELSE t0 END AS t2 FROM s3),
s5 AS (SELECT *, CASE WHEN a2 IS NOT NULL AND b2 IS NOT NULL THEN greatest(a2, b2) ELSE a2 END AS a3, CASE WHEN a2 IS NOT NULL AND b2 IS NOT NULL THEN least(a2, b2) ELSE b2 END AS b3 FROM s4), s6 AS (SELECT *, coalesce(a3 < 0, false) OR coalesce(b3 < 0, false) OR coalesce(abs(t2 - a3 - b3) > 0.05, false) AS bad FROM s5),
s7 AS (SELECT *, CASE WHEN NOT bad THEN t2 END::DOUBLE AS total_cn, CASE WHEN NOT bad THEN a3 END::DOUBLE AS major_cn, CASE WHEN NOT bad THEN b3 END::DOUBLE AS minor_cn FROM s6), s8 AS (SELECT *, loh IS NULL AND major_cn IS NOT NULL AND minor_cn IS NOT NULL AS derived FROM s7)
SELECT l_orderkey, l_linenumber, total_cn, major_cn, minor_cn, CASE WHEN loh = 'Retained' THEN 'no_LOH' WHEN loh IS NOT NULL THEN 'reported:odd' WHEN derived AND total_cn = 0 THEN 'complete_copy_loss' WHEN derived AND minor_cn = 0 THEN 'LOH' WHEN derived AND minor_cn > 0 THEN 'no_LOH' END AS loh_status, round(CASE WHEN f > 1 AND f <= 100 THEN f / 100 WHEN f BETWEEN 0 AND 1 THEN f END, 6) AS cellular_fraction,
coalesce(nullif(concat_ws(';', CASE WHEN turned THEN 'alleles_ordered' END, CASE WHEN fa THEN 'major_from_total' END, CASE WHEN fb THEN 'minor_from_total' END, CASE WHEN ft THEN 'total_from_alleles' END, CASE WHEN bad THEN 'inconsistent_copies' END, CASE WHEN derived THEN 'loh_from_minor' END, CASE WHEN f > 1 AND f <= 100 THEN 'fraction_from_percent' END), ''), 'none') AS notes FROM s8""")
def allele_copies(t: Tables) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity") % 5
    raw = t.lineitem.select("l_orderkey", "l_linenumber", F.when(n == 3, None).when(n == 2, q + 0.3).otherwise(q + 0.02).alias("t"), F.when(~n.isin(1, 5), F.col("l_suppkey") % 4).alias("a"), F.when(n != 4, F.col("l_partkey") % 3).alias("b"), F.when(n == 7, "Retained").when(n == 6, " odd ").alias("loh"), (F.col("l_discount") * F.when(n == 2, 1000).otherwise(1)).alias("f"))
    return ST.allele_copies(raw, "t", "a", "b", "loh", "f").withColumn("cellular_fraction", r6("cellular_fraction")).drop("t", "a", "b", "loh", "f")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 100) / 100 END AS purity, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey % 7)::DOUBLE END AS ploidy, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 3 - 1)::DOUBLE END AS genome_doublings FROM customer)
SELECT c_custkey, round(purity, 6) AS purity, ploidy, genome_doublings, NULL::DOUBLE AS subclonal_genome_fraction, 'calls' AS source, CASE WHEN genome_doublings >= 1 THEN 'WGD' WHEN genome_doublings IS NOT NULL THEN 'no_WGD' END AS whole_genome_doubling_status, CASE WHEN purity IS NULL AND ploidy IS NULL THEN 'purity_ploidy_missing' ELSE 'direct_or_local_source' END AS notes FROM c""")
def purity_ploidy(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = t.customer.select("c_custkey", F.when(k % 5 == 0, "NA").otherwise(((k % 100) / 100).cast("string")).alias("Tumor Purity"), F.when(k % 10 != 0, (k % 7).cast("string")).alias("PLOIDY"), F.when(k % 3 != 0, k % 3 - 1).alias("Genome doublings"))
    return ST.purity_ploidy(raw, "c_custkey", "calls").withColumn("purity", r6("purity"))


@query("""SELECT c_custkey, (c_custkey % 30)::DOUBLE AS aneuploidy_score, NULL::DOUBLE AS fraction_genome_altered, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 9)::DOUBLE END AS arm_gain_count, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE (c_custkey % 8)::DOUBLE END AS arm_loss_count,
CASE WHEN c_custkey % 4 = 0 AND c_custkey % 6 = 0 THEN NULL ELSE coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 9 END, 0) + coalesce(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 8 END, 0) END::DOUBLE AS total_arm_alteration_count, NULL::DOUBLE AS copy_number_complexity_score, 'calls' AS source FROM customer""")
def copy_metrics(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return ST.copy_metrics(t.customer.select("c_custkey", (k % 30).alias("Aneuploidy"), F.when(k % 4 != 0, k % 9).alias("Gain.Count"), F.when(k % 6 != 0, k % 8).alias("loss_count")), "c_custkey", "calls")


_WIDE = """w AS (SELECT c_custkey, '1p' AS chromosome_arm, CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN ' Loss' WHEN 2 THEN '' ELSE '0' END AS arm_call FROM customer UNION ALL SELECT c_custkey, '13q', CASE c_custkey % 3 WHEN 0 THEN 'AMP' WHEN 1 THEN '-1' END FROM customer),
wide AS (SELECT c_custkey, chromosome_arm, arm_call, trim(lower(arm_call)) IN ('1', '+1', 'gain', 'amp', 'amplification') AS is_gain, trim(lower(arm_call)) IN ('-1', 'loss', 'del', 'deletion') AS is_loss FROM w WHERE arm_call <> '')"""


def _wide_calls(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return ST.wide_arm_calls(t.customer.select("c_custkey", F.lit("x").alias("Type"), F.lit(1).alias("Aneuploidy Score"), case(k, "1", " Loss", "", "0").alias("1p"), case(k, "AMP", "-1", None).alias("13 (13q)")), "c_custkey")


@query(f"WITH {_WIDE} SELECT * FROM wide")
def arm_calls_wide(t: Tables) -> DataFrame:
    return _wide_calls(t)


_LONG_CALLS = """c AS (SELECT l_orderkey, (l_partkey % 22) || 'p' AS chromosome_arm, CASE l_linenumber % 5 WHEN 0 THEN 'Gain' WHEN 1 THEN 'deep-del' WHEN 2 THEN ' 1 ' WHEN 3 THEN 'gain-like' ELSE 'neutral' END AS arm_call FROM lineitem),
calls AS (SELECT *, regexp_matches(lower(trim(arm_call)), 'gain|amp|\\+|^1$') AS is_gain, regexp_matches(lower(trim(arm_call)), 'loss|del|-|^-1$') AS is_loss FROM c)"""


def _long_calls(t: Tables) -> DataFrame:
    raw = t.lineitem.select("l_orderkey", F.concat((F.col("l_partkey") % 22).cast("string"), F.lit("p")).alias("Arm"), case(F.col("l_linenumber"), "Gain", "deep-del", " 1 ", "gain-like", "neutral").alias("Call"))
    return ST.long_arm_calls(raw, "l_orderkey", "Arm", "Call")


@query(f"WITH {_LONG_CALLS} SELECT * FROM calls")
def arm_calls_long(t: Tables) -> DataFrame:
    return _long_calls(t)


@query(f"WITH {_LONG_CALLS} SELECT l_orderkey, sum(is_gain::INT)::BIGINT AS arm_gain_count, sum(is_loss::INT)::BIGINT AS arm_loss_count, sum((is_gain OR is_loss)::INT)::BIGINT AS total_arm_alteration_count FROM calls GROUP BY 1")
def arm_summary(t: Tables) -> DataFrame:
    return ST.arm_summary(_long_calls(t), ["l_orderkey"])


@query(f"""WITH {_WIDE}, a AS (SELECT c_custkey, sum(is_gain::INT)::DOUBLE AS gains FROM wide GROUP BY 1), b AS (SELECT o_custkey AS c_custkey, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1), base AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 7.0 END AS gains, NULL::DOUBLE AS price FROM customer)
SELECT c_custkey, coalesce(base.gains, a.gains) AS gains, b.price, concat_ws(';', CASE WHEN a.c_custkey IS NOT NULL THEN 'arms' END, CASE WHEN b.c_custkey IS NOT NULL THEN 'orders' END) AS sources FROM base LEFT JOIN a USING (c_custkey) LEFT JOIN b USING (c_custkey)""")
def copy_number_assembly(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 7.0).alias("gains"), F.lit(None).cast("double").alias("price"))
    arms = ST.arm_summary(_wide_calls(t), ["c_custkey"]).select("c_custkey", F.col("arm_gain_count").cast("double").alias("gains"))
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"), "o_orderkey")
    out, warnings = ST.assembled(base, [("arms", arms), ("nations", t.customer.select("c_custkey", "c_nationkey")), ("orders", orders)], "c_custkey", ["gains", "price"], order="o_orderkey")
    if len(warnings) != 1:
        raise ValueError(f"one source has no values, not {warnings}")
    return out


@query("SELECT user_id, event_type, round(avg(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END), 6) AS value FROM events GROUP BY 1, 2")
def duplicate_mean_collapse(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value")).alias("value"))
    return ST.mean_of_repeats(e, ["user_id", "event_type"], "value").withColumn("value", r6("value"))


# ---- features

_GROUPS = {"purity_ploidy": ["purity", "ploidy"], "copy_number_aneuploidy": ["aneuploidy_score", "arm_gain_count"], "mutation_count_proxy": ["nonsynonymous_count"], "expression_pca": ["expression_pca_PC1"]}


@query("""WITH f AS (SELECT * FROM (VALUES ('purity', 'purity_ploidy', 'continuous', 'purity_ploidy', 'WES'), ('ploidy', 'purity_ploidy', 'continuous', 'purity_ploidy', 'WES'), ('aneuploidy_score', 'copy_number_aneuploidy', 'continuous', 'aneuploidy_arm_level_copy_number', 'WES'), ('arm_gain_count', 'copy_number_aneuploidy', 'count', 'aneuploidy_arm_level_copy_number', 'WES'), ('nonsynonymous_count', 'mutation_count_proxy', 'count', 'somatic_mutation', 'WES'), ('expression_pca_PC1', 'expression_pca', 'continuous', 'expression_pca', 'WTS')) x(name, feature_class, feature_type, source_layer, clinical_modality)
UNION ALL SELECT 'driver_mutation_' || p_brand, 'driver_mutation_binary', 'binary', 'somatic_mutation', 'WES' FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'driver_mutation_count_' || p_brand, 'driver_mutation_count', 'count', 'somatic_mutation', 'WES' FROM (SELECT DISTINCT p_brand FROM part)),
p AS (SELECT 'driver_mutation_' || p_brand AS name, median(p_size) AS median FROM part GROUP BY 1 HAVING median(p_size) > 25) SELECT f.*, p.median, p.name IS NOT NULL AS retained FROM f LEFT JOIN p USING (name)""")
def feature_catalogue(t: Tables) -> DataFrame:
    binary, count = FE.driver_names(F.col("p_brand"))
    brands = t.part.select("p_brand").distinct()
    features = FE.definition_table(t.spark, _GROUPS).unionAll(brands.select(binary, F.lit("driver_mutation_binary"))).unionAll(brands.select(count, F.lit("driver_mutation_count")))
    fitted = t.part.groupBy(binary.alias("name")).agg(F.median("p_size").alias("median")).where("median > 25")
    return FE.feature_catalogue(features, fitted)


@query("""WITH n AS (SELECT unnest(['tmb_proxy_', 'mutation_prevalence_', 'median_purity', 'median_', 'median_lineage_or_tissue_PC', 'x_']) || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN '_score' ELSE p_brand END AS name FROM part)
SELECT name, CASE WHEN name LIKE 'tmb~_proxy~_%' ESCAPE '~' THEN 'mutation_count_proxy' WHEN name LIKE 'mutation~_prevalence~_%' ESCAPE '~' THEN 'driver_mutation_prevalence' WHEN name = 'median_purity' THEN 'copy_number_purity_ploidy' WHEN regexp_matches(name, '^median_.*score$') OR starts_with(name, 'median_lineage_or_tissue_PC') THEN 'expression' ELSE 'other' END AS category, count(*) AS n FROM n GROUP BY 1, 2""")
def feature_categories(t: Tables) -> DataFrame:
    heads = F.explode(F.array(*map(F.lit, ["tmb_proxy_", "mutation_prevalence_", "median_purity", "median_", "median_lineage_or_tissue_PC", "x_"])))
    size = F.col("p_size") % 3
    names = t.part.select(heads.alias("h"), F.when(size == 0, "").when(size == 1, "_score").otherwise(F.col("p_brand")).alias("t")).select(F.concat("h", "t").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("category", FE.category(F.col("name")))


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS a, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_custkey::VARCHAR END AS b, c_name AS c, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '1.5' END AS d FROM customer), u AS (UNPIVOT c ON a, b, c, d INTO NAME name VALUE v) SELECT name, count(TRY_CAST(v AS DOUBLE)) = count(*) AS every FROM u GROUP BY 1 HAVING count(TRY_CAST(v AS DOUBLE)) > 0""")
def numeric_columns(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    df = t.customer.select(k.cast("string").alias("a"), F.when(k % 2 == 0, "x").otherwise(k.cast("string")).alias("b"), F.col("c_name").alias("c"), F.when(k % 3 != 0, "1.5").alias("d"), k.alias("e_source"))
    every = FE.numeric_columns(df, every=True)
    return t.spark.createDataFrame([(c, c in every) for c in FE.by_number(FE.numeric_columns(df))], "name string, every boolean")


@query("SELECT c_nationkey, round(avg(c_acctbal), 6) AS median_balance, max(c_custkey)::DOUBLE AS median_key, count(*)::DOUBLE AS balance_n_samples FROM customer GROUP BY 1")
def project_features(t: Tables) -> DataFrame:
    table = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"), F.max("c_custkey").cast("string").alias("key"), F.count(F.lit(1)).alias("n_samples"), F.lit(0.1).alias("missingness_balance"))
    features, support = FE.project_features(table, ["c_nationkey"], "n_samples", "balance_n_samples", "median_")
    return J.left_join_filled(features, support, ["c_nationkey"], {}).withColumn("median_balance", r6("median_balance"))


@query("SELECT c_custkey, c_name, first.o_orderstatus AS status, first.o_totalprice AS price FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, min({'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice}) AS first FROM orders GROUP BY 1) USING (c_custkey)")
def replace_and_join(t: Tables) -> DataFrame:
    stale = t.customer.select("c_custkey", "c_name", F.lit("old").alias("status"), F.lit(0.0).alias("price"))
    return FE.replaced_columns(stale, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), ["c_custkey"])


@query("SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'Unannotated' ELSE n_name || '!' END AS kind, 'none' AS site FROM nation")
def annotation_defaults(t: Tables) -> DataFrame:
    given = t.nation.select("n_name", F.when(F.col("n_nationkey") % 4 != 0, F.concat("n_name", F.lit("!"))).alias("kind"))
    return FE.with_defaults(given, {"kind": "Unannotated", "site": "none"})


@query("""WITH c AS (SELECT r_name AS group_name, string_agg(n_name || CASE WHEN n_nationkey % 6 = 0 THEN '?' ELSE '' END, ';' ORDER BY n_nationkey DESC) AS candidates FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'nobody', 'x;y'), m AS (SELECT group_name, unnest(string_split(candidates, ';')) AS member, generate_subscripts(string_split(candidates, ';'), 1) AS place FROM c),
a AS (SELECT DISTINCT n_name AS member FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0) SELECT group_name, coalesce(string_agg(a.member, ';' ORDER BY place), '') AS included, count(a.member) AS n_members FROM m LEFT JOIN a USING (member) GROUP BY 1""")
def group_definitions(t: Tables) -> DataFrame:
    one = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.struct((-F.col("n_nationkey")).alias("at"), F.concat("n_name", F.when(F.col("n_nationkey") % 6 == 0, "?").otherwise("")).alias("m")).alias("m"))
    groups = one.groupBy(F.col("r_name").alias("group_name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["m"]), ";").alias("candidates"))
    groups = groups.unionAll(t.spark.createDataFrame([("nobody", "x;y")], "group_name string, candidates string"))
    available = t.nation.join(t.customer.where("c_acctbal > 0"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("member"))
    return FE.member_groups(groups, available)


@query("""WITH v AS (SELECT c_mktsegment, sum(greatest(c_acctbal, 0)) AS v FROM customer GROUP BY 1) SELECT c_mktsegment, round(v / sum(v) OVER (), 6) AS share, round(sum(v) OVER (ORDER BY c_mktsegment) / sum(v) OVER (), 6) AS cumulative_share FROM v""")
def cumulative_variance(t: Tables) -> DataFrame:
    v = t.customer.groupBy("c_mktsegment").agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("v"))
    return FE.cumulative_share(v, "v", "c_mktsegment").select("c_mktsegment", r6("share").alias("share"), r6("cumulative_share").alias("cumulative_share"))


@query("SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 9) AS share FROM orders")
def share_of_total(t: Tables) -> DataFrame:
    return FE.share_of_total(t.orders, "o_totalprice").select("o_orderkey", F.round("share", 9).alias("share"))


# ---- casework

_CASES = """ref AS (SELECT * FROM (VALUES ('balance', 'continuous', 4000.0, 4500.0, 900.0, 'WES'), ('nation', 'count', 12.0, 12.0, 7.0, 'WES'), ('rich', 'binary', 0.0, 0.5, 0.5, 'both'), ('score', 'continuous', 1.0, 2.0, 4.0, 'WTS')) x(feature_name, feature_type, median, mean, std, modality)),
vals AS (SELECT c_custkey AS case_id, 'a.tsv' AS source_file, 'balance' AS feature_name, c_acctbal AS x FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_custkey, 'b.tsv', 'nation', c_nationkey FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'a.tsv', 'rich', (c_acctbal > 5000)::INT FROM customer UNION ALL SELECT c_custkey, 'b.tsv', 'rich', (c_acctbal > 5000)::INT FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'b.tsv', 'unknown', c_custkey FROM customer WHERE c_custkey % 7 = 0),
one AS (SELECT case_id, feature_name, string_agg(DISTINCT source_file, ';' ORDER BY source_file) AS source_file, min(x) AS x FROM vals GROUP BY 1, 2),
audit AS (SELECT c_custkey AS case_id, feature_name, true AS expected_in_reference, feature_type, coalesce(source_file, 'none') AS source_file, x IS NOT NULL AS supplied, x IS NULL AS imputed, coalesce(x, median) AS value_used, (coalesce(x, median) - mean) / std AS scaled_value, CASE WHEN x IS NULL THEN 'imputed_missing_feature' ELSE 'supplied' END AS status FROM customer CROSS JOIN ref LEFT JOIN one ON one.case_id = c_custkey AND one.feature_name = ref.feature_name
UNION ALL SELECT case_id, feature_name, false, 'not_evaluated', source_file, true, false, NULL, NULL, 'extra_not_in_reference_ignored' FROM vals WHERE feature_name = 'unknown')""".replace("SELECT c_custkey AS case_id, feature_name, true", "SELECT c_custkey AS case_id, ref.feature_name, true")


def _reference(t: Tables) -> DataFrame:
    rows = [("balance", "continuous", 4000.0, 4500.0, 900.0, "WES"), ("nation", "count", 12.0, 12.0, 7.0, "WES"), ("rich", "binary", 0.0, 0.5, 0.5, "both"), ("score", "continuous", 1.0, 2.0, 4.0, "WTS")]
    return t.spark.createDataFrame(rows, "feature_name string, feature_type string, median double, mean double, std double, modality string")


def _audit(t: Tables) -> DataFrame:
    k, rich = F.col("c_custkey"), (F.col("c_acctbal") > 5000).cast("int")
    one = lambda file, name, x, keep: t.customer.select(k.alias("case_id"), F.lit(file).alias("source_file"), F.lit(name).alias("feature_name"), F.when(keep, x.cast("string")).alias("raw_value"))
    values = R.union_filled(one("a.tsv", "balance", F.col("c_acctbal"), k % 5 > 0), one("b.tsv", "nation", F.col("c_nationkey"), k % 3 > 0), one("a.tsv", "rich", rich, F.lit(True)), one("b.tsv", "rich", rich, k % 2 == 0), one("b.tsv", "unknown", k, k % 7 == 0))
    return CW.harmonise_cases(values, t.customer.select(k.alias("case_id")), _reference(t).drop("modality"))


@query(f"WITH {_CASES} SELECT * REPLACE (round(value_used, 6) AS value_used, round(scaled_value, 6) AS scaled_value) FROM audit")
def case_harmonise(t: Tables) -> DataFrame:
    return _audit(t).drop("raw_value").withColumns({"value_used": r6("value_used"), "scaled_value": r6("scaled_value")})


@query(f"""WITH {_CASES}, s AS (SELECT case_id, sum(expected_in_reference::INT)::BIGINT AS expected, sum((expected_in_reference AND supplied)::INT)::BIGINT AS supplied, sum((expected_in_reference AND imputed)::INT)::BIGINT AS missing, sum((NOT expected_in_reference)::INT)::BIGINT AS extra, sum(CASE WHEN abs(scaled_value) > 3 THEN 1 ELSE 0 END)::BIGINT AS extreme FROM audit GROUP BY 1)
SELECT *, 100.0 * supplied / expected AS coverage_percent, coalesce(nullif(concat_ws(';', CASE WHEN missing > 0 THEN 'imputed_features' END, CASE WHEN extra > 0 THEN 'extra_features' END, CASE WHEN extreme > 0 THEN 'extreme_values' END, CASE WHEN 100.0 * supplied / expected < 50 THEN 'low_coverage' END), ''), 'none') AS warnings FROM s""")
def case_summary(t: Tables) -> DataFrame:
    return CW.case_summary(_audit(t), 3.0)


@query(f"""WITH {_CASES}, m AS (SELECT feature_name, modality FROM ref WHERE modality <> 'both' UNION ALL SELECT r.feature_name, g.modality FROM ref r, (SELECT DISTINCT modality FROM ref WHERE modality <> 'both') g WHERE r.modality = 'both') SELECT case_id, modality, round(avg(supplied::INT), 6) AS coverage, count(*) AS n_features FROM audit JOIN m USING (feature_name) WHERE expected_in_reference GROUP BY 1, 2""")
def feature_coverage(t: Tables) -> DataFrame:
    return CW.coverage_by(_audit(t), _reference(t).select("feature_name", "modality"), "modality").withColumn("coverage", r6("coverage"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1), p AS (SELECT CASE WHEN o_custkey % 40 = 1 THEN -o_custkey ELSE o_custkey END AS o_custkey, CASE WHEN o_custkey % 10 = 0 THEN n + 1 ELSE n END AS n, CASE WHEN o_custkey % 15 = 0 THEN s * 1.001 ELSE s END AS s FROM c),
j AS (SELECT coalesce(c.o_custkey, p.o_custkey) AS o_custkey, p.o_custkey IS NULL AS a, c.o_custkey IS NULL AS b, c.n <> p.n AS n, abs(c.s - p.s) > 1e-8 + 1e-8 * abs(p.s) AS s FROM c FULL JOIN p ON c.o_custkey = p.o_custkey) SELECT o_custkey, concat_ws(';', CASE WHEN a THEN 'only_calculated' END, CASE WHEN b THEN 'only_provided' END, CASE WHEN n THEN 'n' END, CASE WHEN s THEN 's' END) AS differs_in FROM j WHERE a OR b OR n OR s""")
def recomputed_summary(t: Tables) -> DataFrame:
    c = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    k = F.col("o_custkey")
    given = c.select(F.when(k % 40 == 1, -k).otherwise(k).alias("o_custkey"), F.when(k % 10 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(k % 15 == 0, F.col("s") * 1.001).otherwise(F.col("s")).alias("s"))
    return CW.summary_differences(c, given, "o_custkey", ["n"], ["s"])


@query("""WITH n AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS neighbour_id, l_discount AS distance, 1 / (1 + l_discount) + CASE WHEN l_tax = 0.08 THEN 0.01 ELSE 0 END AS similarity, CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'cosine' ELSE 'euclidean' END AS metric FROM lineitem)
SELECT 'similarity' AS fault, sum((abs(similarity - 1 / (1 + distance)) > 1e-8)::INT)::BIGINT AS n FROM n UNION ALL SELECT 'repeated_rank', count(*) FROM (SELECT 1 FROM n GROUP BY query_id, rank HAVING count(*) > 1) UNION ALL SELECT 'repeated_neighbour', count(*) FROM (SELECT 1 FROM n GROUP BY query_id, neighbour_id HAVING count(*) > 1) UNION ALL SELECT 'metric', count(*) FROM (SELECT 1 FROM n GROUP BY query_id HAVING count(DISTINCT metric) > 1) UNION ALL SELECT 'unknown_neighbour', count(*) FROM n WHERE neighbour_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 > 0)""")
def neighbour_faults(t: Tables) -> DataFrame:
    n = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("neighbour_id"), F.col("l_discount").alias("distance"), (1 / (1 + F.col("l_discount")) + F.when(F.col("l_tax") == 0.08, 0.01).otherwise(0.0)).alias("similarity"), F.when(F.expr("l_linestatus = 'F' and l_linenumber = 1"), "cosine").otherwise("euclidean").alias("metric"))
    return CW.neighbour_faults(n, t.part.where("p_partkey % 11 > 0").select("p_partkey"))


@query("""WITH m AS (SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 300000) SELECT 'no_rows' AS fault, (count(*) = 0)::BIGINT AS n FROM m UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT 1 FROM m GROUP BY c_custkey HAVING count(*) > 1) UNION ALL SELECT 'missing_key', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM m) UNION ALL SELECT 'no_features', 0""")
def matrix_faults(t: Tables) -> DataFrame:
    m = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    return CW.matrix_faults(m, t.customer, "c_custkey", ["o_orderstatus"])


@query("""WITH kv AS (SELECT r_name AS qc_section, n_name AS metric, max(n_nationkey::VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), w AS (SELECT * FROM (VALUES ('ASIA', 'NATION_2'), ('ASIA', 'none'), ('EUROPE', 'NATION_3')) x(qc_section, metric)) SELECT qc_section, metric, coalesce(value, 'NA') AS value FROM w LEFT JOIN kv USING (qc_section, metric)""")
def key_value_lookup(t: Tables) -> DataFrame:
    kv = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("qc_section"), F.col("n_name").alias("metric"), F.col("n_nationkey").cast("string").alias("value"))
    return CW.key_value(kv, [("ASIA", "NATION_2"), ("ASIA", "none"), ("EUROPE", "NATION_3")])


@query("""WITH s AS (SELECT o_custkey AS c_custkey, count(*) AS n_segments, count(*) >= 12 AS has, CASE WHEN o_custkey % 4 = 0 THEN 'patient' ELSE 'sample' END AS lvl FROM orders GROUP BY o_custkey), c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'descriptive_only' WHEN 1 THEN 'clonal_clustering_candidate_limited_cn' ELSE 'copy_number_aware_clonal_phylogeny_candidate' END AS cls, c_acctbal > 0 AS ok, CASE WHEN c_custkey % 9 = 0 THEN 'few_mutations' ELSE 'none' END AS why FROM customer)
SELECT c_custkey, ok AS counts, why AS exclusion_reason, n_segments, coalesce(has, false) AS has_segment_level_cn, coalesce(lvl, 'NA') AS segment_cn_match_level, CASE WHEN has AND lvl = 'sample' AND ok AND why = 'none' THEN 'copy_number_aware_clonal_phylogeny_candidate' WHEN NOT coalesce(has, false) AND cls <> 'descriptive_only' THEN 'clonal_clustering_candidate_limited_cn' ELSE cls END AS candidate_class FROM c LEFT JOIN s USING (c_custkey)""")
def candidate_upgrade(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    c = t.customer.select("c_custkey", case(k, "descriptive_only", CW.LIMITED, CW.AWARE).alias("candidate_class"), (F.col("c_acctbal") > 0).alias("counts"), F.when(k % 9 == 0, "few_mutations").otherwise("none").alias("exclusion_reason"), F.lit(0).alias("n_segments"))
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_segments")).withColumns({"has_segment_level_cn": F.col("n_segments") >= 12, "segment_cn_match_level": F.when(k % 4 == 0, "patient").otherwise("sample")})
    return CW.upgraded(c, s, "c_custkey", ["counts"])


# ---- manifests

_HITS = """k AS (SELECT c_custkey AS k, 'AA-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-P' || (c_custkey % 200) AS patient FROM customer),
h AS (SELECT k AS file_id, patient, CASE WHEN k % 3 = 0 THEN patient || '-01A' END AS sample, CASE WHEN k % 4 = 0 THEN lower(patient) || '-02B-XYZ99.seg' WHEN k % 4 = 1 THEN patient || '.txt' ELSE 'plain.txt' END AS file_name, CASE WHEN k % 4 = 0 THEN patient || '-02B-XYZ99' WHEN k % 4 = 1 THEN patient END AS named FROM k)"""


def _hits(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    patient = F.concat(F.lit("AA-"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit("-P"), (k % 200).cast("string"))
    name = F.when(k % 4 == 0, F.concat(F.lower(patient), F.lit("-02B-XYZ99.seg"))).when(k % 4 == 1, F.concat(patient, F.lit(".txt"))).otherwise("plain.txt")
    samples = F.when(k % 3 == 0, F.array(F.struct(F.concat(patient, F.lit("-01A")).alias("submitter_id"))))
    cases = F.when(k % 5 != 0, F.array(F.struct(F.lit("P1").alias("project"), patient.alias("submitter_id"), samples.alias("samples"))))
    return t.customer.select(k.alias("file_id"), name.alias("file_name"), cases.alias("cases"))


@query(f"""WITH {_HITS}, s AS (SELECT file_id, CASE WHEN file_id % 5 > 0 THEN 'P1' ELSE '' END AS project_ids, list_distinct(list_filter([CASE WHEN file_id % 5 > 0 THEN sample END, CASE WHEN length(named) >= 13 THEN named END], lambda x: x IS NOT NULL)) AS s, list_distinct(list_filter([CASE WHEN file_id % 5 > 0 THEN patient END, CASE WHEN length(named) < 13 THEN named END], lambda x: x IS NOT NULL)) AS c FROM h)
SELECT file_id, project_ids, array_to_string(list_sort(c), ';') AS case_ids, array_to_string(list_sort(s), ';') AS sample_ids, array_to_string(list_sort(list_filter(s, lambda x: length(x) > 13)), ';') AS aliquot_ids FROM s""")
def nested_hit_ids(t: Tables) -> DataFrame:
    out = MA.hit_ids(_hits(t), _ID, 13)
    return out.select("file_id", *[F.array_join(c, ";").alias(c) for c in ("project_ids", "case_ids", "sample_ids", "aliquot_ids")])


_COHORT = "cohort AS (SELECT DISTINCT 'AA-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-P' || (c_custkey % 200) AS patient, 'AA-' || lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-P' || (c_custkey % 200) || CASE WHEN c_custkey % 2 = 0 THEN '-01A' ELSE '-05A' END AS sample FROM customer WHERE c_custkey % 6 < 3)"


def _cohort(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    patient = F.concat(F.lit("AA-"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit("-P"), (k % 200).cast("string"))
    return t.customer.where(k % 6 < 3).select(patient.alias("patient"), F.concat(patient, F.when(k % 2 == 0, "-01A").otherwise("-05A")).alias("sample")).distinct()


@query(f"""WITH {_HITS}, {_COHORT}, ids AS (SELECT file_id, list_filter([CASE WHEN file_id % 5 > 0 THEN sample END, CASE WHEN length(named) >= 13 THEN named END], lambda x: x IS NOT NULL) AS s, list_filter([CASE WHEN file_id % 5 > 0 THEN patient END, CASE WHEN length(named) < 13 THEN named END], lambda x: x IS NOT NULL) AS c FROM h),
bs AS (SELECT DISTINCT file_id, cohort.sample, cohort.patient, 'sample' AS match_level FROM (SELECT file_id, unnest(s) AS x FROM ids) JOIN cohort ON array_to_string(string_split(x, '-')[1:4], '-') = cohort.sample), rest AS (SELECT * FROM ids WHERE file_id NOT IN (SELECT file_id FROM bs)),
pt AS (SELECT patient, string_agg(DISTINCT sample, ';' ORDER BY sample) AS sample FROM cohort GROUP BY 1), bp AS (SELECT DISTINCT file_id, pt.sample, pt.patient, 'patient' AS match_level FROM (SELECT file_id, unnest(list_concat(s, c)) AS x FROM rest) JOIN pt ON array_to_string(string_split(x, '-')[1:3], '-') = pt.patient)
SELECT * FROM bs UNION ALL SELECT * FROM bp UNION ALL SELECT file_id, 'NA', 'NA', 'unmatched' FROM rest WHERE file_id NOT IN (SELECT file_id FROM bp)""")
def manifest_matching(t: Tables) -> DataFrame:
    return MA.matched_hits(MA.hit_ids(_hits(t), _ID, 13), _cohort(t))


@query("SELECT 'second' AS filter_name, c_custkey AS hit FROM customer WHERE c_custkey // 20 * 20 < 60")
def paginated_search(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    total = t.customer.count()
    second = t.customer.groupBy((F.floor(k / 20) * 20).alias("page_offset")).agg(F.collect_list("c_custkey").alias("hits"))
    pages = second.select(F.lit("second").alias("filter_name"), "page_offset", F.lit(total).alias("total"), "hits")
    pages = pages.unionAll(t.spark.createDataFrame([("first", 0, 0, [])], "filter_name string, page_offset long, total int, hits array<long>"))
    hits, cut = MA.first_pages(pages, ["first", "second"], 60)
    if not cut:
        raise ValueError("the cap must cut this search")
    return hits


@query("""SELECT p_partkey, p_type FROM part ORDER BY CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 9 END, p_size DESC, p_partkey LIMIT 50""")
def download_cap(t: Tables) -> DataFrame:
    return MA.capped(t.part, "pilot_capped", 50, [MA.priority(F.col("p_type"), ["STANDARD", "ECONOMY"]), F.desc("p_size"), F.col("p_partkey")]).select("p_partkey", "p_type")


@query(f"""WITH {_COHORT}, f AS (SELECT 'AA-' || lpad((s_suppkey % 90)::VARCHAR, 2, '0') || '-P' || (s_suppkey % 200) AS patient, s_suppkey % 5 AS k FROM supplier), a AS (SELECT patient, bool_or(k = 0) AS tumor_bam, bool_or(k IN (1, 4)) AS normal_bam, bool_or(k = 2) AS vcf, bool_or(k = 3) AS pileup FROM f GROUP BY 1),
x AS (SELECT cohort.patient, sample, sample LIKE '%5A' AS has_alleles, coalesce(tumor_bam, false) AS tumor_bam, coalesce(normal_bam, false) AS normal_bam, coalesce(vcf, false) AS vcf, coalesce(pileup, false) AS pileup FROM cohort LEFT JOIN a USING (patient))
SELECT *, coalesce(nullif(concat_ws(';', CASE WHEN NOT has_alleles AND NOT tumor_bam AND NOT pileup THEN 'tumor_bam_or_counts' END, CASE WHEN NOT has_alleles AND NOT normal_bam AND NOT pileup THEN 'normal_bam_or_counts' END, CASE WHEN NOT has_alleles AND NOT pileup THEN 'pileup_or_equivalent' END), ''), 'none') AS missing_inputs FROM x""")
def readiness_manifest(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    patient = F.concat(F.lit("AA-"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit("-P"), (k % 200).cast("string"))
    files = t.supplier.select(F.concat(F.lit("/data/"), patient, case(k, "-01A.bam", "-11A.cram", ".vcf.gz", "_snp_pileup.csv", "-01A_blood.bam")).alias("path"))
    files = files.unionAll(t.spark.createDataFrame([("/data/readme.md",)], "path string"))
    samples = _cohort(t).withColumn("has_alleles", F.col("sample").endswith("5A"))
    return MA.readiness(samples, files, "[A-Z]{2}-[0-9]{2}-P[0-9]+(?:-[0-9]{2}[A-Z]?)?")


@query("SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, coalesce(CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END, 'NA') AS flag FROM lineitem WHERE l_returnflag = 'R'")
def preview_export(t: Tables) -> DataFrame:
    df = t.lineitem.withColumn("flag", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")))
    return MA.preview(df, F.col("l_returnflag") == "R", ["l_orderkey", "l_linenumber", "flag"])


# ---- joins, sets and shapes


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def checked_join(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.checked_join(o, t.customer.select("c_custkey", "c_name"), ["c_custkey"]).select("o_orderkey", "c_name")


@query("SELECT a.n_name AS n_name_a, b.n_name AS n_name_b, a.n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def unordered_pairs(t: Tables) -> DataFrame:
    return J.unordered_pairs(t.nation.select("n_name", "n_regionkey"), "n_name", on=["n_regionkey"])


@query("SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1) RIGHT JOIN customer USING (c_custkey)")
def right_outer_join(t: Tables) -> DataFrame:
    n = t.orders.where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return J.keep_update(n, t.customer.select("c_custkey"), ["c_custkey"])


@query("SELECT o_orderkey, m.c_custkey FROM orders JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey))) m ON o_custkey % 25 = m.c_nationkey")
def inner_keyed_lookup(t: Tables) -> DataFrame:
    n = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("c_custkey"))
    few = n.join(n.agg(F.min("n").alias("n")), "n").select("c_nationkey", "c_custkey")
    return J.looked_up(t.orders.select("o_orderkey", (F.col("o_custkey") % 25).alias("c_nationkey")), few, ["c_nationkey"]).select("o_orderkey", "c_custkey")


@query("SELECT s_suppkey, coalesce(r_name, 'none') AS r_name FROM supplier LEFT JOIN region ON s_nationkey = r_regionkey")
def mapped_default(t: Tables) -> DataFrame:
    return J.mapped(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("r_regionkey")), t.region, "r_regionkey", "r_name", "none").drop("r_regionkey")


@query("SELECT c_custkey, unnest(['c_acctbal', 'c_nationkey']) AS metric, unnest([c_acctbal::DOUBLE, c_nationkey::DOUBLE]) AS value FROM customer")
def unpivot_metrics(t: Tables) -> DataFrame:
    return R.lengthen(t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey")), ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query("SELECT metric, sum(CASE WHEN s = 'AUTOMOBILE' THEN v END) AS AUTOMOBILE, sum(CASE WHEN s = 'BUILDING' THEN v END) AS BUILDING FROM (SELECT c_mktsegment AS s, unnest(['n', 'most']) AS metric, unnest([count(*)::DOUBLE, max(c_custkey)::DOUBLE]) AS v FROM customer GROUP BY c_mktsegment) GROUP BY 1")
def transposed_matrix(t: Tables) -> DataFrame:
    wide = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("c_custkey").cast("double").alias("most"))
    return R.transposed(wide, "c_mktsegment", ["n", "most"], ["AUTOMOBILE", "BUILDING"])


@query("""WITH s AS (SELECT user_id, event_type AS scenario, avg(value) AS v FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2), p AS (SELECT user_id, max(CASE WHEN scenario = 'click' THEN v END) AS c, max(CASE WHEN scenario = 'view' THEN v END) AS v, max(CASE WHEN scenario = 'error' THEN v END) AS e FROM s GROUP BY 1)
SELECT user_id, round(c, 6) AS click, round(v, 6) AS "view", round(e, 6) AS error, round(v - c, 6) AS view_minus_click, round(e - c, 6) AS error_minus_click FROM p""")
def scenario_differences(t: Tables) -> DataFrame:
    s = t.events.where(F.col("event_type").isin("click", "view", "error")).groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    out = A.scenario_differences(s, ["user_id"], "event_type", "v", "click", ["view", "error"])
    return out.select("user_id", *[r6(c).alias(c) for c in out.columns if c != "user_id"])


@query("SELECT user_id, bool_or(value > 100) AS any_high, bool_and(value > 1) AS all_low, list_sort(list(DISTINCT event_type)) = ['click', 'error', 'purchase', 'signup', 'view'] AS has_all FROM events GROUP BY 1")
def any_all_of_group(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.bool_or(F.col("value") > 100).alias("any_high"), F.bool_and(F.col("value") > 1).alias("all_low"), (F.array_sort(F.collect_set("event_type")) == F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))).alias("has_all"))


@query("""WITH want AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1), r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_acctbal >= 0) SELECT c_custkey, c_nationkey FROM r JOIN want USING (c_nationkey) WHERE r <= n""")
def replacement_selection(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return SE.replacement(c.where("c_acctbal < 0"), c.where("c_acctbal >= 0"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "c_nationkey")


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 7")
def set_intersection(t: Tables) -> DataFrame:
    k = t.lineitem.select(F.col("l_partkey").alias("k"), "l_returnflag", "l_linenumber")
    return R.set_intersection(k.where("l_returnflag = 'R'"), k.where("l_linenumber = 7"), ["k"])


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_union(t: Tables) -> DataFrame:
    return R.set_union(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), ["k"])


@query("SELECT 'orders_in_lineitem' AS pair, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) = 0 AS same UNION ALL SELECT 'nations', true")
def same_members(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey")
    pairs = [("orders_in_lineitem", R.same_members(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), ["k"])), ("nations", R.same_members(n, n.unionAll(n), ["n_nationkey"]))]
    return t.spark.createDataFrame(pairs, "pair string, same boolean")


@query("SELECT p_partkey, regexp_extract('x_' || p_brand || '_PC' || p_size, '#([0-9]+)', 1)::INT AS number, regexp_extract('x_' || p_brand || '_PC' || p_size, 'PC([0-9]+)$', 1)::INT AS component FROM part")
def regex_extracted(t: Tables) -> DataFrame:
    text = F.concat(F.lit("x_"), "p_brand", F.lit("_PC"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", S.extracted_number(text, "#([0-9]+)").alias("number"), S.extracted_number(text, "PC([0-9]+)$").alias("component"))


@query(f"{_NATIONS}, u AS (SELECT row, feature, (substr(feature, 7)::INT % 3 + 1) AS w, value / nullif(max(value) OVER p - min(value) OVER p, 0) AS u FROM lng WINDOW p AS (PARTITION BY feature)) SELECT a.row AS a, b.row AS b, round(sum(a.w * abs(a.u - b.u)) / sum(a.w), 6) AS distance FROM u a JOIN u b USING (feature) WHERE a.row < b.row GROUP BY 1, 2")
def weighted_gower(t: Tables) -> DataFrame:
    long = _nations(t)
    weights = long.select("feature").distinct().withColumn("weight", (F.substring("feature", 7, 9).cast("int") % 3 + 1).cast("double"))
    return M.gower(long, weights=weights).withColumn("distance", r6("distance"))


@query(_knn("euclidean", "q.label <> r.label") + " SELECT query_id, rank, neighbour_id, distance FROM nn")
def nearest_other_group(t: Tables) -> DataFrame:
    return M.nearest(t.vectors, t.vectors, 10, group="label").select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbour_id", F.round("distance", 9).alias("distance"))


@query(f"""{_LONG}, c AS (SELECT row, feature, CASE WHEN feature = 'view' THEN 5.0 ELSE value END AS value FROM lng), med AS (SELECT feature, median(value) AS m FROM c GROUP BY 1 HAVING stddev_samp(value) > 1e-8), fil AS (SELECT r.row, med.feature, coalesce(c.value, m) AS value FROM (SELECT DISTINCT row FROM lng) r CROSS JOIN med LEFT JOIN c ON c.row = r.row AND c.feature = med.feature)
SELECT row, feature, round((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END, 5) AS scaled FROM fil WINDOW w AS (PARTITION BY feature)""")
def impute_scale_sample(t: Tables) -> DataFrame:
    """Sample deviations, and features without spread left out."""
    long = _long(t).withColumn("value", F.when(F.col("feature") == "view", 5.0).otherwise(F.col("value")))
    cells, _ = M.impute_scale(long, long.select("row").distinct(), max_missing=1.0, ddof=1, drop_constant=True)
    return cells.select("row", "feature", F.round("scaled", 5).alias("scaled"))


@query("SELECT event_id, round(log2(1 + CASE WHEN v >= 0 THEN v END), 6) AS linear, round(v, 6) AS log FROM (SELECT event_id, value - 5 AS v FROM events)")
def library_scales(t: Tables) -> DataFrame:
    v = t.events.select("event_id", (F.col("value") - 5).alias("value"))
    both = M.library_normalised(M.library_normalised(v, "event_id", "linear").withColumnRenamed("normalised", "linear"), "event_id", "log")
    return both.select("event_id", r6("linear").alias("linear"), r6("normalised").alias("log"))


# ---- sources, sinks and contracts


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal > 0 AS positive FROM customer")
def tsv_round_trip(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "tsv")
    k = F.col("c_custkey")
    sinks.write_tsv(t.customer.select("c_custkey", F.when(k % 4 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_acctbal") > 0, "Yes").otherwise("0").alias("positive"), F.lit("x").alias("unread")), path, gzip=True)
    back = readers.read_delimited(t.spark, path, columns=["c_custkey", "c_name", "positive"])
    return back.withColumn("positive", S.boolean(F.col("positive")))


@query("SELECT n_nationkey, n_name, n_regionkey, NULL::VARCHAR AS extra FROM nation")
def parquet_round_trip(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "parquet")
    sinks.write_parquet(t.nation.withColumn("unread", F.lit(1)), path, ["n_regionkey"])
    return readers.read_parquet_columns(t.spark, path, ["n_nationkey", "n_name", "n_regionkey"], ["extra"])


@query("SELECT n_name AS name, n_nationkey * 1.5::DOUBLE AS cut, n_regionkey > 2 AS high FROM nation")
def json_round_trip(t: Tables) -> DataFrame:
    """A bounded dimension written as one JSON text and read again."""
    path = shared_path(t.spark, "json") + ".json"
    rows = [{"name": r["n_name"], "cut": r["n_nationkey"] * 1.5, "high": r["n_regionkey"] > 2} for r in t.nation.collect()]
    sinks.write_json(t.spark, rows, path)
    sinks.check_outputs(t.spark, [path])
    return readers.read_auto(t.spark, path).select("name", "cut", "high")


@query("SELECT c_mktsegment AS feature, c_nationkey::VARCHAR AS sample, count(*)::DOUBLE AS value FROM customer WHERE c_nationkey < 5 GROUP BY 1, 2")
def matrix_round_trip(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "matrix")
    long = t.customer.where("c_nationkey < 5").groupBy("c_mktsegment", F.col("c_nationkey").cast("string").alias("n")).agg(F.count(F.lit(1)).alias("v"))
    sinks.write_matrix(long, "c_mktsegment", "n", "v", [str(i) for i in range(5)], path)
    return readers.melt_matrix(readers.read_delimited(t.spark, path), "c_mktsegment").where("value is not null")


@query("SELECT DISTINCT c_name AS sample, c_acctbal > 0 AS high, 'a.tsv' AS source_file FROM customer UNION ALL SELECT DISTINCT s_name, s_acctbal > 0, 'b.csv' FROM supplier")
def union_of_files(t: Tables) -> DataFrame:
    root = shared_path(t.spark, "files")
    high = lambda c: F.when(F.col(c) > 0, "1").otherwise("0")
    sinks.write_tsv(t.customer.select(F.col("c_name").alias("Sample ID"), high("c_acctbal").alias("HIGH")), f"{root}/a.tsv")
    t.supplier.select(F.col("s_name").alias("sample_id"), high("s_acctbal").alias("high"), F.lit(1).alias("more")).write.csv(f"{root}/b.csv", header=True)
    sinks.write_tsv(t.nation.select("n_name"), f"{root}/c.tsv")
    out, warnings = readers.union_files(t.spark, [f"{root}/a.tsv", f"{root}/b.csv", f"{root}/c.tsv"], {"sample": ["sample_id"], "high": ["high"]}, ["sample"])
    if len(warnings) != 1:
        raise ValueError(f"one file lacks its columns, not {warnings}")
    return out.withColumn("high", S.boolean(F.col("high")))


@query("SELECT * FROM (VALUES ('absent_is_empty', true), ('alias', true), ('configured_order', true), ('feature_sets', true), ('kind_by_name', true), ('repeated_id_raises', true), ('text', true)) x(name, ok)")
def source_rules(t: Tables) -> DataFrame:
    """What readers do with absent files, aliases, configured ids and names."""
    root = shared_path(t.spark, "rules")
    absent = readers.optional_source(t.spark, f"{root}/none.parquet", "a int")
    alias = readers.resolve_aliases(t.nation, {"name": ["nation", "N.Name"], "more": ["more"]}, ["name"])
    order = [r["n_name"] for r in readers.select_configured(t.nation, ["NATION_3", "NATION_1"], "n_name").collect()]
    try:
        readers.select_configured(t.nation.unionAll(t.nation), ["NATION_3"], "n_name")
        raised = False
    except ValueError:
        raised = True
    sinks.write_text(t.spark, sinks.markdown_table(t.region.orderBy("r_regionkey").select("r_name")), f"{root}.md")
    lines = [r[0] for r in t.spark.read.text(f"{root}.md").collect()]
    found = {
        "absent_is_empty": absent.isEmpty(), "alias": alias.columns == ["name", "more"] and alias.where("more is null").count() == t.nation.count(), "configured_order": order == ["NATION_3", "NATION_1"], "repeated_id_raises": raised,
        "feature_sets": readers.feature_sets({"a": ["x", "y"], "b": {"genes": ["z"]}}) == [("a", "x"), ("a", "y"), ("b", "z")], "kind_by_name": readers.classify_resource("/d/purity_table.tsv") == "purity", "text": lines[0] == "| r_name |" and len(lines) == 2 + t.region.count(),
    }
    return t.spark.createDataFrame(list(found.items()), "name string, ok boolean")


@query(f"""WITH {SAMPLES} SELECT 'unique_orders' AS rule, count(*) = count(DISTINCT o_orderkey) AS holds FROM samples UNION ALL SELECT 'orders_have_customers', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0 UNION ALL SELECT 'customers_have_orders', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0
UNION ALL SELECT 'unique_customer_of_order', (SELECT count(*) = count(DISTINCT o_custkey) FROM orders) UNION ALL SELECT 'finite_prices', true UNION ALL SELECT 'columns', true UNION ALL SELECT 'missing_column', false UNION ALL SELECT 'order_hash', true""")
def contract_checks(t: Tables) -> DataFrame:
    """Contract checks as rows: whether each holds."""

    def holds(check) -> bool:
        try:
            check()
        except (CO.ContractError, J.CardinalityError):
            return False
        return True

    by = lambda df, c: df.select(F.col(c).alias("k"))
    order = CO.order_hash(t.nation, "n_name", "n_nationkey").first()[0]
    again = CO.order_hash(t.nation.orderBy(F.desc("n_name")), "n_name", "n_nationkey").first()[0]
    checks = {
        "unique_orders": lambda: CO.clean_keys(t.orders.select(F.col("o_orderkey").cast("string").alias("k")), "k"), "orders_have_customers": lambda: CO.check_references(by(t.orders, "o_custkey"), by(t.customer, "c_custkey"), ["k"]), "customers_have_orders": lambda: CO.check_references(by(t.customer, "c_custkey"), by(t.orders, "o_custkey"), ["k"]),
        "unique_customer_of_order": lambda: J.assert_unique(t.orders, ["o_custkey"]), "finite_prices": lambda: CO.check_finite(t.orders, ["o_totalprice"]), "columns": lambda: CO.check_columns(t.orders, {"o_orderkey": "bigint", "o_totalprice": "double"}), "missing_column": lambda: CO.check_columns(t.orders, {"none": None}),
    }
    rows = [(name, holds(check)) for name, check in checks.items()] + [("order_hash", order == again)]
    return t.spark.createDataFrame(rows, "rule string, holds boolean")
