"""Queries of saved models, indexes, scans, scenarios and parts of the standardisers, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import aliases as AL
from ..operators import cluster as C
from ..operators import contract as CO
from ..operators import joins as J
from ..operators import matrix as M
from ..operators import pivots as PV
from ..operators import quantiles as QU
from ..operators import reference as RF
from ..operators import reshape as R
from ..operators import standardise as ST
from ..sources import readers
from ..sources import scans as SC
from ..sources.artefacts import Store
from ..sources.readers import shared_path
from .catalogue import _LONG, _NATIONS, MUTATIONS, VALUES, Tables, _long, _nations, query, r6

# ---- saved models and indexes


_REFERENCE = f"""{_LONG}, ref AS (SELECT * FROM lng WHERE row % 10 <> 3),
med AS (SELECT feature, median(value) AS m FROM ref GROUP BY 1 HAVING 1 - count(value) / (SELECT count(DISTINCT row) FROM ref) <= 0.3),
fil AS (SELECT r.row, med.feature, coalesce(ref.value, m) AS value, m FROM (SELECT DISTINCT row FROM ref) r CROSS JOIN med LEFT JOIN ref ON ref.row = r.row AND ref.feature = med.feature),
par AS (SELECT feature, any_value(m) AS m, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM fil GROUP BY 1),
sca AS (SELECT fil.row, fil.feature, (value - mean) / std AS x FROM fil JOIN par USING (feature))"""


def _cases(t: Tables) -> DataFrame:
    """Values of every tenth user, as text; users without any are no cases."""
    known = _long(t).where("row % 10 = 3 AND value IS NOT NULL")
    return known.select(F.col("row").alias("case_id"), F.lit("events.tsv").alias("source_file"), F.col("feature").alias("feature_name"), F.col("value").cast("string").alias("raw_value"))


@query(f"""{_REFERENCE}, cas AS (SELECT c.row, par.feature, (coalesce(lng.value, m) - mean) / std AS x FROM (SELECT DISTINCT row FROM lng WHERE row % 10 = 3 AND value IS NOT NULL) c CROSS JOIN par LEFT JOIN lng ON lng.row = c.row AND lng.feature = par.feature),
d AS (SELECT c.row AS query_id, s.row AS neighbour_id, sqrt(sum((c.x - s.x) * (c.x - s.x))) AS d FROM cas c JOIN sca s USING (feature) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), neighbour_id) AS rank, neighbour_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity, 'index' AS method FROM d QUALIFY rank <= 5""")
def case_projection(t: Tables) -> DataFrame:
    """A model of nine users in ten is fitted and saved; a fresh session loads it and projects the others."""
    long = _long(t).where("row % 10 <> 3")
    root = shared_path(t.spark, "models")
    RF.save(RF.fit(long, long.select("row").distinct(), {}, components=3, block_rows=200), Store(t.spark, root), "users")
    fresh = Tables(t.spark.newSession(), t.dir)
    values = _cases(fresh)
    done = RF.project(RF.load(Store(fresh.spark, root), "users"), values, values.select("case_id").distinct(), k=5)
    return done.neighbours.select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbour_id", r6("distance").alias("distance"), r6("similarity").alias("similarity"), F.lit(done.method).alias("method"))


@query("""WITH v AS (SELECT c_custkey AS id, [c_acctbal / 1000, c_nationkey / 5.0, n / 4.0] AS vec, c_nationkey AS grp FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
SELECT q.id AS query_id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.vec, r.vec), 9), r.id) AS rank, r.id AS neighbour_id, round(list_distance(q.vec, r.vec), 6) AS distance FROM v q JOIN v r ON q.grp <> r.grp WHERE q.id % 5 = 0 QUALIFY rank <= 10""")
def pruned_neighbours(t: Tables) -> DataFrame:
    """Ten nearest customers of other nations for every fifth customer (the stated query set), over a pivot index."""
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.customer.join(n, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / F.lit(5.0), F.col("n") / F.lit(4.0)).cast("array<double>").alias("vec"), F.col("c_nationkey").alias("grp"))
    found, _ = PV.search(PV.build(rows, group="grp", block_rows=200), rows.where("id % 5 = 0"), 10, "grp")
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "neighbour_id", r6("distance").alias("distance"))


# ---- scans


_WIDE = f"{_NATIONS}, rnk AS (SELECT feature, row_number() OVER (ORDER BY feature) AS n FROM (SELECT DISTINCT feature FROM lng))"


@query(f"""{_WIDE} SELECT 'cell' AS kind, upper(lng.feature) AS feature, row AS sample, round(value, 6) AS value FROM lng JOIN rnk USING (feature) WHERE n % 7 <> 5 AND n % 3 > 0 AND (row LIKE '%1' OR row LIKE '%2') UNION ALL SELECT 'short_row', upper(feature), '', n FROM rnk WHERE n % 7 = 5""")
def wide_matrix_scan(t: Tables) -> DataFrame:
    """Brands by nations as a wide text file in which every seventh row breaks off: two rows in three and few columns are cut out of it."""
    long, names = _nations(t), [r[0] for r in t.nation.select("n_name").orderBy("n_name").collect()]
    wide = long.groupBy("feature").pivot("row", names).agg(F.first("value"))
    n = F.row_number().over(Window.orderBy("feature"))  # the brands are a bounded dimension
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in names])
    cells = F.when(F.col("n") % 7 == 5, F.slice(cells, 1, 2)).otherwise(cells)
    body = wide.withColumn("n", n).select("n", F.concat(F.col("feature"), F.lit("|7\t"), F.concat_ws("\t", cells)).alias("value"))
    path = shared_path(t.spark, "wide")
    header = t.spark.createDataFrame([(0, "\t".join(["Gene_ID", *names]))], "n int, value string")
    header.unionByName(body).repartition(1).sortWithinPartitions("n").select("value").write.text(path)
    features = [r["feature"].upper() for r in long.select("feature").distinct().orderBy("feature").collect()]
    found = SC.scan_wide(t.spark, path, lambda c: c.endswith(("1", "2")), [f for i, f in enumerate(features, 1) if i % 3])
    out = found.cells.where("value IS NOT NULL").select(F.lit("cell").alias("kind"), "feature", F.col("column").alias("sample"), r6("value").alias("value"))
    return out.unionByName(found.short.select(F.lit("short_row").alias("kind"), "feature", F.lit("").alias("sample"), F.col("row").cast("double").alias("value")))


@query("""WITH s AS (SELECT 'S' || l_orderkey AS sample, l_suppkey::VARCHAR AS chromosome, l_partkey AS a, l_partkey + l_linenumber AS b, CASE WHEN l_tax > 0 THEN l_discount END AS m, l_orderkey % 8 AS part FROM lineitem)
SELECT part::VARCHAR AS part, sample, CASE WHEN part % 4 = 1 THEN NULL ELSE chromosome END AS chromosome, a AS start, b AS "end", m AS segment_mean, NULL AS warning FROM s WHERE part % 4 <> 3 UNION ALL SELECT part::VARCHAR, NULL, NULL, NULL, NULL, NULL, 'missing_required_columns_end' FROM s WHERE part % 4 = 3 GROUP BY part""")
def headed_files_scan(t: Tables) -> DataFrame:
    """Line items in eight parts, each a text file or more of one of four layouts, one of which lacks a required column, read by one plan."""
    k, text = F.col("l_orderkey") % 8, lambda c: F.col(c).cast("string")
    sample, mean = F.concat(F.lit("S"), text("l_orderkey")), F.when(F.col("l_tax") > 0, text("l_discount")).otherwise("NA")
    start, end = text("l_partkey"), (F.col("l_partkey") + F.col("l_linenumber")).cast("string")
    layouts = [
        ("Sample\tChromosome\tStart\tEnd\tSegment_Mean", F.concat_ws("\t", sample, text("l_suppkey"), start, end, mean)),
        ("loc.end,loc.start,\"ID\",extra,seg.mean", F.concat_ws(",", end, start, F.concat(F.lit('"'), sample, F.lit('"')), F.lit("x"), mean)),
        ("# made by hand\nsegment mean;sample;end;chr;start", F.concat_ws(";", mean, sample, end, text("l_suppkey"), start)),
        ("sample\tstart\tsegment_mean", F.concat_ws("\t", sample, start, mean)),
    ]
    body = F.lit(None)
    for i, (_, line) in enumerate(layouts):
        body = F.when(k % 4 == i, line).otherwise(body)
    heads = t.spark.createDataFrame([(p, n, line) for p in range(8) for n, line in enumerate(layouts[p % 4][0].split("\n"), -5)], "part long, n int, value string")
    path = shared_path(t.spark, "headed")
    pieces = max(1, -(-t.lineitem.count() // (8 * J.TASK_ROWS)))  # files of a part, so that no task orders more
    piece = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(pieces)).alias("piece")
    heads = heads.join(t.spark.range(pieces).select(F.col("id").alias("piece")), how="cross").select("part", "piece", "n", "value")
    lines = heads.unionByName(t.lineitem.select(k.alias("part"), piece, F.lit(0).alias("n"), body.alias("value")))
    dealt = lines.repartition(8 * pieces, "part", "piece") if pieces > 1 else lines.repartition("part")
    dealt.sortWithinPartitions("part", "piece", "n").select("part", "piece", "value").write.partitionBy("part", "piece").text(path)
    aliases = {"sample": ["sample", "id", "sample_id"], "chromosome": ["chromosome", "chr"], "start": ["start", "locstart"], "end": ["end", "locend"], "segment_mean": ["segmentmean", "segmean"]}
    rows, warnings = SC.scan_headed(t.spark, f"{path}/part=*/piece=*", aliases, ["sample", "start", "end", "segment_mean"])
    part = F.regexp_extract("file", "part=([0-9]+)", 1).alias("part")
    out = rows.select(part, "sample", "chromosome", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("segment_mean").cast("double").alias("segment_mean"), F.lit(None).cast("string").alias("warning"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return out.unionByName(warnings.select(part, none("sample", "string"), none("chromosome", "string"), none("start", "long"), none("end", "long"), none("segment_mean", "double"), "warning").distinct())


@query(f"""WITH {VALUES} SELECT event_type, count(value) AS n, [round(x, 6) FOR x IN quantile_cont(value, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])] AS quantiles FROM vals GROUP BY 1""")
def exact_quantiles_by_group(t: Tables) -> DataFrame:
    """Quantiles of few large groups, narrowed down until 200 rows of each are left."""
    out = QU.exact_quantiles(t.values, ["event_type"], "value", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0], few=200)
    return out.withColumn("quantiles", F.transform("quantiles", lambda x: F.round(x, 6)))


# ---- scenarios, quality rows, aliases


_SCENARIOS = [("unweighted", 1.0, 1.0, 1.0), ("low_down", 0.5, 1.0, 1.0), ("middle_only", 0.0, 1.0, 0.0)]


@query(f"""{_NATIONS}, cls AS (SELECT feature, CASE substr(feature, 7)::INT % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'high' END AS class FROM (SELECT DISTINCT feature FROM lng)), wts AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{c}', {w})" for n, *ws in _SCENARIOS for c, w in zip(("low", "middle", "high"), ws))}) x(scenario, class, weight)),
u AS (SELECT row, feature, class, value / nullif(max(value) OVER w - min(value) OVER w, 0) AS u FROM lng JOIN cls USING (feature) WINDOW w AS (PARTITION BY feature))
SELECT scenario, a.row AS a, b.row AS b, round(sum(weight * abs(a.u - b.u)) / sum(weight), 6) AS distance FROM u a JOIN u b USING (feature) JOIN wts ON wts.class = a.class WHERE a.row < b.row GROUP BY 1, 2, 3 HAVING sum(weight) > 0""")
def weighted_scenarios(t: Tables) -> DataFrame:
    long = _nations(t)
    kind = F.substring("feature", 7, 9).cast("int") % 3
    classes = long.select("feature").distinct().withColumn("class", F.when(kind == 0, "low").when(kind == 1, "middle").otherwise("high"))
    weights = t.spark.createDataFrame([(n, c, w) for n, *ws in _SCENARIOS for c, w in zip(("low", "middle", "high"), ws)], "scenario string, class string, weight double")
    return M.gower_scenarios(long, classes, weights).withColumn("distance", r6("distance"))


@query(f"""WITH {MUTATIONS}, g AS (SELECT project, grouping(project) AS whole, count(*) AS records, count(DISTINCT o_orderkey) AS samples, count(DISTINCT gene) AS genes, sum((flag = 'R')::INT) AS nonsynonymous, max(l_linenumber) AS most FROM mutations GROUP BY GROUPING SETS ((project), ())),
r AS (SELECT CASE WHEN whole = 1 THEN 'global' ELSE 'per_project' END AS qc_section, CASE WHEN whole = 1 THEN 'ALL' ELSE project END AS project, unnest(['records', 'samples', 'genes', 'nonsynonymous', 'most']) AS metric, unnest([records::VARCHAR, samples::VARCHAR, genes::VARCHAR, nonsynonymous::VARCHAR, most::VARCHAR]) AS value FROM g) SELECT * FROM r""")
def quality_rows(t: Tables) -> DataFrame:
    """Whole-table and per-project rows from one pass."""
    measures = {"records": F.count(F.lit(1)), "samples": F.count_distinct("o_orderkey"), "genes": F.count_distinct("gene"), "nonsynonymous": A.count_if(F.col("flag") == "R"), "most": F.max("l_linenumber")}
    return A.quality_rows(t.mutations, "project", measures)


_GROUPS = [("small things", ["SMALL", "small ring"]), ("rings", ["ring", "Ring, economy"]), ("bolts", ["blue bolt", "bolt promo"]), ("colours", ["red", "blue", "green"]), ("economy", ["économy", "eco-nomy"]), ("none", ["rin", "economy small", ""])]


@query(r"""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(x, '\b(small|small ring)\b') THEN 'small things' END, CASE WHEN regexp_matches(x, '\bring\b') THEN 'rings' END, CASE WHEN regexp_matches(x, '\b(blue bolt|bolt promo)\b') THEN 'bolts' END, CASE WHEN regexp_matches(x, '\b(red|blue|green)\b') THEN 'colours' END, CASE WHEN regexp_matches(x, '\b(economy|eco nomy)\b') THEN 'economy' END, CASE WHEN regexp_matches(x, '\b(rin|economy small)\b') THEN 'none' END], lambda m: m IS NOT NULL), ';') AS matches FROM p""")
def alias_matches(t: Tables) -> DataFrame:
    """Overlapping aliases of several groups, in the groups' order."""
    texts = t.part.select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("text"))
    return AL.match_aliases(texts, "text", _GROUPS).select("p_partkey", F.array_join("matches", ";").alias("matches"))


# ---- parts of standardisers, keys and classes


@query("""WITH m AS (SELECT 'AA-00-' || lpad(c_custkey::VARCHAR, 5, '0') || '-01A' AS s, 'AA-00-' || lpad((CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END)::VARCHAR, 5, '0') AS p FROM customer WHERE c_custkey % 4 > 0),
one AS (SELECT p, max(s) AS only FROM m GROUP BY p HAVING count(DISTINCT s) = 1),
r AS (SELECT l_orderkey, l_linenumber, 'AA-00-' || lpad((l_partkey % 700)::VARCHAR, 5, '0') || CASE WHEN l_linenumber % 2 = 0 THEN '-01A-xy' ELSE '-09B' END AS named, CASE l_suppkey % 9 WHEN 0 THEN 'NA' WHEN 1 THEN 'MT' ELSE (l_suppkey % 9)::VARCHAR END AS chromosome, l_partkey AS start, l_partkey + l_linenumber - 2 AS "end", CASE WHEN l_linenumber < 4 THEN l_quantity::DOUBLE END AS total_cn, CASE WHEN l_linenumber = 5 THEN 1.0::DOUBLE END AS minor_cn FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(m.s, one.only) AS sample_barcode, chromosome, total_cn, minor_cn FROM r LEFT JOIN (SELECT DISTINCT s FROM m) m ON m.s = substr(array_to_string(string_split(named, '-')[1:4], '-'), 1, 16) LEFT JOIN one ON one.p = array_to_string(string_split(named, '-')[1:3], '-') WHERE coalesce(m.s, one.only) IS NOT NULL AND chromosome NOT IN ('NA', 'MT') AND "end" >= start AND coalesce(total_cn, minor_cn) IS NOT NULL""")
def allele_segments(t: Tables) -> DataFrame:
    """Segments matched to samples, directly or by their patient, of which the usable ones stay."""
    pad = lambda c: F.concat(F.lit("AA-00-"), F.lpad(c.cast("string"), 5, "0"))
    k, n = F.col("c_custkey"), F.col("l_linenumber")
    members = t.customer.where("c_custkey % 4 > 0").select(F.concat(pad(k), F.lit("-01a")).alias("sample_barcode"), pad(F.when(k % 10 == 1, k - 1).otherwise(k)).alias("patient_barcode"))
    place = F.col("l_suppkey") % 9
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat(pad(F.col("l_partkey") % 700), F.when(n % 2 == 0, "-01A-xy").otherwise("-09B")).alias("named"), F.when(place == 0, "NA").when(place == 1, "MT").otherwise(place.cast("string")).alias("chromosome"),
        F.col("l_partkey").alias("start"), (F.col("l_partkey") + n - 2).alias("end"), F.when(n < 4, F.col("l_quantity").cast("double")).alias("total_cn"), F.lit(None).cast("double").alias("major_cn"), F.when(n == 5, 1.0).alias("minor_cn"),
    )
    return ST.usable_copies(ST.resolved_samples(raw, "named", members)).select("l_orderkey", "l_linenumber", "sample_barcode", "chromosome", "total_cn", "minor_cn")


@query("""WITH e AS (SELECT DISTINCT c_mktsegment AS code FROM customer WHERE c_mktsegment < 'F'), x AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS code FROM customer)
SELECT c_custkey, 'TCGA-' || e.code AS project_id, e.code AS project_code FROM x LEFT JOIN e USING (code)""")
def project_annotations(t: Tables) -> DataFrame:
    """Projects by code, as the column of ids holds other texts; unexpected ones are null."""
    expected = t.customer.where("c_mktsegment < 'F'").select(F.concat(F.lit("TCGA-"), F.col("c_mktsegment")).alias("project_id"), F.col("c_mktsegment").alias("project_code"))
    code = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.when(F.col("c_custkey") % 2 == 0, "TCGA-").otherwise(""), F.lower("c_mktsegment")))
    raw = t.customer.select("c_custkey", F.col("c_name").alias("project"), F.regexp_replace(code, "^tcga", "TCGA").alias("cohort"))
    return ST.project_annotations(raw, expected).select("c_custkey", "project_id", "project_code")


@query(r"""SELECT c_custkey, trim(regexp_replace(lower(c_name || ' (' || c_mktsegment || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(c_name || ' (' || c_mktsegment || ')', '[^A-Za-z0-9._-]+', '_', 'g') AS file_name, c_custkey || '|' || CASE WHEN c_nationkey > 4 THEN c_nationkey::VARCHAR ELSE '<NA>' END || '|' || c_mktsegment AS id FROM customer""")
def text_keys(t: Tables) -> DataFrame:
    name = F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))
    return t.customer.select("c_custkey", S.slug(name).alias("slug"), S.safe_file_name(name).alias("file_name"), S.stable_id(F.col("c_custkey"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")), F.col("c_mktsegment")).alias("id"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS s FROM orders), f AS (SELECT o_custkey, s, min(o_orderkey) AS place FROM o WHERE s <> '' GROUP BY 1, 2) SELECT c.o_custkey, coalesce(string_agg(s, ';' ORDER BY place), '') AS statuses FROM (SELECT DISTINCT o_custkey FROM o) c LEFT JOIN f USING (o_custkey) GROUP BY 1""")
def flattened_hits(t: Tables) -> DataFrame:
    """A customer's orders as a nested hit, its statuses distinct in order."""
    hit = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"))
    nested = t.orders.groupBy("o_custkey").agg(F.struct(F.array_sort(F.collect_list(hit)).alias("orders")).alias("case"))
    return readers.flatten_hits(nested, "o_custkey", {"statuses": "case.orders.status"})


@query("""SELECT l_linestatus, """ + ", ".join(f"round(greatest(-1.0, least(1.0, coalesce(sum(CASE WHEN l_returnflag = '{c}' OR l_linenumber % 2 = 0 AND l_shipmode_like = '{c}' THEN w END), 0))), 6) AS \"{c}\"" for c in "ANR") + """ FROM (SELECT l_linestatus, l_returnflag, l_linenumber, 'A' AS l_shipmode_like, round((l_orderkey % 3 - 1)::DOUBLE / 100000.0, 9) AS w FROM lineitem) WHERE NOT (l_returnflag = 'A' AND l_linenumber % 2 = 0) GROUP BY 1""")
def signed_matrix(t: Tables) -> DataFrame:
    """Findings for and against by target: summed weights, clipped, one column a target."""
    some = t.lineitem.where("NOT (l_returnflag = 'A' AND l_linenumber % 2 = 0)")
    targets = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_returnflag", F.lit("A"))).otherwise(F.array("l_returnflag"))
    out = R.signed_matrix(some.withColumn("targets", targets), "l_linestatus", "targets", F.round((F.col("l_orderkey") % 3 - 1) / 100000.0, 9), ["A", "N", "R"], -1.0, 1.0)
    return out.select("l_linestatus", *[F.round(c, 6).alias(c) for c in "ANR"])


@query("""WITH n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT r_regionkey, n AS members FROM region JOIN n ON n_regionkey = r_regionkey""")
def partition_check(t: Tables) -> DataFrame:
    """Every nation is mapped to one region and no other key is."""
    CO.check_partition(t.nation.select("n_nationkey", "n_regionkey"), t.customer.select(F.col("c_nationkey").alias("n_nationkey")).unionAll(t.nation.select("n_nationkey")), "n_nationkey")
    return t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("members"))


@query("""WITH v AS (SELECT user_id, event_type, avg(value) / 100 AS m, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, CASE WHEN user_id % 5 > 0 THEN (user_id % 5) / 5.0 END AS purity FROM v), c AS (SELECT *, CASE WHEN purity IS NULL THEN 'uncertain' WHEN abs(m - purity / 2) <= 0.08 THEN 'clonal_like' WHEN m < purity / 2 - 0.08 THEN 'subclonal_like' ELSE 'uncertain' END AS meaning FROM p),
s AS (SELECT user_id, sum(n) AS n, count(*) AS k, max(n) / sum(n) AS dominant, count(*) FILTER (meaning = 'subclonal_like') AS sub FROM c GROUP BY 1)
SELECT user_id, n::BIGINT AS n, k, sub AS subclonal, CASE WHEN n < 60 THEN 'low_confidence' WHEN dominant >= 0.75 AND sub <= 1 AND k <= 2 THEN 'predominantly_clonal_like' WHEN k <= 3 AND dominant < 0.75 THEN 'oligoclonal_like' ELSE 'multicluster_subclonal_like' END AS class, k = 1 AS is_singleton FROM s""")
def cluster_classes(t: Tables) -> DataFrame:
    """Classes of clusters by mean and purity, and of samples by their clusters (a user's event types stand for clusters)."""
    v = t.events.groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("m"), F.count(F.lit(1)).alias("n"))
    purity = F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5 / 5.0)
    c = v.withColumn("meaning", C.cluster_meaning(F.col("m"), purity))
    s = c.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.max("n") / F.sum("n")).alias("dominant"), A.count_if(F.col("meaning") == "subclonal_like").alias("subclonal"))
    return s.select("user_id", "n", "k", "subclonal", C.sample_meaning(F.col("n"), F.col("k"), F.col("dominant"), F.col("subclonal"), F.col("dominant"), 60).alias("class"), (F.col("k") == 1).alias("is_singleton"))


@query("""WITH o AS (SELECT p_partkey AS ordinal, (p_partkey * 7) % 60 AS k FROM part), s AS (SELECT s_suppkey AS k, s_acctbal FROM supplier WHERE s_suppkey % 5 > 0) SELECT ordinal, s.k, s_acctbal FROM o LEFT JOIN s USING (k)""")
def aligned_rows(t: Tables) -> DataFrame:
    """Suppliers in the places that parts give them; places of unknown ones are null."""
    order = t.part.select(F.col("p_partkey").alias("ordinal"), (F.col("p_partkey") * 7 % 60).alias("k"))
    found = J.aligned(t.supplier.where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("k"), "s_acctbal"), "k", order)
    return found.select("ordinal", F.when(F.col("s_acctbal").isNotNull(), F.col("k")).alias("k"), "s_acctbal")
