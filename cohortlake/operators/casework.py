"""Cases against a locked reference: harmonised values with an audit, coverage,
recomputed summaries and consistency faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .contract import ContractError


def _raise_any(df: DataFrame, what: str) -> None:
    bad = df.limit(5).collect()
    if bad:
        raise ContractError(f"{what}: {[tuple(r) for r in bad]}")


def harmonise_cases(values: DataFrame, cases: DataFrame, reference: DataFrame, source: str = "none") -> DataFrame:
    """Every reference feature of every case, supplied or imputed, and the extras.

    values: (case_id, source_file, feature_name, raw_value text), missing ones
    null; cases: case_id; reference: (feature_name, feature_type, median, mean,
    std), a bounded contract. Returns an audit row per case and feature with
    value_used and scaled_value; values that the reference doesn't know are kept
    as extras, not scaled. Text that is no number, values of several sources that
    differ, binary features other than 0 and 1, counts that are negative or
    broken, and reference deviations that aren't positive raise.
    """
    spread = F.col("std")
    _raise_any(reference.where(~S.finite(spread) | (spread <= 0)).select("feature_name", "std"), "deviation is not positive")
    given = values.where("raw_value is not null").join(reference.select("feature_name", "feature_type", F.lit(True).alias("_known")), "feature_name", "left").withColumn("_x", S.number(F.col("raw_value")))
    mine = given.where("_known")
    _raise_any(mine.where("_x is null").select("case_id", "feature_name", "raw_value"), "no number")
    x = F.col("_x")
    whole = S.close(x, F.rint(x))
    broken = F.when(F.col("feature_type") == "binary", ~(S.close(x, F.lit(0.0)) | S.close(x, F.lit(1.0)))).when(F.col("feature_type") == "count", (x < 0) | ~whole).otherwise(False)
    _raise_any(mine.where(broken).select("case_id", "feature_name", "raw_value"), "value that its type does not allow")
    one = mine.groupBy("case_id", "feature_name").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.min_by(F.struct("raw_value", "_x"), "source_file").alias("_first"), F.array_join(F.array_sort(F.collect_set("source_file")), ";").alias("source_file"))
    _raise_any(one.where(~S.close(F.col("_low"), F.col("_high"))).select("case_id", "feature_name", "_low", "_high"), "sources differ")
    grid = cases.select("case_id").join(reference, how="cross")  # the contract is a bounded dimension
    known = grid.join(one, ["case_id", "feature_name"], "left")
    supplied = F.col("_first").isNotNull()
    used = F.coalesce(F.col("_first._x"), F.col("median"))
    audit = known.select(
        "case_id", "feature_name", F.lit(True).alias("expected_in_reference"), "feature_type", F.coalesce("source_file", F.lit(source)).alias("source_file"), supplied.alias("supplied"), F.col("_first.raw_value").alias("raw_value"),
        (~supplied).alias("imputed"), used.alias("value_used"), ((used - F.col("mean")) / spread).alias("scaled_value"), F.when(supplied, "supplied").otherwise("imputed_missing_feature").alias("status"),
    )
    none = F.lit(None).cast("double")
    extra = given.where("_known is null").select("case_id", "feature_name", F.lit(False), F.lit("not_evaluated"), "source_file", F.lit(True), "raw_value", F.lit(False), none, none, F.lit("extra_not_in_reference_ignored"))
    return audit.unionAll(extra)


def case_summary(audit: DataFrame, most_scaled: float = 8.0, least_coverage: float = 50.0) -> DataFrame:
    """Per case: supplied, missing and extra features, coverage in percent, and warnings."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    expected = F.col("expected_in_reference")
    out = audit.groupBy("case_id").agg(n(expected).alias("expected"), n(expected & F.col("supplied")).alias("supplied"), n(expected & F.col("imputed")).alias("missing"), n(~expected).alias("extra"), n(F.abs("scaled_value") > most_scaled).alias("extreme"))
    out = out.withColumn("coverage_percent", 100.0 * F.col("supplied") / F.when(F.col("expected") > 0, F.col("expected")))
    return out.withColumn("warnings", S.reasons([("imputed_features", F.col("missing") > 0), ("extra_features", F.col("extra") > 0), ("extreme_values", F.col("extreme") > 0), ("low_coverage", F.col("coverage_percent") < least_coverage)]))


def coverage_by(audit: DataFrame, features: DataFrame, group: str, both: str = "both") -> DataFrame:
    """Share of the supplied features by case and group (modality); features of ``both``
    count in every group. features: (feature_name, group), a bounded contract."""
    groups = features.where(F.col(group) != both).select(group).distinct()
    member = features.where(F.col(group) != both).unionAll(features.where(F.col(group) == both).select("feature_name").join(groups, how="cross").select(*features.columns))
    rows = audit.where("expected_in_reference").join(member, "feature_name")
    return rows.groupBy("case_id", group).agg(F.avg(F.col("supplied").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_features"))


def summary_differences(calculated: DataFrame, provided: DataFrame, key: str, exact: Sequence[str], near: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Keys on which two summaries differ, and how: only one has it, or columns differ
    (``near`` ones by more than the tolerance, absolute and relative)."""
    names = [*exact, *near]
    a = calculated.select(key, *[F.col(c).alias(f"{c}_calculated") for c in names], F.lit(True).alias("_a"))
    b = provided.select(key, *[F.col(c).alias(f"{c}_provided") for c in names], F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    pair = lambda c: (F.col(f"{c}_calculated"), F.col(f"{c}_provided"))
    found = [("only_calculated", F.col("_b").isNull()), ("only_provided", F.col("_a").isNull())]
    found += [(c, both & ~pair(c)[0].eqNullSafe(pair(c)[1])) for c in exact]
    found += [(c, both & ~F.coalesce(S.close(*pair(c), tolerance, tolerance), pair(c)[0].isNull() & pair(c)[1].isNull())) for c in near]
    return a.join(b, key, "full_outer").withColumn("differs_in", S.reasons(found)).where("differs_in <> 'none'").select(key, "differs_in")


def neighbour_faults(neighbours: DataFrame, reference: DataFrame, query: str = "query_id", other: str = "neighbour_id") -> DataFrame:
    """(fault, n): repeated ranks or neighbours of a query, queries with several
    metrics, similarities other than 1 / (1 + distance), and unknown neighbours.

    neighbours: (query, rank, neighbour, distance, similarity, metric).
    """
    one = neighbours.agg(F.count(F.when(~F.coalesce(S.close(F.col("similarity"), 1 / (1 + F.col("distance")), 1e-10, 1e-8), F.lit(False)), 1)).alias("n")).select(F.lit("similarity").alias("fault"), "n")
    again = lambda name, *keys: neighbours.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.count(F.when(F.col("m") > 1, 1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    metric = neighbours.groupBy(query).agg(F.count_distinct("metric").alias("m")).agg(F.count(F.when(F.col("m") != 1, 1)).alias("n")).select(F.lit("metric").alias("fault"), "n")
    lost = neighbours.join(reference.select(F.col(reference.columns[0]).alias(other)).distinct(), other, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_neighbour").alias("fault"), "n")
    return one.unionAll(again("repeated_rank", query, "rank")).unionAll(again("repeated_neighbour", query, other)).unionAll(metric).unionAll(lost)


def matrix_faults(matrix: DataFrame, expected: DataFrame, key: str, annotations: Sequence[str]) -> DataFrame:
    """(fault, n) of a feature matrix: no rows, repeated keys, expected keys that it lacks, no feature columns."""
    features = [c for c in matrix.columns if c != key and c not in annotations]
    rows = matrix.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("n")).select(F.lit("no_rows").alias("fault"), "n")
    twice = matrix.groupBy(key).agg(F.count(F.lit(1)).alias("m")).agg(F.count(F.when(F.col("m") > 1, 1)).alias("n")).select(F.lit("repeated_key").alias("fault"), "n")
    lost = expected.select(key).distinct().join(matrix.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_key").alias("fault"), "n")
    bare = rows.select(F.lit("no_features").alias("fault"), F.lit(0 if features else 1).cast("bigint").alias("n"))
    return rows.unionAll(twice).unionAll(lost).unionAll(bare)


def key_value(table: DataFrame, wanted: Sequence[tuple[str, str]], default: str = "NA", section: str = "qc_section", metric: str = "metric", value: str = "value") -> DataFrame:
    """The values of the wanted (section, metric) pairs of a key/value table, the
    default where it has none; of repeated ones the largest text."""
    asked = table.sparkSession.createDataFrame(list(wanted), f"{section} string, {metric} string")
    one = table.groupBy(section, metric).agg(F.max(value).alias(value))
    return asked.join(one, [section, metric], "left").fillna(default, [value])


def minimum_met(flags: Sequence[str], reason: str = "exclusion_reason") -> Column:
    """All flags hold (null doesn't) and there is no reason against the row."""
    out = F.coalesce(F.col(reason), F.lit("none")) == "none"
    for f in flags:
        out = out & F.coalesce(F.col(f), F.lit(False))
    return out


#: Candidate classes with and without usable segments.
AWARE, LIMITED = "copy_number_aware_clonal_phylogeny_candidate", "clonal_clustering_candidate_limited_cn"


def upgraded(candidates: DataFrame, segments: DataFrame, key: str, flags: Sequence[str], patient_level: bool = False) -> DataFrame:
    """Candidates with their segments' columns in place of older ones, and the class
    that follows: upgraded with usable segments of their sample (or patient, if
    allowed) and the minimum met; limited where a candidate has none.

    segments: (key, has_segment_level_cn, segment_cn_match_level, ...).
    """
    new = [c for c in segments.columns if c != key]
    out = candidates.drop(*new).join(segments, key, "left").fillna(False, ["has_segment_level_cn"]).fillna("NA", ["segment_cn_match_level"])
    level = F.col("segment_cn_match_level").isin(["sample", "patient"] if patient_level else ["sample"])
    has = F.col("has_segment_level_cn")
    chosen = S.first_match([(has & level & minimum_met(flags), AWARE), (~has & F.col("candidate_class").isin(AWARE, LIMITED), LIMITED)], None)
    return out.withColumn("candidate_class", F.coalesce(chosen, "candidate_class"))
