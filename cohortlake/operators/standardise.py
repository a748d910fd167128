"""Raw tables of many layouts as the library's relations: mutations, segments,
integer alleles, purity, copy-number metrics and arm calls."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.readers import first_present, normalise_name
from .contract import ContractError
from .joins import coalesce_merge

#: Mutation classes that change the protein.
NONSYNONYMOUS = ["Missense_Mutation", "Nonsense_Mutation", "Nonstop_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "In_Frame_Del", "In_Frame_Ins", "Splice_Site", "Translation_Start_Site"]
#: Whole words (wide tables) and patterns (long tables) of arm calls.
GAIN_WORDS, LOSS_WORDS = ["1", "+1", "gain", "amp", "amplification"], ["-1", "loss", "del", "deletion"]
GAIN_PATTERN, LOSS_PATTERN = r"gain|amp|\+|^1$", r"loss|del|-|^-1$"
#: Columns of wide arm tables that are no arms, and the names of arms.
NO_ARM = ["sample", "type", "aneuploidy score", "fraction genome altered", "fga", "sample_barcode", "project_code", "project_id"]
ARM_PATTERN = r"(^[0-9XY]+[pq]$)|(^[0-9]+ \([0-9]+[pq]\)$)"
#: Reported loss of heterozygosity.
LOH_WORDS, NO_LOH_WORDS = ["1", "true", "yes", "y", "loh", "loss", "loss_of_heterozygosity"], ["0", "false", "no", "n", "retained", "heterozygous", "no_loh"]
#: Metrics of copy-number tables and the column names they go by.
CN_METRICS = {
    "aneuploidy_score": ["aneuploidy_score", "aneuploidy", "aneuploidy_scores", "number_of_aneuploid_events"],
    "fraction_genome_altered": ["fraction_genome_altered", "fga", "genome_instability", "fraction_altered"],
    "arm_gain_count": ["arm_gain_count", "aneuploidy_gain", "gain_count"],
    "arm_loss_count": ["arm_loss_count", "aneuploidy_loss", "loss_count"],
    "total_arm_alteration_count": ["total_arm_alteration_count", "arm_alteration_count", "aneuploidy_count"],
    "copy_number_complexity_score": ["copy_number_complexity_score", "cn_complexity", "number_of_segments", "segment_count"],
}
#: Names of purity and ploidy columns.
PURITY = {
    "purity": ["purity", "tumor_purity", "absolute_purity", "purity_estimate", "cellularity"],
    "ploidy": ["ploidy", "absolute_ploidy", "tumor_ploidy", "ploidy_estimate"],
    "genome_doublings": ["Genome doublings", "genome_doublings", "whole_genome_doubling_status", "wgd"],
    "subclonal_genome_fraction": ["Subclonal genome fraction", "subclonal_genome_fraction"],
}


def picked(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the named columns that the table has, as a number; null without one."""
    found = first_present(df.columns, names)
    return S.number(F.col(f"`{found}`").cast("string")) if found else F.lit(None).cast("double")


def mutation_table(raw: DataFrame, sample: str, gene: str, effect: str, project: str, drivers: DataFrame, classes: Sequence[str] = NONSYNONYMOUS, optional: Sequence[str] = ()) -> DataFrame:
    """Mutations with sample (16 characters) and patient (12) keys and flags for
    protein change and driver genes (``drivers``: gene); rows without a project go."""
    known = drivers.select(F.col("gene").alias(gene)).distinct().withColumn("_driver", F.lit(True))
    kept = raw.where(F.col(project).isNotNull()).join(known, gene, "left")
    have = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in optional]
    return kept.select(
        sample, project, F.substring(sample, 1, 16).alias("sample_barcode"), F.substring(sample, 1, 12).alias("patient_barcode"), gene, effect, *have,
        F.coalesce(F.col(effect).isin(list(classes)), F.lit(False)).alias("is_nonsynonymous"), F.coalesce("_driver", F.lit(False)).alias("is_driver_gene"),
    )


def mutation_measures(df: DataFrame, ref: str, alt: str, start: str, end: str) -> DataFrame:
    """Counts and positions as numbers, with depth, and the variant's share where the depth is positive."""
    r, a = S.number(F.col(ref).cast("string")), S.number(F.col(alt).cast("string"))
    return df.withColumns({"ref_count": r, "alt_count": a, "depth": r + a, "vaf": S.ratio(a, r + a), "start_position": S.number(F.col(start).cast("string")).cast("bigint"), "end_position": S.number(F.col(end).cast("string")).cast("bigint")})


def usable_segments(df: DataFrame, start: str = "start", end: str = "end", value: str = "segment_mean", chromosome: str | None = None) -> DataFrame:
    """Rows with both ends in order and a value, on a named chromosome other than the mitochondrial one."""
    fine = F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(value).isNotNull() & (F.col(end) >= F.col(start))
    return df.where(fine & ~F.col(chromosome).isin("NA", "MT") if chromosome else fine)


def segment_table(raw: DataFrame, columns: dict[str, str], prefix: str, source: str) -> DataFrame:
    """Segments with normalised sample and patient keys. columns: those of the file for
    sample, chromosome, start, end, segment_mean and, if any, num_probes; samples
    that lack the prefix and segments that aren't usable go."""
    value = lambda name: S.number(F.col(columns[name]).cast("string")) if name in columns else F.lit(None).cast("double")
    sample = S.sample_key(F.col(columns["sample"]))
    out = raw.select(sample.alias("sample_barcode"), F.regexp_replace(F.col(columns["chromosome"]).cast("string"), "^chr", "").alias("chromosome"), *[value(n).alias(n) for n in ("start", "end", "num_probes", "segment_mean")], F.lit(source).alias("source_file"))
    out = out.withColumn("patient_barcode", S.group_key(F.col("sample_barcode")))
    return usable_segments(out.where(F.col("sample_barcode").startswith(prefix)))


def segment_quality(segments: DataFrame, gain: float = 0.2, loss: float = -0.2, least: int = 20) -> DataFrame:
    """One row per sample: segments in all and on autosomes, median, deviation, largest
    size, shares that look gained or lost, and whether they suffice."""
    mean, n = F.col("segment_mean"), F.count(F.lit(1))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    auto = S.is_autosome(F.regexp_replace("chromosome", "^chr", ""))
    out = segments.groupBy("sample_barcode").agg(n.alias("n_segments"), F.sum(auto.cast("int")).cast("bigint").alias("n_autosomal_segments"), F.median(mean).alias("median_segment_mean"), F.stddev_samp(mean).alias("sd_segment_mean"), F.max(F.abs(mean)).alias("max_abs_segment_mean"), share(mean >= gain).alias("fraction_gain_like"), share(mean <= loss).alias("fraction_loss_like"))
    enough = F.col("n_segments") >= least
    return out.withColumn("has_segment_level_cn", enough).withColumn("segment_cn_quality_flag", F.when(enough, "usable_segment_cn").otherwise("insufficient_segments"))


def integer_copies(c: Column, tolerance: float = 0.05) -> Column:
    """The nearest integer (half to even) of a count that isn't negative and lies within the tolerance."""
    return F.when((c >= 0) & (F.abs(c - F.rint(c)) <= tolerance), F.rint(c))


def reported_loh(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(c.isNull() | (text == ""), None).when(text.isin(LOH_WORDS), "LOH").when(text.isin(NO_LOH_WORDS), "no_LOH").otherwise(F.concat(F.lit("reported:"), F.trim(c.cast("string"))))


def allele_copies(df: DataFrame, total: str | None, major: str | None, minor: str | None, loh: str | None = None, fraction: str | None = None, tolerance: float = 0.05) -> DataFrame:
    """Adds total_cn, major_cn, minor_cn, loh_status, cellular_fraction and notes.

    In this order: counts within the tolerance of integers; alleles by size; a
    missing one of the three from the other two; alleles by size again; rows
    with negative or inconsistent alleles lose all three. Loss of
    heterozygosity is as reported, else derived; fractions over 1 are percent.
    """
    given = lambda c: integer_copies(S.number(F.col(c).cast("string")), tolerance) if c else F.lit(None).cast("double")
    stage = df.withColumns({"_t0": given(total), "_a0": given(major), "_b0": given(minor)})
    t, a, b = F.col("_t0"), F.col("_a0"), F.col("_b0")
    both = a.isNotNull() & b.isNotNull()
    stage = stage.withColumns({"_a1": F.when(both, F.greatest(a, b)).otherwise(a), "_b1": F.when(both, F.least(a, b)).otherwise(b), "_turned": both & (a < b)})
    a, b = F.col("_a1"), F.col("_b1")
    from_minor = a.isNull() & t.isNotNull() & b.isNotNull()
    stage = stage.withColumns({"_a2": F.when(from_minor, t - b).otherwise(a), "_from_minor": from_minor})
    a = F.col("_a2")
    from_major = b.isNull() & t.isNotNull() & a.isNotNull()
    stage = stage.withColumns({"_b2": F.when(from_major, t - a).otherwise(b), "_from_major": from_major})
    b = F.col("_b2")
    from_both = t.isNull() & a.isNotNull() & b.isNotNull()
    stage = stage.withColumns({"_t2": F.when(from_both, a + b).otherwise(t), "_from_both": from_both})
    t, both = F.col("_t2"), a.isNotNull() & b.isNotNull()
    stage = stage.withColumns({"_a3": F.when(both, F.greatest(a, b)).otherwise(a), "_b3": F.when(both, F.least(a, b)).otherwise(b)})
    a, b = F.col("_a3"), F.col("_b3")
    bad = F.coalesce(a < 0, F.lit(False)) | F.coalesce(b < 0, F.lit(False)) | F.coalesce(F.abs(t - a - b) > tolerance, F.lit(False))
    stage = stage.withColumn("_bad", bad).withColumns({n: F.when(~F.col("_bad"), c) for n, c in (("total_cn", t), ("major_cn", a), ("minor_cn", b))})
    told = reported_loh(F.col(loh)) if loh else F.lit(None).cast("string")
    derived = told.isNull() & F.col("major_cn").isNotNull() & F.col("minor_cn").isNotNull()
    status = F.when(told.isNotNull(), told).when(derived & (F.col("total_cn") == 0), "complete_copy_loss").when(derived & (F.col("minor_cn") == 0), "LOH").when(derived & (F.col("minor_cn") > 0), "no_LOH")
    share = S.number(F.col(fraction).cast("string")) if fraction else F.lit(None).cast("double")
    percent = (share > 1) & (share <= 100)
    share = F.when(percent, share / 100).otherwise(share)
    noted = [("alleles_ordered", F.col("_turned")), ("major_from_total", F.col("_from_minor")), ("minor_from_total", F.col("_from_major")), ("total_from_alleles", F.col("_from_both")), ("inconsistent_copies", F.col("_bad")), ("loh_from_minor", derived), ("fraction_from_percent", percent)]
    out = stage.withColumns({"loh_status": status, "cellular_fraction": F.when(share.between(0, 1), share), "notes": S.reasons(noted)})
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])


def resolved_samples(df: DataFrame, column: str, members: DataFrame, out: str = "sample_barcode") -> DataFrame:
    """``df`` with the member's sample that each value of ``column`` names: the sample
    itself, else the only sample of its patient; null where neither is known or the
    patient has several. members: (sample_barcode, patient_barcode), in any case and
    longer than the keys need be."""
    sample, patient = S.sample_key(F.col(column), length=16), S.group_key(F.col(column))
    known = members.select(S.sample_key(F.col("sample_barcode"), length=16).alias("_s"), S.group_key(F.col("patient_barcode")).alias("_p")).distinct()
    one = known.groupBy("_p").agg(F.max("_s").alias("_only"), F.count_distinct("_s").alias("_n")).where("_n = 1").select("_p", "_only")
    named = df.withColumns({"_sample": sample, "_patient": patient})
    found = named.join(known.select("_s").distinct(), F.col("_sample") == F.col("_s"), "left").join(one, F.col("_patient") == F.col("_p"), "left")
    return found.withColumn(out, F.coalesce("_s", "_only")).drop("_s", "_p", "_only", "_sample", "_patient")


def usable_copies(df: DataFrame, sample: str = "sample_barcode", chromosome: str = "chromosome", start: str = "start", end: str = "end") -> DataFrame:
    """Rows of known samples with a nuclear chromosome, bounds in order, and at least one
    of the three integer counts."""
    placed = F.col(sample).isNotNull() & ~F.coalesce(F.col(chromosome), F.lit("NA")).isin("NA", "MT") & (F.col(end) >= F.col(start))
    return df.where(placed & F.coalesce("total_cn", "major_cn", "minor_cn").isNotNull())


#: Columns that name a record's project, by id and by code, first match first.
PROJECT_IDS = ["project_id", "Project_ID", "GDC_Project", "gdc_project", "project"]
PROJECT_CODES = ["project_code", "Project_Code", "cancer", "Cancer_Type", "cancer_type", "Tumor_Type", "tumor_type", "cohort", "COHORT", "Study", "study"]


def project_annotations(df: DataFrame, expected: DataFrame, prefix: str = "TCGA-", ids: Sequence[str] = PROJECT_IDS, codes: Sequence[str] = PROJECT_CODES) -> DataFrame:
    """``df`` with project_id and project_code, null where they are not among ``expected``
    (project_id, project_code; a bounded dimension).

    A column of ids is taken if all of its values are ids, else a column of codes;
    a table that names no expected project raises.
    """
    by_id, by_code = (next((c for c in names if c in df.columns), None) for names in (ids, codes))
    whole = F.col(by_id).isNull() | (F.col(by_id) == "") | F.col(by_id).rlike(f"^{prefix}[A-Z0-9]+$") if by_id else None
    if by_id and df.where(~whole).isEmpty():
        named = df.withColumn("_id", F.col(by_id)).withColumn("_code", F.regexp_replace("_id", f"^{prefix}", ""))
    elif by_code:
        code = F.upper(F.regexp_replace(F.col(by_code), f"^{prefix}", ""))
        named = df.withColumn("_code", code).withColumn("_id", F.concat(F.lit(prefix), F.col("_code")))
    else:
        raise ContractError("no column names the projects")
    known = expected.select(F.col("project_id").alias("_known_id"), F.col("project_code").alias("_known_code")).distinct()
    out = named.join(known.select("_known_id").distinct(), F.col("_id") == F.col("_known_id"), "left").join(known.select("_known_code").distinct(), F.col("_code") == F.col("_known_code"), "left")
    if out.where("_known_code IS NOT NULL").isEmpty():
        raise ContractError("no expected project is named")
    kept = [c for c in df.columns if c not in ("project_id", "project_code")]
    return out.select(*kept, F.col("_known_id").alias("project_id"), F.col("_known_code").alias("project_code"))


def doubling_status(c: Column) -> Column:
    return F.when(c.isNotNull(), F.when(c >= 1, "WGD").otherwise("no_WGD"))


def purity_ploidy(table: DataFrame, key: str, source: str) -> DataFrame:
    """Purity, ploidy, genome doublings with their status, and the subclonal share, by whatever names the table has them."""
    out = table.select(key, *[picked(table, names).alias(n) for n, names in PURITY.items()], F.lit(source).alias("source"))
    missing = F.col("purity").isNull() & F.col("ploidy").isNull()
    return out.withColumns({"whole_genome_doubling_status": doubling_status(F.col("genome_doublings")), "notes": F.when(missing, "purity_ploidy_missing").otherwise("direct_or_local_source")})


def copy_metrics(table: DataFrame, key: str, source: str) -> DataFrame:
    """The copy-number metrics of a table; arm totals as gains plus losses (a missing one counts nothing) where only these are given."""
    out = table.select(key, *[picked(table, names).alias(n) for n, names in CN_METRICS.items()], F.lit(source).alias("source"))
    gain, loss = F.col("arm_gain_count"), F.col("arm_loss_count")
    either = F.when(gain.isNotNull() | loss.isNotNull(), F.coalesce(gain, F.lit(0.0)) + F.coalesce(loss, F.lit(0.0)))
    return out.withColumn("total_arm_alteration_count", F.coalesce("total_arm_alteration_count", either))


def arm_columns(columns: Sequence[str]) -> list[str]:
    """Columns of a wide table that stand for chromosome arms."""
    other = {normalise_name(c) for c in NO_ARM}
    return [c for c in columns if normalise_name(c) not in other and re.search(ARM_PATTERN, c)]


def arm_name(c: Column) -> Column:
    """'13 (13q)' as '13q'."""
    return F.when(c.contains("("), F.regexp_extract(c, r"\(([0-9XY]+[pq])\)", 1)).otherwise(c)


def wide_arm_calls(table: DataFrame, key: str) -> DataFrame:
    """(key, chromosome_arm, arm_call, is_gain, is_loss) of a table with a column per arm; blank calls go."""
    arms = arm_columns(table.columns)
    long = table.select(key, *[F.col(f"`{c}`").cast("string").alias(c) for c in arms]).unpivot([key], arms, "_arm", "arm_call")
    call = F.trim(F.lower("arm_call"))
    return long.where("arm_call <> ''").select(key, arm_name(F.col("_arm")).alias("chromosome_arm"), "arm_call", call.isin(GAIN_WORDS).alias("is_gain"), call.isin(LOSS_WORDS).alias("is_loss"))


def long_arm_calls(table: DataFrame, key: str, arm: str, call: str) -> DataFrame:
    """The same of a table with a row per arm. Any hyphen reads as a loss."""
    text = F.lower(F.trim(call))
    return table.where(F.col(key).isNotNull()).select(key, F.col(arm).cast("string").alias("chromosome_arm"), F.col(call).cast("string").alias("arm_call"), F.coalesce(text.rlike(GAIN_PATTERN), F.lit(False)).alias("is_gain"), F.coalesce(text.rlike(LOSS_PATTERN), F.lit(False)).alias("is_loss"))


def arm_summary(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gains, losses, and arms that have either."""
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    return calls.groupBy(*keys).agg(n(F.col("is_gain")).alias("arm_gain_count"), n(F.col("is_loss")).alias("arm_loss_count"), n(F.col("is_gain") | F.col("is_loss")).alias("total_arm_alteration_count"))


def assembled(base: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, values: Sequence[str], order: str | None = None) -> tuple[DataFrame, list[str]]:
    """The base's missing cells from the sources in their order, and a warning for each
    source that has none of the values. Of repeated keys of a source each value is the
    first one that isn't missing, by the source's column ``order`` or as its rows are read."""
    known, warnings = [], []
    for name, table in sources:
        if any(v in table.columns for v in values):
            at = F.col(order) if order in table.columns else F.monotonically_increasing_id()
            one = table.select(key, at.alias("_at"), *[(F.col(v) if v in table.columns else F.lit(None)).cast("double").alias(v) for v in values])
            first = lambda v: F.min(F.when(F.col(v).isNotNull(), F.struct("_at", F.col(v).alias("v"))))["v"].alias(v)
            known.append((name, one.groupBy(key).agg(*[first(v) for v in values]).withColumn("_order", F.lit(0))))
        else:
            warnings.append(f"{name}: none of {list(values)}")
    return coalesce_merge(base, known, [key], values, "_order"), warnings


def mean_of_repeats(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Repeated cells as their mean; cells of which all are missing stay missing."""
    return long.groupBy(*keys).agg(F.avg(S.nan_to_null(F.col(value))).alias(value))
