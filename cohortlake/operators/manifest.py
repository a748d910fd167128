"""File listings: ids of nested hits, pages of a search, matches with a cohort, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def name_ids(name: Column, pattern: str) -> Column:
    """All ids in a file name, upper-cased."""
    return F.regexp_extract_all(F.upper(F.coalesce(name, F.lit(""))), F.lit(pattern), F.lit(0))


def hit_ids(hits: DataFrame, pattern: str, sample_length: int = 16) -> DataFrame:
    """hits (file_id, file_name, cases array<struct<project, submitter_id, samples array<struct<submitter_id>>>>)
    with sorted sets of project, case and sample ids. Ids in the file name count as
    samples from the given length on, else as cases; longer sample ids are aliquots."""
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))))
    cases = F.coalesce("cases", F.array().cast(hits.schema["cases"].dataType))
    named = name_ids(F.col("file_name"), pattern)
    samples = F.flatten(F.transform(cases, lambda c: F.coalesce(F.transform(c["samples"], lambda s: s["submitter_id"]), F.array().cast("array<string>"))))
    long = lambda x: F.length(x) >= sample_length
    out = hits.withColumns({
        "project_ids": clean(F.transform(cases, lambda c: c["project"])),
        "case_ids": clean(F.concat(F.transform(cases, lambda c: c["submitter_id"]), F.filter(named, lambda x: ~long(x)))),
        "sample_ids": clean(F.concat(samples, F.filter(named, long))),
    })
    return out.withColumn("aliquot_ids", F.filter("sample_ids", lambda x: F.length(x) > sample_length))


def first_pages(pages: DataFrame, filters: Sequence[str], most: int) -> tuple[DataFrame, bool]:
    """The hits of the first filter set that has any, in pages up to its total or the
    cap, and whether the cap cut them. pages: (filter_name, page_offset, total, hits array)."""
    counts = {r["filter_name"]: (r["n"], r["total"]) for r in pages.groupBy("filter_name").agg(F.sum(F.size("hits")).alias("n"), F.max("total").alias("total")).where(F.col("filter_name").isin(list(filters))).collect()}  # one row per filter set
    chosen = next((f for f in filters if counts.get(f, (0, 0))[0]), filters[-1])
    mine = pages.where((F.col("filter_name") == chosen) & (F.col("page_offset") < most) & (F.col("page_offset") < F.greatest(F.col("total"), F.lit(1))))
    return mine.select("filter_name", F.explode("hits").alias("hit")), counts.get(chosen, (0, 0))[1] > most


def matched_hits(ids: DataFrame, cohort: DataFrame, file_key: str = "file_id") -> DataFrame:
    """(file, sample, patient, match_level): every cohort sample that the file names;
    where there is none, every cohort patient (with its one sample, or all, joined);
    else one unmatched row. ids: (file, sample_ids, case_ids); cohort: (sample, patient)."""
    keys = ids.select(file_key, F.explode(F.transform("sample_ids", lambda x: S.sample_key(x))).alias("sample"))
    by_sample = keys.join(cohort.select("sample", "patient").distinct(), "sample").select(file_key, "sample", "patient", F.lit("sample").alias("match_level")).distinct()
    patients = cohort.groupBy("patient").agg(F.array_join(F.array_sort(F.collect_set("sample")), ";").alias("sample"))
    rest = ids.join(by_sample, file_key, "left_anti")
    named = rest.select(file_key, F.explode(F.array_distinct(F.transform(F.concat("sample_ids", "case_ids"), lambda x: S.group_key(x)))).alias("patient"))
    by_patient = named.join(patients, "patient").select(file_key, "sample", "patient", F.lit("patient").alias("match_level")).distinct()
    none = rest.join(by_patient, file_key, "left_anti").select(file_key, F.lit("NA").alias("sample"), F.lit("NA").alias("patient"), F.lit("unmatched").alias("match_level")).distinct()
    return by_sample.unionAll(by_patient).unionAll(none)


def priority(kind: Column, order: Sequence[str], other: int = 9) -> Column:
    """The place of a kind in the order."""
    out = F.lit(other)
    for i, k in reversed(list(enumerate(order))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def capped(files: DataFrame, mode: str, most: int, order: Sequence[Column]) -> DataFrame:
    """All files, or the first ``most`` in order in a capped mode; other modes raise."""
    if mode in ("none", "pilot_full"):
        return files
    if mode in ("pilot_capped", "candidates_capped"):
        return files.orderBy(*order).limit(most)
    raise ValueError(f"unknown mode {mode}")


#: Kinds of sequencing files by their names.
ASSETS = [("bam", r"\.(bam|cram)$"), ("vcf", r"\.vcf(\.gz)?$"), ("pileup", r"pileup|\.seqz")]


def readiness(samples: DataFrame, files: DataFrame, pattern: str, normal_codes: tuple[int, int] = (10, 14)) -> DataFrame:
    """samples (sample, patient, has_alleles) with the files that name their patient
    (``files``: path): what is there, and what a tumour/normal caller still lacks."""
    lower = F.lower("path")
    kind = S.first_match([(lower.rlike(p), k) for k, p in ASSETS], None)
    key = F.regexp_extract(F.upper("path"), pattern, 0)
    normal = lower.rlike("normal|blood|germline") | F.coalesce(S.sample_code(key).between(*normal_codes), F.lit(False))
    known = files.withColumns({"patient": S.group_key(key), "kind": kind}).where("kind is not null").withColumn("kind", F.when((F.col("kind") == "bam") & normal, "normal_bam").otherwise(F.col("kind")))
    has = lambda k: F.bool_or(F.col("kind") == k)
    found = known.groupBy("patient").agg(has("bam").alias("tumor_bam"), has("normal_bam").alias("normal_bam"), has("vcf").alias("vcf"), has("pileup").alias("pileup"))
    out = samples.join(found, "patient", "left").fillna(False, ["tumor_bam", "normal_bam", "vcf", "pileup"])
    ready, pile = F.col("has_alleles"), F.col("pileup")
    lacks = [("tumor_bam_or_counts", ~ready & ~F.col("tumor_bam") & ~pile), ("normal_bam_or_counts", ~ready & ~F.col("normal_bam") & ~pile), ("pileup_or_equivalent", ~ready & ~pile)]
    return out.withColumn("missing_inputs", S.reasons(lacks))


def preview(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """The rows and columns that another tool takes; null as NA text."""
    return df.where(condition).select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns])
