"""Documents to training sequences: toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import jaccard, packing, suffix_dedup, toxicity
from cohortlake.llm.common import Scratch

#: A repeated passage: about fifty words (few runs of 51 words are shorter, see README).
PASSAGE_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below 0.7; the labels' held-out fold is not learned from.

    Null and empty texts get the base score and stay; rows that repeat or share
    an id are each judged by their own text; a null id has no label.
    """
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model, 0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (five-word shingles, Jaccard 0.8): that of the smallest id.

    Rows count by themselves, whatever their ids: a row is known by 64 bits of
    its id and text. Rows that share both are copies, of which one stays; rows
    that share an id alone are compared like any others, null ids too (they
    come after all others when one row is chosen). Rows without words stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of the caller can't clash with ours
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    plain = docs.toDF(*names)
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = plain.where(worded).withColumn("row", F.xxhash64(doc_id, text))
    scratch = Scratch(spark, "near")
    groups = jaccard.link_components(rows, scratch, id_col="row", text_col=names[docs.columns.index("text")], size=5, percent=80)
    ids = rows.select("row", doc_id.alias("id")).distinct()
    named = groups.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    kept = scratch.table(named.groupBy("component_id").agg(least.alias("first")).select("first.row"))
    some = rows.join(kept, "row").dropDuplicates(["row"]).select(*names)
    return some.unionByName(plain.where(~worded)).toDF(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere too, the first place included.

    Every row stays; null and empty texts are unchanged, ids are only carried,
    and rows that repeat lose what they share. ``n_chars``, where there is
    such a column, is set anew.
    """
    return suffix_dedup.without_repeats(docs, Scratch(spark, "passages"), length=PASSAGE_BYTES, size_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids. A null or empty text is its end id alone;
    ids are only carried, so rows that share one, or have none, are each packed."""
    return packing.pack(docs, Scratch(spark, "pack"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("passages", cut_passages), ("packing", pack)]

#: No stage can be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    tables = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
