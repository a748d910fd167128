"""Sinks: delimited text with NA, Parquet, JSON artefacts, trees, tables in Markdown."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def write_tsv(df: DataFrame, path: str, gzip: bool = False, missing: str = "NA", single: bool = False) -> None:
    """Header, tabs, null as ``missing``. ``single`` makes one file: for small tables."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)).alias(c) for c in df.columns])
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", compression="gzip" if gzip else "none", emptyValue="")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text through the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_json(spark: SparkSession, data: object, path: str) -> None:
    write_text(spark, json.dumps(data, indent=2, sort_keys=True, default=str) + "\n", path)


def write_matrix(long: DataFrame, row: str, column: str, value: str, order: Sequence[str], path: str) -> None:
    """Long to wide at the sink, columns in the given order."""
    write_tsv(long.groupBy(row).pivot(column, list(order)).agg(F.first(value)).orderBy(row), path, single=True)


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50, digits: int = 4) -> str:
    """The first rows as a table; bars are escaped, null is NA."""
    columns = list(columns or df.columns)
    cell = lambda v: "NA" if v is None else (f"{v:.{digits}g}" if isinstance(v, float) else str(v).replace("|", r"\|").replace("\n", " "))
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in df.select(*columns).limit(limit).collect()])


def check_outputs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, exists) of every output; raises if one is absent."""
    rows = [(p, exists(spark, p)) for p in paths]
    lost = [p for p, there in rows if not there]
    if lost:
        raise FileNotFoundError(f"outputs not written: {lost}")
    return spark.createDataFrame(rows, "path string, exists boolean")
