"""Sources: delimited, JSON and Parquet files with missing tokens, aliases and optional parts."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import MISSING, missing_to_null

#: What a file name says about its content, first match first.
RESOURCE_PATTERNS = [("segments", r"seg(ment)?s?[._-]|\.seg\."), ("arm_calls", r"arm"), ("purity", r"absolute|purity|ploidy"), ("expression", r"expr|rna|rsem|fpkm|tpm"), ("mutations", r"maf|mutation")]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a local one only where all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlake-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, which cuts its lineage durably."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = "\t", columns: Sequence[str] | None = None, missing: str = "strict", quote: str = "", file_column: str | None = None) -> DataFrame:
    """All columns as text, the source's missing tokens as null; only ``columns`` are parsed if named."""
    df = spark.read.csv(path, sep=sep, header=True, quote=quote, inferSchema=False, nullValue="\0", emptyValue="")
    if file_column:
        df = df.withColumn(file_column, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    keep = [c for c in df.columns if columns is None or c in columns or c == file_column]
    return df.select(*[missing_to_null(F.col(f"`{c}`"), missing).alias(c) for c in keep])


def read_auto(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """By extension: parquet, json, csv, else tab-separated; compression as Spark detects it."""
    name = re.sub(r"\.(gz|bz2|zst)$", "", path.rstrip("/").lower())
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    return read_delimited(spark, path, "," if name.endswith(".csv") else "\t", quote='"', **options)


def read_parquet_columns(spark: SparkSession, path: str, columns: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Pruned to the named columns; optional ones that the file lacks are null text."""
    df = spark.read.parquet(path)
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"{path} lacks {lost}")
    return add_missing(df, optional).select(*columns, *optional)


def optional_source(spark: SparkSession, path: str, schema: StructType | str, read: Callable[[SparkSession, str], DataFrame] = read_auto) -> DataFrame:
    """An absent path is an empty relation of the schema; a broken file raises."""
    return read(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def normalise_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among the columns, compared by letters and digits only."""
    known = {normalise_name(c): c for c in reversed(columns)}
    return next((known[normalise_name(c)] for c in candidates if normalise_name(c) in known), None)


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Canonical columns by alias; absent optional ones are null."""
    found = {name: first_present(df.columns, names) for name, names in aliases.items()}
    lost = [n for n in required if not found.get(n)]
    if lost:
        raise ValueError(f"no column for {lost}")
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()])


def add_missing(df: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c in columns if c not in df.columns])


def union_files(spark: SparkSession, paths: Sequence[str], aliases: dict[str, Sequence[str]], required: Sequence[str] = ()) -> tuple[DataFrame | None, list[str]]:
    """Files of varying headers as one relation with the file's name; files that lack
    required columns are left out and reported. Repeated rows collapse."""
    out, warnings = None, []
    for path in paths:
        try:
            one = resolve_aliases(read_auto(spark, path), aliases, required).withColumn("source_file", F.lit(path.rsplit("/", 1)[-1]))
        except ValueError as e:
            warnings.append(f"{path}: {e}")
            continue
        out = one if out is None else out.unionByName(one)
    return (out.distinct() if out is not None else None), warnings


def classify_resource(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return next((kind for kind, pattern in RESOURCE_PATTERNS if re.search(pattern, name)), "other")


def flatten_hits(df: DataFrame, id_col: str, lists: dict[str, str]) -> DataFrame:
    """Nested hits to one row each: list fields as distinct non-empty values joined by ';', in order."""
    joined = [F.array_join(F.array_distinct(F.filter(F.expr(path).cast("array<string>"), lambda x: x.isNotNull() & (x != ""))), ";").alias(name) for name, path in lists.items()]
    return df.select(id_col, *joined)


def select_configured(df: DataFrame, ids: Sequence[str], key: str) -> DataFrame:
    """The configured ids in their order; a missing or repeated one raises."""
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], f"ordinal int, `{key}` string")
    bad = [r[key] for r in df.where(F.col(key).isin(list(ids))).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()]
    lost = [r[key] for r in wanted.join(df.select(key), key, "left_anti").collect()]
    if bad or lost:
        raise ValueError(f"missing {lost}, repeated {bad}")
    return df.join(wanted, key).orderBy("ordinal")


def melt_matrix(df: DataFrame, feature: str, samples: Sequence[str] | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """A wide feature-by-sample matrix as (feature, sample, value); only the wanted rows and columns are read on."""
    rows = df.where(F.col(feature).isin(list(features))) if features else df
    columns = [c for c in df.columns if c != feature and (samples is None or c in samples)]
    cells = rows.select(F.col(feature).alias("feature"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    return cells.unpivot(["feature"], columns, "sample", "value")


def feature_sets(config: dict[str, object]) -> list[tuple[str, str]]:
    """(set, feature) pairs of {name: [..]} or {name: {"genes": [..]}}; empty or repeated sets raise."""
    out = []
    for name, value in config.items():
        genes = value.get("genes") if isinstance(value, dict) else value
        if not genes or len(set(genes)) != len(genes):
            raise ValueError(f"set {name} is empty or repeats features")
        out += [(name, str(g)) for g in genes]
    return out


def load_config(spark: SparkSession, path: str) -> dict:
    """JSON, or YAML where a parser is installed, read through the cluster's file system."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"{path} is empty")
    if path.endswith(".json"):
        return json.loads(text[0])
    import yaml

    return yaml.safe_load(text[0])


def stream_source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet file or directory read as a stream; a lone file is named by a pattern, as streams read directories."""
    files = spark.read.schema(schema).parquet(path).inputFiles()
    lone = len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rstrip("/").rsplit("/", 1)[-1]
    at = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{at[:-1]}[{at[-1]}]" if lone else at)


def missing_tokens(source: str) -> list[str]:
    return MISSING[source]
