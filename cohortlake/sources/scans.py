"""Scans of text tables that cut only what is asked for: wide matrices by row name
and column position, and any number of files of varying headers in one plan.

Both read lines through Spark's text source, so that any file system and
compression works and large files are split; every line carries its file, its
block and an id that grows within the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import gene_symbol, missing_to_null
from .readers import first_present

#: Names of the column that names the rows of a wide matrix.
ROW_NAMES = ["gene_id", "gene", "gene_symbol", "hugo_symbol", "hugo_symbol_or_gene_id"]
#: Row names up to this number are tested in the scan, more are joined.
FEW = 1000


def lines_of(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, at, file, block): lines with ids that grow within a block of a file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def line_numbers(lines: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` of the lines with ``line``, their number in their file from 1: lines of
    earlier blocks are counted, so no file is ordered in one task."""
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("_before", before)  # a row per block
    return some.join(placed, ["file", "block"]).withColumn("line", F.col("_before") + F.col("at") - F.col("_first") + 1).drop("_n", "_first", "_before")


def unquoted(text: str) -> str:
    return text.strip().strip('"')


@dataclass
class WideScan:
    """``rows``: (feature, values) with a value per asked column, ``cells``: (feature,
    position, column, value), ``short``: (row, feature, n_fields) of rows that end
    before the last asked column; ``columns``: the asked ones in the file's order."""

    rows: DataFrame
    cells: DataFrame
    short: DataFrame
    columns: list[str]


def _number(cell: bytes) -> float | None:
    try:
        value = float(cell.strip().strip(b'"'))
    except ValueError:
        return None
    return None if value != value or b"_" in cell else value


def scan_wide(spark: SparkSession, path: str, columns: Sequence[str] | Callable[[str], bool] | None = None, features: Sequence[str] | None = None, sep: str | None = None, row_names: Sequence[str] = ROW_NAMES, clean: Callable[[Column], Column] = gene_symbol) -> WideScan:
    """A matrix of one header line and a line per feature, only partly cut.

    The name of a row is tested before the row is cut; of a wanted row only the
    cells of asked columns are parsed (text that is no number is null). Rows that
    have too few fields for the asked columns are reported with their number,
    header not counted, wanted or not; a last empty field doesn't count as one.
    No asked column: no rows. Memory is that of a batch of lines.
    """
    lines = lines_of(spark, path)
    head = lines.where("block = 0").select("value").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    sep = sep or ("\t" if "\t" in head[0] else ",")
    names = [unquoted(c) for c in head[0].split(sep)]
    key = next((i for i, n in enumerate(names) if n.lower() in row_names), 0)
    wanted = columns if callable(columns) else (lambda n: True) if columns is None else set(columns).__contains__
    places = [i for i, n in enumerate(names) if i != key and wanted(n)]
    last = max(places, default=-1)

    value = F.col("value")
    n_fields = F.length(value) - F.length(F.replace(value, F.lit(sep))) + 1 - F.endswith(value, F.lit(sep)).cast("int")
    name = clean(F.trim(F.substring_index(F.substring_index(value, sep, key + 1), sep, -1)))
    body = lines.where((value != head[0]) & (value != "")).withColumns({"n_fields": n_fields, "feature": name})
    whole = body.where(F.col("n_fields") > last) if places else body.where("false")
    if features is not None:
        if len(features) <= FEW:
            whole = whole.where(F.col("feature").isin(list(features)))
        else:
            whole = whole.join(spark.createDataFrame([(f,) for f in sorted(set(features))], "feature string"), "feature", "left_semi")
    mark = sep.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line in batch.column("value").cast(pa.binary()):
                line = line.as_py()
                ends = np.flatnonzero(np.frombuffer(line, np.uint8) == mark[0])
                out.append([_number(line[int(ends[i - 1]) + 1 if i else 0 : int(ends[i]) if i < len(ends) else len(line)]) for i in places])
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(out, pa.list_(pa.float64()))], ["feature", "values"])

    rows = whole.select("feature", "value").mapInArrow(cut, "feature string, values array<double>")
    named = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(names[i]).alias("column")) for i in places]) if places else F.array().cast("array<struct<position: int, column: string>>")
    cells = rows.select("feature", F.explode(F.arrays_zip(named.alias("c"), F.col("values").alias("v"))).alias("x")).select("feature", "x.c.position", "x.c.column", F.col("x.v").alias("value"))
    short = body.where(F.col("n_fields") <= last).select("file", "block", "at", "feature", "n_fields")
    return WideScan(rows, cells, line_numbers(lines, short).select((F.col("line") - 1).alias("row"), "feature", "n_fields"), [names[i] for i in places])


def collapsed(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(feature, sample, value): repeated features are averaged within each column, then
    the columns of a sample. samples: (column, sample)."""
    one = cells.groupBy("feature", "position", "column").agg(F.avg("value").alias("value"))
    return one.join(samples, "column").groupBy("feature", "sample").agg(F.avg("value").alias("value"))


def scan_headed(spark: SparkSession, path: str | Sequence[str], aliases: dict[str, Sequence[str]], required: Sequence[str] = (), comment: str = "#", separators: str = "\t,;", missing: str = "strict") -> tuple[DataFrame, DataFrame]:
    """((file, *aliases), (file, warning)): delimited files whatever the order and names
    of their columns, as text.

    The first line of each file that is no comment is its header; its separator is
    the one it holds most of. Headers become a table of positions, which every line
    is joined to by its file: one plan for any number of files. Files without a
    required column give a warning and no rows, as do files without a header;
    optional columns that lack are null. The header must stand in a file's first
    block. Empty fields and the source's missing tokens are null; quotes around a
    field go, separators within quotes aren't supported.
    """
    lines = lines_of(spark, path).where((F.trim("value") != "") & ~F.startswith("value", F.lit(comment)))
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("head_at"))
    names = list(aliases)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for header in batch.column("header").to_pylist():
                sep = max(separators, key=header.count)
                have = [unquoted(c) for c in header.split(sep)]
                found = {n: first_present(have, of) for n, of in aliases.items()}
                lost = [n for n in required if not found[n]]
                out.append((sep, [have.index(found[n]) if found[n] else -1 for n in names], f"missing_required_columns_{','.join(lost)}" if lost else None))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("head_at"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.int32()), pa.string())))], ["file", "head_at", "sep", "places", "warning"])

    table = heads.mapInArrow(index, "file string, head_at long, sep string, places array<int>, warning string")
    body = lines.join(table.where("warning IS NULL"), "file").where("at <> head_at").select("file", "places", F.split("value", F.col("sep"), -1).alias("fields"))
    field = lambda i: F.when(F.col("places")[i] >= 0, F.get("fields", F.col("places")[i]))
    rows = body.select("file", *[missing_to_null(F.trim(F.btrim(field(i), F.lit('" '))), missing).alias(n) for i, n in enumerate(names)])
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")  # the listing that a scan holds anyway; empty files are in no scan
    plain = lambda df: df.withColumn("_plain", F.regexp_replace("file", "^(\\w+):/+", "$1:/"))  # noqa: E731  local files have one slash or three
    bare = plain(files).join(plain(heads), "_plain", "left_anti").select("file", F.lit("empty_file").alias("warning"))
    return rows, table.where("warning IS NOT NULL").select("file", "warning").unionByName(bare)
