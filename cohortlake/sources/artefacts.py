"""Versioned artefacts (fitted models with their tables) in a shared folder.

The tables of a version go to a folder of their own; the version exists once its
manifest has been renamed into place, which succeeds for one writer only. Readers
see whole versions or none, and a lost writer leaves a folder that nothing names.
A manifest holds each table's schema, rows and an order-free checksum.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contract import ContractError, contract_hash

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


@dataclass
class Artefact:
    name: str
    version: int
    facts: dict
    tables: dict[str, DataFrame]


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, str]:
    """(rows, checksum): equal for equal bags of rows, in whatever order and partitions."""
    cols = [F.col(f"`{c}`") for c in columns or df.columns]
    h = F.xxhash64(*cols, *[c.isNull() for c in cols])  # a null changes no hash by itself
    low = h.bitwiseAND(F.lit((1 << 31) - 1))
    row = df.select(h.alias("h"), low.alias("low")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum("low"), F.lit(0))).first()
    return row[0], f"{row[1] & (1 << 64) - 1:016x}-{row[2]:x}"


class Store:
    """Artefacts by name and version under ``root``, a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = path.getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _check(self, name: str) -> None:
        if not _NAME.fullmatch(name):
            raise ValueError(f"{name!r} is no name of an artefact or table")

    def versions(self, name: str) -> list[int]:
        self._check(name)
        where = self._path(name)
        if not self._fs.exists(where):
            return []
        found = (re.fullmatch(r"v(\d{8})\.json", s.getPath().getName()) for s in self._fs.listStatus(where))
        return sorted(int(m[1]) for m in found if m)

    def save(self, name: str, tables: dict[str, DataFrame], facts: dict) -> int:
        """A new version, one above the last; its number. Nothing is overwritten: of
        writers at the same time each gets a number of its own."""
        for n in (name, *tables):
            self._check(n)
        folder = f"data-{uuid.uuid4().hex}"
        listed = {}
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{folder}/{table}")
            rows, digest = checksum(self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/{folder}/{table}"))
            listed[table] = {"schema": json.loads(df.schema.json()), "rows": rows, "checksum": digest}
        body = {"name": name, "folder": folder, "tables": listed, "facts": facts}
        text = json.dumps(body | {"sha256": contract_hash(body)}, indent=1)
        draft = self._path(name, f".{folder}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        version = max(self.versions(name), default=0) + 1
        while True:
            try:
                files.rename(draft, self._path(name, f"v{version:08d}.json"), never_over)
                return version
            except Exception:
                if version not in self.versions(name):  # not taken by another writer: a real failure
                    raise
                version += 1

    def load(self, name: str, version: int | None = None, verify: bool = True) -> Artefact:
        """The named version (the last one by default). A version that isn't there, a
        manifest that was changed, and tables that are lost, of another schema or (with
        ``verify``, which scans them) of other rows raise."""
        have = self.versions(name)
        if not have or version is not None and version not in have:
            raise ContractError(f"{name}: no version {'' if version is None else version}; there are {have}")
        version = have[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/{name}/v{version:08d}.json", wholetext=True).first()
        try:
            body = json.loads(text[0])
            given = body.pop("sha256")
        except (TypeError, ValueError, KeyError):
            raise ContractError(f"{name} {version}: the manifest can't be read") from None
        if given != contract_hash(body) or body["name"] != name:
            raise ContractError(f"{name} {version}: the manifest was changed")
        tables = {}
        for table, facts in body["tables"].items():
            path = f"{self.root}/{name}/{body['folder']}/{table}"
            if not self._fs.exists(self._path(name, body["folder"], table)):
                raise ContractError(f"{name} {version}: the table {table} is lost")
            found = self.spark.read.parquet(path)
            want = StructType.fromJson(facts["schema"])
            if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in want]:
                raise ContractError(f"{name} {version}: the table {table} has another schema")
            if verify and checksum(found) != (facts["rows"], facts["checksum"]):
                raise ContractError(f"{name} {version}: the table {table} has other rows")
            tables[table] = found
        return Artefact(name, version, body["facts"], tables)
