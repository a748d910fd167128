"""Contracts: required columns, keys, referential integrity, locked orders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, set_hash
from .joins import assert_unique


class ContractError(ValueError):
    pass


def check_columns(df: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    """Every named column is there and, where a kind is given, of that Spark type."""
    have = dict(df.dtypes)
    faults = [f"{c}: {have.get(c, 'absent')}" for c, kind in kinds.items() if c not in have or kind not in (None, have[c])]
    if faults:
        raise ContractError("; ".join(faults))
    return df


def clean_keys(df: DataFrame, key: str, label: str = "table") -> DataFrame:
    """No blank keys; repeated rows collapse; conflicting ones raise."""
    if not df.where(F.col(key).isNull() | (F.trim(key) == "")).isEmpty():
        raise ContractError(f"{label}: blank keys")
    return assert_unique(df.distinct(), [key], label)


def check_references(df: DataFrame, dimension: DataFrame, on: Sequence[str], label: str = "table") -> None:
    bad = df.select(*on).distinct().join(dimension.select(*on), list(on), "left_anti").limit(5).collect()
    if bad:
        raise ContractError(f"{label}: unknown {[tuple(b) for b in bad]}")


def check_partition(mapping: DataFrame, universe: DataFrame, key: str) -> None:
    """Every key of the universe is mapped, once, and nothing else is."""
    assert_unique(mapping, [key], "mapping")
    check_references(universe, mapping, [key], "universe")
    check_references(mapping, universe, [key], "mapping")


def check_finite(df: DataFrame, columns: Sequence[str], label: str = "table") -> None:
    bad = df.agg(*[F.sum(F.when(finite(F.col(c).cast("double")), 0).otherwise(1)).alias(c) for c in columns]).first()
    lost = [c for c in columns if bad[c]]
    if lost:
        raise ContractError(f"{label}: values that are not finite in {lost}")


def contract_hash(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def order_hash(df: DataFrame, value: str, order: str) -> DataFrame:
    """SHA-256 over the values in order, one per line. Bounded dimensions only: features, members."""
    return df.agg(set_hash(F.col(value), F.col(order)).alias("sha256"))
