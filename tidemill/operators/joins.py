"""Existence joins and fallbacks. Sides are broadcast only where Spark's own size check allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_exists(rows: DataFrame, other: DataFrame, key: list[str], name: str = "exists") -> DataFrame:
    """rows with a flag that says whether other has their key; null keys have no match."""
    marks = other.select(*key).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def existing(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(other.select(*key), key, "left_semi")


def missing(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(other.select(*key), key, "left_anti")


def enrich(listing: DataFrame, detail: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """listing with fields from detail where they are not empty, its own otherwise."""
    renamed = detail.select(*key, *(F.col(f).alias(f"_d_{f}") for f in fields))
    out = listing.join(renamed, key, "left")
    return out.select(*(_fallback(F.col(f"_d_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in listing.columns))


def _fallback(first: Column, second: Column) -> Column:
    return F.coalesce(F.when(first.cast("string") != "", first), second)
