"""Validation of fields, with the rows that fail set apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import strip


@dataclass(frozen=True)
class Field:
    """nullable: whether empty is allowed; default: what stands in for empty; kind: a Spark type that a text must cast to; max_length: of texts."""

    nullable: bool = True
    default: object = None
    kind: str | None = None
    max_length: int | None = None


def _checked(name: str, kind: str, field: Field) -> tuple[Column, Column]:
    value = F.col(name)
    empty = value.isNull() | (strip(value) == "") if kind == "string" else value.isNull()
    out = value if field.default is None else F.when(empty, F.lit(field.default)).otherwise(value)
    problem = F.when(empty, F.lit(None if field.nullable or field.default is not None else f"{name}: empty"))
    if field.kind and kind == "string" and field.kind != "string":
        problem = problem.when(value.try_cast(field.kind).isNull(), f"{name}: no {field.kind}")
    elif field.kind and field.kind != kind:
        problem = problem.when(F.lit(True), f"{name}: no {field.kind}")
    if field.max_length and kind == "string":
        problem = problem.when(F.length(value) > field.max_length, f"{name}: too long")
    return out, problem


def validate(rows: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """rows with defaults filled in and _errors, an array of what is wrong. Empty is null or, for texts, only white space."""
    kinds = dict(rows.dtypes)
    checked = {n: _checked(n, kinds[n], f) for n, f in fields.items()}
    errors = F.filter(F.array(*(p for _, p in checked.values())), lambda e: e.isNotNull())
    return rows.select(*(checked[c][0].alias(c) if c in checked else F.col(c) for c in rows.columns), errors.alias("_errors"))


def quarantine(rows: DataFrame, fields: dict[str, Field]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their errors."""
    marked = validate(rows, fields)
    return marked.filter(F.size("_errors") == 0).drop("_errors"), marked.filter(F.size("_errors") > 0)
