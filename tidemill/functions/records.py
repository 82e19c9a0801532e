"""Values of records: JSON, maps, numbers and keys."""

from __future__ import annotations

import hashlib
import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_json(text: Column, schema: str, default: Column | None = None) -> Column:
    """JSON by a schema; the default where it can't be read."""
    found = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return found if default is None else F.coalesce(F.when(F.try_parse_json(text).isNotNull(), found), default)


def sink_value(value: Column, kind: T.DataType) -> Column:
    """What a column is written as by a SQL sink: nested values as JSON text, dates and times as text."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("string")
    return value


@F.pandas_udf(T.StringType())
def document_id(record: pd.Series) -> pd.Series:
    """MD5 of a record's JSON text with sorted keys and a space after separators."""

    def one(text: str | None) -> str | None:
        return None if text is None else hashlib.md5(json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    return record.map(one)


@F.pandas_udf(T.DoubleType())
def text_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks; null counts as empty."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])


@F.pandas_udf(T.DoubleType())
def _mean_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """The mean ratio of texts side by side; 0 for none."""

    def one(a, b) -> float:
        ratios = [SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)]
        return sum(ratios) / len(ratios) if ratios else 0.0

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


def map_similarity(left: Column, right: Column) -> Column:
    """Half the Jaccard of the keys, half the mean ratio of the values of common keys; both empty 1, one empty 0."""
    a, b = F.map_keys(left), F.map_keys(right)
    common = F.array_intersect(a, b)
    keys = F.size(common) / F.size(F.array_union(a, b))
    values = _mean_ratio(F.transform(common, lambda k: F.element_at(left, k)), F.transform(common, lambda k: F.element_at(right, k)))
    return F.when((F.size(left) <= 0) & (F.size(right) <= 0), 1.0).when((F.size(left) <= 0) | (F.size(right) <= 0), 0.0).otherwise(0.5 * keys + 0.5 * values)


def compact(record: Column, defaults: dict[str, str] | None = None) -> Column:
    """A map without null and empty values and those that equal their defaults."""
    known = F.create_map(*(F.lit(x) for pair in (defaults or {"": ""}).items() for x in pair))
    return F.map_filter(record, lambda k, v: v.isNotNull() & (v != "") & ~F.coalesce(F.try_element_at(known, k) == v, F.lit(False)))


def round_half_up(value: Column, places: int = 4) -> Column:
    """Decimal rounding, a half away from zero, of the number as it is written."""
    return F.round(value.cast("string").cast(T.DecimalType(38, 15)), places).cast("double")


def business_key(code: Column, date: Column) -> Column:
    """MD5 of code and date, stripped; 32 zeros if either is missing or blank."""
    c, d = F.trim(code), F.trim(date)
    return F.when((F.coalesce(c, F.lit("")) != "") & (F.coalesce(d, F.lit("")) != ""), F.md5(F.concat(c, d))).otherwise("0" * 32)


def exchange_suffix(code: Column) -> Column:
    """A six-digit stock code with its exchange; null for a code that no exchange has."""
    s = F.trim(code.cast("string"))
    s = F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)
    two = F.substring(s, 1, 2)
    # fixed values: prefixes by exchange
    suffix = (
        F.when(two.isin("60", "68"), ".SH")
        .when(two.isin("00", "01", "02", "30"), ".SZ")
        .when(two.isin("43", "82", "83", "87", "88") | (F.startswith(s, F.lit("920")) & (s <= "920999")), ".BJ")
    )
    return F.when((F.trim(code.cast("string")) != "") & F.rlike(s, F.lit(r"\A\d{6}\z")), F.concat(s, suffix))


def tenure(text: Column) -> Column:
    """struct(start, end) of dates from a text such as 2020-01-02至2023-04-05; an end of 至今 is null."""
    parts = F.split(F.regexp_replace(text, "至今", "至"), "至")
    day = lambda i: F.try_to_date(F.trim(F.try_element_at(parts, F.lit(i))), "yyyy-MM-dd")
    return F.struct(day(1).alias("start"), day(2).alias("end"))
