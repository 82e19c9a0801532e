"""Write modes over tables as DataFrames: what a table holds after insert, upsert, replace, ignore, update and delete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.dedup import keep_first


def write_mode(update_columns: list[str] = (), auto_update: bool = False, insert_ignore: bool = False) -> str:
    """upsert before replace before ignore before insert."""
    return "upsert" if update_columns else "replace" if auto_update else "ignore" if insert_ignore else "insert"


def batch(*parts: DataFrame, missing: str | None = None) -> DataFrame:
    """All rows under the sorted union of the columns; what a part lacks is null, or missing as text."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = sorted(whole.columns)
    if missing is None:
        return whole.select(*columns)
    # only what a part lacks, not its own nulls
    return reduce(lambda a, b: a.unionByName(b), (p.select(*(F.col(c).cast("string") if c in p.columns else F.lit(missing).alias(c) for c in columns)) for p in parts))


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows, allowMissingColumns=True)


def replace(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last of rows for a key stands in for the target's row."""
    newest = keep_first(rows, key, order, last=True).select(*target.columns)
    return target.join(newest.select(*key), key, "left_anti").select(*target.columns).unionByName(newest)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first of rows for a key goes in if the target has none."""
    oldest = keep_first(rows, key, order).select(*target.columns)
    return target.unionByName(oldest.join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update_columns: list[str], order: list[str]) -> DataFrame:
    """New keys go in as they came first, with update_columns as they came last; of present keys only update_columns change."""
    last = keep_first(rows, key, order, last=True).select(*key, *(F.col(c).alias(f"_new_{c}") for c in update_columns), F.lit(True).alias("_hit"))
    kept = target.join(last, key, "left").select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update_columns else F.col(c) for c in target.columns))
    first = keep_first(rows, key, order).select(*target.columns).join(target.select(*key), key, "left_anti").join(last, key)
    return kept.unionByName(first.select(*(F.col(f"_new_{c}").alias(c) if c in update_columns else F.col(c) for c in target.columns)))


def _all_equal(where: dict[str, object]) -> Column:
    if not where:
        raise ValueError("give conditions")
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in where.items()))


def update(target: DataFrame, changes: dict[str, object], where: dict[str, object]) -> DataFrame:
    hit = F.coalesce(_all_equal(where), F.lit(False))
    return target.select(*(F.when(hit, F.lit(changes[c])).otherwise(F.col(c)).cast(t).alias(c) if c in changes else F.col(c) for c, t in target.dtypes))


def delete(target: DataFrame, where: dict[str, object]) -> DataFrame:
    return target.filter(~F.coalesce(_all_equal(where), F.lit(False)))


def lookup(conditions: dict[str, object]) -> Column:
    """A predicate from names with operators: col__gt, gte, lt, lte, ne, like, in, eq; one that is not known means equal."""

    def one(name: str, value: object) -> Column:
        column, _, op = name.partition("__")
        c = F.col(column)
        made = {"gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value, "ne": lambda: c != value, "like": lambda: c.like(value), "in": lambda: c.isin(list(value))}
        return made.get(op, lambda: c == value)()

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in conditions.items()), F.lit(True))


# Error codes of one database by what to do about them.
SKIP_CODES, RETRY_CODES = (1062, 1048, 1213, 1205), (2002, 2003, 2006, 2013)


def error_action(code: int) -> str:
    return "skip" if code in SKIP_CODES else "retry" if code in RETRY_CODES else "fatal"
