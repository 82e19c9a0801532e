"""Fingerprints and first-seen deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.web import canonical_url


def request_fingerprint(method: Column, url: Column, body: Column | None = None, headers: Column | None = None, include: list[str] = (), meta: Column | None = None) -> Column:
    """MD5 of method, canonical URL and body; of headers only those in include, by lower-case name in order; of meta all, in order."""
    parts = [method, canonical_url(url)]
    if body is not None:
        parts.append(F.coalesce(body.cast("string"), F.lit("")))
    if include and headers is not None:
        low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
        for name in sorted({h.lower() for h in include}):
            value = F.try_element_at(low, F.lit(name))
            parts.append(F.coalesce(F.concat(F.lit(f"{name}:"), value), F.lit("")))
    if meta is not None:
        pairs = F.array_sort(F.transform(F.map_entries(meta), lambda e: F.concat(F.lit("meta_"), e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("None")))))
        parts.append(F.coalesce(F.array_join(pairs, ""), F.lit("")))
    return F.md5(F.concat(*parts))


def item_fingerprint(values: dict[str, Column], version: str | None = None) -> Column:
    """SHA-256 of k=v over sorted names, divided by |, nulls left out; with a version, that and a colon before it.

    Nothing is escaped. Texts and whole numbers are written alike everywhere; other types are written as Spark casts them.
    """
    parts = [F.concat(F.lit(f"{k}="), values[k].cast("string")) for k in sorted(values)]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit(f"{version}:"), digest) if version else digest


def keep_first(rows: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by order. A grouped minimum, so that a key of many rows is combined before the shuffle."""
    first = [c for c in order if c not in key]
    rest = [c for c in rows.columns if c not in key and c not in first]
    whole = F.struct(*first, *rest)
    best = (F.max_by if last else F.min_by)(whole, F.struct(*order)) if rest else (F.max if last else F.min)(whole)
    return rows.groupBy(*key).agg(best.alias("_row")).select(*(F.col(c) if c in key else F.col(f"_row.{c}") for c in rows.columns))


def split_duplicates(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """First rows of each key by order, and the others. A null key is a key."""
    firsts = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), "_first")
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    marked = rows.join(firsts, same).withColumn("_is_first", F.struct(*order).eqNullSafe(F.col("_first")))
    return marked.filter("_is_first").select(*rows.columns), marked.filter("NOT _is_first").select(*rows.columns)


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key was never seen."""
    return rows.join(seen.select(*key), key, "left_anti")


def remember(seen: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The union of two sets of fingerprints."""
    return seen.select(*key).union(new.select(*key)).distinct()


def once_in(rows: DataFrame, key: list[str], time: str, seconds: float, ties: list[str] = ()) -> DataFrame:
    """Rows that are the first of their key for so long: later ones within seconds of an accepted row go, without extending its time.

    Null is a key like others. Of equal times the first by ties stays (without them, any). A row without time can't be
    placed and stays. Rows are hashed by key and sorted; a task goes through them once and remembers one time, so a key
    of any size takes no memory.
    """
    names = rows.columns
    keyed = rows.withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    timed = keyed.filter(F.col(time).isNotNull()).withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")))
    window = round(seconds * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, accepted = None, 0
        for part in batches:
            keep = []
            for k, t in zip(part.column("_key").to_pylist(), part.column("_at").to_pylist(), strict=True):
                new = k != last or t - accepted >= window
                if new:
                    last, accepted = k, t
                keep.append(new)
            yield part.filter(pa.array(keep, pa.bool_()))

    kept = timed.repartition("_key").sortWithinPartitions("_key", "_at", *ties).mapInArrow(run, timed.schema)
    return kept.select(*names).union(rows.filter(F.col(time).isNull()))


def filter_stats(rows: DataFrame, key: Column) -> DataFrame:
    """One row: total, unique, duplicates and their rate as text."""
    counted = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique"))
    dup = F.col("total") - F.col("unique")
    rate = F.when(F.col("total") > 0, dup * 100.0 / F.col("total")).otherwise(0.0)
    return counted.select("total", "unique", dup.alias("duplicates"), F.format_string("%.2f%%", rate).alias("duplicate_rate"))
