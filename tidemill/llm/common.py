"""Helpers that several operators share: tables kept in the cluster's shared folder and connected components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemill.operators.bloom import BROADCAST_BUCKETS, BUCKET_BITS, Bloom, unseen

ROWS_A_FILE = 500_000

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of so many rows at most, unless the session asks for fewer: whole texts may be long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def even_share(cells: list[tuple[int, float]], sample: int, most: int, chars: float) -> int:
    """How many rows of each cell (rows, characters a row) may go into a sample: the most, up to sample, that keep to most rows and chars characters in all; one at least."""
    low, high = 1, max(1, sample)
    while low < high:
        middle = (low + high + 1) // 2
        fits = sum(min(n, middle) for n, _ in cells) <= most and sum(min(n, middle) * c for n, c in cells) <= chars
        low, high = (middle, high) if fits else (low, middle - 1)
    return low


def pick_texts(marked: DataFrame, cell: list[str], sample: int, most: int, chars: int) -> tuple[DataFrame | None, dict[tuple, int]]:
    """Of each cell at most sample different texts (fewer where all would pass most texts or chars characters; one at least), those of the smallest hashes.

    marked: a row for each text of a cell, with print (hash of the text), size (its characters) and id (anything that finds it again; the
    smallest is kept). Copies are counted where they lie, before rows meet. Returns cell, print, id and nth (of its cell), most rows or one a cell at
    most, and the number of rows of each cell; None without texts.
    """
    return pick_distinct(distinct_texts(marked, cell), cell, sample, most, chars)


def distinct_texts(marked: DataFrame, cell: list[str]) -> DataFrame:
    """The different texts of each cell, kept as a table: cell, print, the smallest id, size, and rows, how many rows have the text. marked as for pick_texts."""
    return stash(marked.groupBy(*cell, "print").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.count(F.lit(1)).alias("rows")), "prints")


def pick_distinct(distinct: DataFrame, cell: list[str], sample: int, most: int, chars: int) -> tuple[DataFrame | None, dict[tuple, int]]:
    """What pick_texts gives, from distinct_texts."""
    counts = distinct.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("size"), F.sum("rows").alias("rows")).collect()
    if not counts:
        return None, {}
    wanted = even_share([(r["n"], r["size"]) for r in counts], sample, most, chars)
    # so many by hash that wanted ones are met but for a chance in a million; then the first by hash
    kinds = dict(distinct.dtypes)
    share = distinct.sparkSession.createDataFrame([(*(r[c] for c in cell), min(1.0, (wanted + 5 * wanted**0.5 + 5) / r["n"])) for r in counts], ", ".join(f"{c} {kinds[c]}" for c in cell) + ", share double")
    h = F.xxhash64("print", F.lit(11))
    near = distinct.join(small(share, len(counts)), cell).filter(F.pmod(h, F.lit(1_000_000)) < F.col("share") * 1_000_000)
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy(h, "print"))
    return stash(near.withColumn("nth", nth).filter(F.col("nth") <= wanted).select(*cell, "print", "id", "nth"), "picked"), {tuple(r[c] for c in cell): r["rows"] for r in counts}


def small(df: DataFrame, rows: int, most: int = 50_000) -> DataFrame:
    """df, of which rows are known, to be broadcast if it is small; else Spark decides."""
    return F.broadcast(df) if rows <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a folder of this machine, if all of Spark runs on it, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
    return _own[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that later steps neither repeat its work nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Kept:
    """Cached intermediate tables, which lost executors rebuild from their lineage; all let go at once."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def drop(self) -> None:
        for df in self.frames:
            df.unpersist()
        self.frames.clear()


def _filter(ids: DataFrame, key: str) -> Bloom | None:
    """A Bloom filter of the different keys of ids that is small enough to be broadcast: 2 false positives in 100, more where keys are many; None where it would hold back less than half of the other rows."""
    keys = ids.count()
    rate = max(0.02, math.exp(-(math.log(2) ** 2) * 0.85 * BROADCAST_BUCKETS * BUCKET_BITS / max(1, keys)))
    if rate > 0.5:
        return None
    bloom = Bloom.of(ids, [key], keys, rate)
    bloom.bits = stash(bloom.bits, "bits")
    return bloom


def maybe(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids (different keys, read from files), and few others: those are held back where they lie, so that long rows are not shuffled to be dropped by a join."""
    bloom = _filter(ids, key)
    return rows if bloom is None else bloom.probe(rows, "_maybe").filter("_maybe").select(*rows.columns)


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids (different keys, read from files), where ids are few of rows: the others are held back where they lie, so long rows are not shuffled to be dropped."""
    return maybe(rows, ids, key).join(ids.select(key), key).select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null or not in ids (different keys, read from files), where ids are few of rows: most rows stay where they lie."""
    bloom = _filter(ids, key)
    return rows.join(ids.select(key), key, "left_anti").select(*rows.columns) if bloom is None else unseen(rows, ids, [key], bloom=bloom)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): one row (node, component) per linked node, component being the smallest node reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum and a join, until
    every edge joins a node to the minimum of its component. A path of d links takes about log(d) rounds, each of
    which is written to the shared folder, as the plan would otherwise grow from round to round. Joins are by sorting: the
    nodes grow with the links.
    """
    first = stash(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    # rounds are written in as few files as their rows need
    parts = 1 + first.count() // ROWS_A_FILE
    edges = first
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u, and no other, moves to u's minimum
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, move to u's minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("merge"), "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = stash(small.coalesce(parts), "components")
        # done when each node has one edge and it leads to a root
        marks = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
        if marks.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root")).filter("out > 1 OR (out > 0 AND root > 0)").isEmpty():
            break
    done = edges
    roots = done.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return done.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def roots(parents: DataFrame) -> DataFrame:
    """Where each node's chain of parents ends: one row (node, component) per row of parents (node long, up long; up < node, one row per node).

    Every round follows twice as many steps as the one before.
    """
    found = stash(parents.select("node", F.col("up").alias("component")), "roots")
    while True:
        up = found.select(F.col("node").alias("component"), F.col("component").alias("_up")).hint("merge")
        found = stash(found.select("node", "component").join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"), F.col("_up").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("node", "component")


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, component; roots have no row) after links (a, b) between components."""
    over = components(links).filter("node <> component")
    moved = comps.join(over.select(F.col("node").alias("component"), F.col("component").alias("_over")).hint("merge"), "component", "left")
    return stash(moved.select("node", F.coalesce("_over", "component").alias("component")).union(over), "joined")
