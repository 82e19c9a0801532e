"""Order of requests, top rows and best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.functions.web import domain
from tidemill.operators.stats import at_ranks


def next_requests(frontier: DataFrame, n: int, priority: str = "priority", seq: str = "seq") -> DataFrame:
    """The n requests that come next: smaller priority, then first in. Each task keeps n rows; nothing is sorted whole."""
    return frontier.orderBy(priority, seq).limit(n)


def two_lanes(frontier: DataFrame, n: int, priority: str = "priority", time: str = "enqueued_at") -> DataFrame:
    """Negative priorities before all others, first in first within a lane."""
    return frontier.orderBy(F.col(priority) >= 0, time).limit(n)


def top(rows: DataFrame, n: int, by: str, ties: list[str]) -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(n)


def best_matches(scored: DataFrame, group: list[str], score: str, least: float = 0.0) -> DataFrame:
    """All rows that share a group's best score, if that is least at least. The best is a grouped maximum, joined back."""
    best = scored.filter(F.col(score) >= least).groupBy(*group).agg(F.max(score).alias("_best"))
    return scored.join(best, group).filter(F.col(score) == F.col("_best")).drop("_best")


def evict_oldest(rows: DataFrame, time: str, capacity: int, share: float = 0.2) -> DataFrame:
    """rows without their oldest share if there are capacity or more; what is as old as the youngest of these goes as well."""
    n = rows.count()
    gone = int(n * share)
    if n < capacity or not gone:
        return rows
    wanted = rows.sparkSession.sql(f"SELECT 0 AS k, 'border' AS name, {gone - 1}L AS rank")
    border = at_ranks(rows.select(F.lit(0).alias("k"), F.col(time).alias("v")), wanted).select(F.col("v").alias("_border"))
    return rows.join(F.broadcast(border), F.col(time) > F.col("_border")).drop("_border")  # one row


def learned_priority(requests: DataFrame, domains: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """requests (url, priority, depth, content_type) with final_priority.

    domains: domain, count, last_time, mean_seconds, errors, last_hour; urls: url, count. What is recent, frequent, seen,
    deep, slow or failing goes down; what is fast or of a good type goes up. The request's own priority counts twice, as the
    queue adds it once more.
    """
    d = requests.withColumn("domain", domain(F.col("url"), "unknown")).join(domains.withColumnRenamed("count", "d_count"), "domain", "left").join(urls.withColumnRenamed("count", "u_count"), "url", "left")
    since = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("last_time").cast("timestamp")) / 1e6
    # fixed values: the thresholds and steps
    score = (
        F.col("priority")
        - F.when(since < 5, 2).when(since < 30, 1).otherwise(0)
        - F.when(F.col("d_count") > 10, 1).otherwise(0)
        - F.when(F.col("u_count") > 1, F.col("u_count")).otherwise(0)
        - F.coalesce("depth", F.lit(0))
        - F.when(F.col("mean_seconds") > 5.0, 1).when(F.col("mean_seconds") < 1.0, -1).otherwise(0)
        - F.when(F.col("errors") > 3, F.least(F.col("errors"), F.lit(5))).otherwise(0)
        + F.when(F.col("content_type").isin("html", "json", "xml"), 1).otherwise(0)
        - F.when(F.col("last_hour") > 100, 1).otherwise(0)
    )
    return d.withColumn("final_priority", (F.col("priority") + score).cast("long")).select(*requests.columns, "final_priority")


def depths(links: DataFrame, starts: DataFrame, most: int | None = None, fold: int = 25) -> DataFrame:
    """url and depth: the fewest links (source, target) from a start, which has depth 0; all pages that are reached, or those within most links.

    One round a level, until a level is empty; a level's new pages only. Each fold levels the pages found become one table, so that plans stay short.
    """
    found = starts.select("url").distinct().withColumn("depth", F.lit(0))
    edge, level = found, 0
    while most is None or level < most:
        level += 1
        new = edge.join(links, edge["url"] == links["source"]).select(F.col("target").alias("url")).distinct()
        edge = new.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)).checkpoint()
        if edge.isEmpty():
            break
        found = found.union(edge)
        if level % fold == 0:
            found = found.checkpoint()
    return found
