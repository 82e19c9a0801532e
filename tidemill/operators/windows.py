"""Row frames over ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ring(value: str, order: WindowSpec, n: int) -> dict[str, Column]:
    """Sum, mean, min, max and count of the last n rows."""
    frame = order.rowsBetween(-(n - 1), W.currentRow)
    return {"sum": F.sum(value).over(frame), "mean": F.avg(value).over(frame), "min": F.min(value).over(frame), "max": F.max(value).over(frame), "count": F.count(value).over(frame)}


def ring_percentile(value: str, order: WindowSpec, n: int, share: float) -> Column:
    """Exact percentile of the last n rows by linear interpolation; 0.0 for none."""
    last = F.sort_array(F.filter(F.collect_list(value).over(order.rowsBetween(-(n - 1), W.currentRow)), lambda x: x.isNotNull()))
    k = (F.size(last) - 1) * share
    low = F.floor(k).cast("int")
    a, b = F.get(last, low), F.get(last, F.least(low + 1, F.size(last) - 1))
    return F.when(F.size(last) > 0, a + (b - a) * (k - low)).otherwise(0.0)


def delta(value: Column, order: WindowSpec) -> Column:
    """Change since the row before; all of it at the first."""
    return value - F.coalesce(F.lag(value).over(order), F.lit(0))


def since_last(time: Column, order: WindowSpec) -> Column:
    """Seconds since the row before; null at the first."""
    return (F.unix_micros(time.cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp"))) / 1e6


def changes(rows: DataFrame, value: str, order: WindowSpec, name: str = "before") -> DataFrame:
    """Rows whose value is not that of the row before, which is put beside it; the first row is a change."""
    marked = rows.withColumn(name, F.lag(value).over(order)).withColumn("_n", F.row_number().over(order))
    return marked.filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col(name))).drop("_n")


def interval_deltas(events: DataFrame, time: str, seconds: int, by: list[str] = ()) -> DataFrame:
    """Counts in tumbling intervals, and their change from interval to interval. Intervals are few, so what the window sorts is small."""
    counted = events.groupBy(*by, F.window(time, f"{seconds} seconds").start.alias("start")).agg(F.count("*").alias("n"))
    order = W.partitionBy(*by).orderBy("start") if by else W.orderBy("start")
    return counted.withColumn("delta", delta(F.col("n"), order))


def sessions(events: DataFrame, key: list[str], time: str, gap: str) -> DataFrame:
    """Runs of a key's events without a gap that long: key, start, end, n. Partial sessions merge before the shuffle."""
    grouped = events.groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
