"""Row frames of keys of any size: ordered ranges with a halo.

A window holds a key's rows in one task. Here rows are dealt out by ranges of key and order, wherever these cut a key, and each
range gets the last rows before it, which is all that a frame of n rows looks back on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def framed(rows: DataFrame, key: list[str], order: list[str], n: int, make: Callable[[WindowSpec], dict[str, Column]], path: str, parts: int | None = None) -> DataFrame:
    """rows with the columns that make gives for a window of each key in order, none of which looks back on more than n - 1 rows (n = 2: lag).

    order must tell a key's rows apart; nulls come first. The ranges are written at path (new, in a shared folder), as their borders must not change while
    they are read twice. parts: how many ranges; unset, the session's shuffle partitions.
    """
    spark = rows.sparkSession
    names = rows.columns
    by = [*key, *order]
    ranged = rows.repartitionByRange(*([parts] if parts else []), *by) if by else rows
    ranged.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.schema(T.StructType([*rows.schema, T.StructField("_part", T.IntegerType())])).parquet(path)

    # the last n - 1 rows of each range, and its first row as a mark; only these few meet by key
    kept = F.struct(*names)
    down, up = (W.partitionBy("_part").orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c in by)) for down in (True, False))
    tails = held.withColumn("_n", F.row_number().over(down)).filter(F.col("_n") < n).select(*by, "_part", kept.alias("_row"))
    marks = held.withColumn("_n", F.row_number().over(up)).filter("_n = 1").select(*by, "_part", F.lit(None).cast(dict(tails.dtypes)["_row"]).alias("_row"))
    # a mark comes before the tails of its own range, and of 2 (n - 1) rows before it half at least are tails
    back = W.partitionBy(*key).orderBy(*(F.asc_nulls_first(c) for c in order), F.col("_row").isNotNull()).rowsBetween(-2 * (n - 1), -1)
    before = tails.union(marks).withColumn("_before", F.collect_list(F.when(F.col("_row").isNotNull(), F.struct("_part", "_row"))).over(back)).filter("_row IS NULL")
    earlier = F.filter("_before", lambda x: x["_part"] < F.col("_part"))
    halo = before.select(F.col("_part").alias("_into"), F.explode(F.slice(earlier, F.greatest(F.size(earlier) - (n - 2), F.lit(1)), n - 1)).alias("_x")).select("_x._row.*", F.col("_into").alias("_part"))

    whole = held.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    window = W.partitionBy("_part", *key).orderBy(*(F.asc_nulls_first(c) for c in order))
    return whole.withColumns(make(window)).filter("_own").drop("_part", "_own")
