"""Operators for keys of any size, against their plain versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import plans
from tidemill.operators import bloom, frames, joins, windows

T0 = datetime(2024, 1, 1)


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_frames_are_those_of_a_window(spark, tmp_path, parts):
    """One key of nearly all rows, keys of a few, null keys and null times; ranges smaller than a frame."""
    rng = random.Random(parts)
    rows = [("hot", T0 + timedelta(seconds=rng.randrange(500)), i, rng.random() if i % 9 else None) for i in range(300)]
    rows += [(rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randrange(50)), 1000 + i, float(i)) for i in range(60)] + [("hot", None, 2000 + i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, v double")

    def make(w):
        return {f"r_{n}": F.round(c, 9) for n, c in windows.ring("v", w, 5).items()} | {"p": F.round(windows.ring_percentile("v", w, 5, 0.9), 9), "before": F.lag("i").over(w), "first": F.first("i").over(w.rowsBetween(-4, 0))}

    want = df.withColumns(make(W.partitionBy("k").orderBy(F.asc_nulls_first("ts"), "i")))
    got = frames.framed(df, ["k"], ["ts", "i"], 5, make, str(tmp_path / f"f{parts}"), parts)
    assert got.columns == want.columns and bag(got) == bag(want)
    lag = frames.framed(df, ["k"], ["ts", "i"], 2, lambda w: {"d": windows.delta(F.col("v"), w)}, str(tmp_path / f"g{parts}"), parts)
    assert bag(lag) == bag(df.withColumn("d", windows.delta(F.col("v"), W.partitionBy("k").orderBy(F.asc_nulls_first("ts"), "i"))))
    assert frames.framed(df.limit(0), ["k"], ["ts", "i"], 5, make, str(tmp_path / f"e{parts}"), parts).count() == 0


def test_hot_frames_are_spread(spark, tmp_path):
    """No range has much more than its share of one key's rows."""
    df = spark.range(8000).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    got = frames.framed(df, ["k"], ["i"], 10, lambda w: {"n": F.count("i").over(w.rowsBetween(-9, 0))}, str(tmp_path / "f"), 8)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "f")).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000
    assert got.filter("n < 10").count() == 9


def test_bloom(spark):
    """Nothing seen is missed, few others pass, merged filters hold both's keys, and the join is that without a filter."""
    seen = spark.range(0, 60_000, 3).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), "id")).alias("name"))
    rows = spark.range(90_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), "id")).alias("name"))
    f = bloom.Bloom.of(seen, ["id"], 20_000)
    assert f.n == bloom.sizes(21_000, 0.001)[0] > 5
    probed = f.probe(rows).groupBy((F.col("id") < 60_000) & (F.col("id") % 3 == 0), "maybe").count().collect()
    counts = {(r[0], r["maybe"]): r["count"] for r in probed}
    assert counts[True, True] == 20_000 and (True, False) not in counts
    assert counts.get((False, True), 0) <= 0.001 * 70_000
    low, high = (bloom.Bloom.of(seen.filter(c), ["id"], 20_000) for c in ("id < 30000", "id >= 30000"))
    assert bag(low.merge(high).probe(rows)) == bag(f.probe(rows))
    with pytest.raises(ValueError):
        low.merge(bloom.Bloom.of(seen, ["id"], 100_000))
    for key in (["id"], ["name"], ["id", "name"]):
        assert bag(bloom.unseen(rows, seen, key)) == bag(joins.missing(rows, seen, key).select("id", "name"))
    assert bloom.unseen(rows, seen.limit(0), ["id"]).count() == 90_000 and bloom.unseen(rows.limit(0), seen, ["id"]).count() == 0


def test_pages_go_to_python_in_small_batches(spark, sf_dir):
    """Queries that send whole pages to Python bound the rows of a batch, so that a worker's memory does not grow with the table."""
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name in ("encodings", "encodings_marked", "element_relocation", "healed_selectors"):
            spark.conf.set(key, "10000")
            plans.QUERIES[name](spark, sf_dir)
            assert int(spark.conf.get(key)) <= 500
            spark.conf.set(key, "7")
            plans.QUERIES[name](spark, sf_dir)
            assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
