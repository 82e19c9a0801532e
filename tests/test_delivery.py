"""Streams delivered once: bad rows alone are dead letters, whatever is repeated."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import delivery


def test_halved():
    """Only rows that are refused by themselves come back, and all others are sent once."""
    taken = []

    def send(rows, token):
        if any(r["v"] % 7 == 0 for r in rows):
            raise ValueError("no")
        taken.extend(r["v"] for r in rows)

    refused = delivery.halved([{"v": i} for i in range(50)], "t", send)
    assert sorted(r["v"] for r, _ in refused) == list(range(0, 50, 7)) and refused[0][1] == "ValueError: no"
    assert sorted(taken) == [i for i in range(50) if i % 7]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (i INTEGER, v TEXT NOT NULL)")
        c.execute("CREATE TABLE u (i INTEGER PRIMARY KEY, v TEXT, w TEXT)")
        c.execute("CREATE TABLE deliveries (token TEXT PRIMARY KEY)")
    return path


def ask(path, sql):
    with sqlite3.connect(path) as c:
        return c.execute(sql).fetchall()


def test_stream_is_delivered_once(spark, tmp_path, database):
    """One row in a hundred is bad; the stream dies after a write, before its commit, and runs again; then dead letters are mended and sent."""
    rows = spark.range(2000).select(F.col("id").alias("i"), F.when(F.col("id") % 100 != 5, F.concat(F.lit("v"), "id")).alias("v"))
    rows.union(rows.filter("i < 300")).repartition(3).write.parquet(str(tmp_path / "in"))  # some rows twice
    connect = lambda: sqlite3.connect(database, timeout=60)
    send = delivery.sql_send(connect, "INSERT INTO t (i, v) VALUES (?, ?)", ["i", "v"])
    deliver = delivery.delivery(send, str(tmp_path / "out"), size=50)

    def start(function):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(function).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    def dies(batch, number):
        deliver(batch, number)
        if number == 1:
            raise RuntimeError("lost between write and commit")

    with pytest.raises(Exception, match="lost between"):
        start(dies)
    start(deliver)
    assert ask(database, "SELECT count(*), count(DISTINCT i) FROM t") == [(2000 - 20 + 300 - 3, 2000 - 20)]
    dead = delivery.letters(spark, str(tmp_path / "out"))
    assert dead.count() == 23 and dead.filter("i % 100 <> 5").count() == 0 and "NOT NULL" in dead.first()["_error"]
    left = delivery.redeliver(spark, str(tmp_path / "out"), str(tmp_path / "again"), send, 1, lambda d: d.withColumn("v", F.when(F.col("i") != 5, F.lit("mended"))))
    assert left.count() == 2 and ask(database, "SELECT count(DISTINCT i) FROM t") == [(1999,)]
    delivery.redeliver(spark, str(tmp_path / "out"), str(tmp_path / "again"), send, 1, lambda d: d.withColumn("v", F.when(F.col("i") != 5, F.lit("mended"))))
    assert ask(database, "SELECT count(*) FROM t WHERE v = 'mended'") == [(21,)]


def test_slices_do_not_depend_on_partitions(spark):
    seen = []
    for parts in (1, 5):
        df = spark.range(500).repartition(parts)
        tokens = df.mapInArrow(lambda b: b, df.schema)  # another plan each time
        out = delivery.delivered(tokens, _naming, "n", 20)
        seen.append(sorted((r["id"], r["_error"]) for r in out.collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 500


def _naming():
    def send(rows, token):
        if len(rows) == 1:
            raise KeyError(token)
        raise ValueError

    return send


def test_upsert_through_a_staging_table(spark, database):
    """A batch goes in whole and once, though its tasks or the batch are repeated."""
    connect = lambda: sqlite3.connect(database, timeout=60)
    with sqlite3.connect(database) as c:
        c.executemany("INSERT INTO u VALUES (?, ?, ?)", [(i, "old", "old") for i in range(5)])
    rows = spark.createDataFrame([(i, f"v{i}", [i]) for i in range(3, 9)] + [(8, "v8", [8])], "i int, v string, w array<int>").repartition(3)
    assert delivery.upsert_staged(rows, connect, "u", ["i"], 1) is True
    assert delivery.upsert_staged(rows.withColumn("v", F.lit("again")), connect, "u", ["i"], 1) is False
    assert ask(database, "SELECT * FROM u ORDER BY i") == [(i, "old", "old") for i in range(3)] + [(i, f"v{i}", f"[{i}]") for i in range(3, 9)]
    bad = rows.withColumn("i", F.when(F.col("i") > 4, F.lit("text")).otherwise(F.col("i").cast("string")))
    with pytest.raises(sqlite3.IntegrityError):
        delivery.upsert_staged(bad.withColumn("v", F.lit("half")), connect, "u", ["i"], 2)
    assert ask(database, "SELECT count(*) FROM u WHERE v = 'half'") == [(0,)]
    assert delivery.upsert_staged(rows.limit(0), connect, "u", ["i"], 3) is True
