from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from tidemill import sources, streaming
from tidemill.operators import chain, dedup, joins, order, stats, validate, writes
from tidemill.sources import sinks

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fingerprints(spark):
    get = lambda u, **k: spark.range(1).select(dedup.request_fingerprint(F.lit("GET"), F.lit(u), **k)).first()[0]
    h = lambda v: F.create_map(F.lit("User-Agent"), F.lit(v))
    assert get("http://h/?a=1&b=2") == get("http://H/?b=2&a=1#x") and get("http://h/?a=1") != get("http://h/?a=2")
    assert get("http://h", headers=h("x")) == get("http://h", headers=h("y")) and get("http://h", headers=h("x"), include=["user-agent"]) != get("http://h", headers=h("y"), include=["user-agent"])
    assert get("http://h", body=F.lit("x")) != get("http://h")
    item = spark.createDataFrame([("b", None, 1)], "b string, a string, c int").select(dedup.item_fingerprint({c: F.col(c) for c in "bac"}, "v1")).first()[0]
    import hashlib

    assert item == "v1:" + hashlib.sha256(b"b=b|c=1").hexdigest()


def test_dedup(spark):
    data = spark.createDataFrame([("x", 2), ("x", 1), (None, 3), (None, 4), ("y", 5)], "k string, i int")
    assert rows(dedup.keep_first(data, ["k"], ["i"]).select("i")) == [(1,), (3,), (5,)]
    assert rows(dedup.keep_first(data, ["k"], ["i"], last=True).select("i")) == [(2,), (4,), (5,)]
    first, again = dedup.split_duplicates(data, ["k"], ["i"])
    assert rows(first.select("i")) == [(1,), (3,), (5,)] and rows(again.select("i")) == [(2,), (4,)]
    seen = spark.createDataFrame([("x",)], "k string")
    assert rows(dedup.unseen(data, seen, ["k"]).select("i")) == [(3,), (4,), (5,)]
    assert rows(dedup.remember(seen, spark.createDataFrame([("x",), ("z",)], "k string"), ["k"])) == [("x",), ("z",)]
    times = spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in (0, 200, 299, 301, 500, 700)] + [("b", T0)], "k string, ts timestamp_ntz")
    kept = [(k, int((t - T0).total_seconds())) for k, t in rows(dedup.once_in(times, ["k"], "ts", 300))]
    assert kept == [("a", 0), ("a", 301), ("a", 700), ("b", 0)]
    assert dedup.filter_stats(data, F.col("k")).first().asDict() == {"total": 5, "unique": 3, "duplicates": 2, "duplicate_rate": "40.00%"}
    assert dedup.filter_stats(data.limit(0), F.col("k")).first()["duplicate_rate"] == "0.00%"


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, ""), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "", "w"), (2, "d", "w")], "k int, v string, other string")
    assert sorted(((r["k"] or 0), r["exists"]) for r in joins.with_exists(a, b, ["k"]).collect()) == [(0, False), (1, True), (2, True)]
    assert sorted((r["k"] or 0, r["v"]) for r in joins.enrich(a, b, ["k"], ["v"]).collect()) == [(0, "z"), (1, "x"), (2, "d")]


def test_writes(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "x", 9, 1), (2, "y", 8, 2), (3, "z", 7, 1), (3, "w", 6, 2)], "k int, v string, n int, seq int")
    assert rows(writes.replace(target, new, ["k"], ["seq"])) == [(1, "a", 1), (2, "y", 8), (3, "w", 6)]
    assert rows(writes.insert_ignore(target, new, ["k"], ["seq"])) == [(1, "a", 1), (2, "b", 2), (3, "z", 7)]
    assert rows(writes.upsert(target, new, ["k"], ["n"], ["seq"])) == [(1, "a", 1), (2, "b", 8), (3, "z", 6)]
    assert rows(writes.update(target, {"v": "q"}, {"k": 1})) == [(1, "q", 1), (2, "b", 2)] and rows(writes.delete(target, {"k": 1})) == [(2, "b", 2)]
    with pytest.raises(ValueError, match="conditions"):
        writes.delete(target, {})
    assert writes.write_mode(["n"], True, True) == "upsert" and writes.write_mode(auto_update=True, insert_ignore=True) == "replace"
    assert writes.batch(target.select("k"), target.select("v"), missing="").columns == ["k", "v"]
    assert rows(target.filter(writes.lookup({"n__odd": 2}))) == [(2, "b", 2)]
    assert [writes.error_action(c) for c in (1062, 2006, 1)] == ["skip", "retry", "fatal"]


def test_validation(spark):
    data = spark.createDataFrame([("a", " ", "5"), (None, "longer", "x")], "n string, d string, i string")
    good, bad = validate.quarantine(data, {"n": validate.Field(nullable=False), "d": validate.Field(default="none", max_length=5), "i": validate.Field(kind="int")})
    assert rows(good) == [("a", "none", "5")]
    assert bad.first()["_errors"] == ["n: empty", "d: too long", "i: no int"]


def test_chain_and_route(spark):
    data = spark.createDataFrame([(1, "item"), (1, "item"), (2, "request"), (3, None)], "i int, kind string")
    requests, items, other = chain.route(data)
    assert [x.count() for x in (requests, items, other)] == [1, 2, 1]
    seen = []
    step = lambda n: lambda df: (seen.append(n), df)[1]
    small = lambda df: (df.filter("i < 3"), df.filter("i >= 3"))
    out, gone = chain.Chain.of({"b": (300, step("b")), "a": (200, small), "dedup": (900, step("dedup"))}, dedup="dedup").run(data)
    assert seen == ["dedup", "b"] and out.count() == 3 and gone.first()["_discarded_by"] == "a"
    with pytest.raises(ValueError, match="nothing"):
        chain.Chain.of([("x", lambda df: None)]).run(data)
    registry = chain.Registry()
    registry.register("pipeline", "x", step("x"))
    assert registry.names("pipeline") == ["x"]
    with pytest.raises(ValueError, match="already"):
        registry.register("pipeline", "x", step("x"))


def test_order(spark):
    q = spark.createDataFrame([("a", 0, 1), ("b", -5, 2), ("c", 0, 0), ("d", 7, 3)], "u string, priority int, seq int")
    assert [r["u"] for r in order.next_requests(q, 3).collect()] == ["b", "c", "a"]
    assert [r["u"] for r in order.two_lanes(q.withColumn("enqueued_at", F.col("seq")), 4).collect()] == ["b", "c", "a", "d"]
    assert order.evict_oldest(q, "seq", 4, 0.5).count() == 2 and order.evict_oldest(q, "seq", 9).count() == 4
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "source string, target string")
    assert rows(order.depths(links, spark.sql("SELECT 'a' AS url"))) == [("a", 0), ("b", 1), ("c", 1)]


def test_depths_of_a_long_chain(spark):
    """Pages further than 50 links away are found; a limit is only one that is asked for."""
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(53)] + [("53", "0")], "source string, target string").coalesce(1).cache()
    start = spark.sql("SELECT '0' AS url")
    assert rows(order.depths(links, start)) == sorted((str(i), i) for i in range(54))
    assert order.depths(links, start, most=2).count() == 3


def test_sources_and_sinks(spark, tmp_path):
    start = sources.start_requests(spark, ["http://a", "http://b"], 100)
    assert rows(start.select("seq", "priority")) == [(0, -100), (1, -100)]
    q = spark.createDataFrame([("k1", 1, T0, False), ("k2", 0, T0, False), ("k3", 0, T0, True)], "key string, priority int, enqueued_at timestamp_ntz, processed boolean")
    taken, left = sources.queue(q, 1)
    assert taken.first()["key"] == "k2" and left.filter("NOT processed").count() == 1
    data = spark.createDataFrame([(1, None, [1, 2]), (2, "a,b", [])], "i int, t string, n array<int>")
    sinks.csv(data, str(tmp_path / "csv"), ["i", "t", "n"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert sorted((r["i"], r["t"], r["n"]) for r in back.collect() if r["t"]) == [("2", "a,b", "[]")] and back.count() == 2
    sinks.json_lines(data, str(tmp_path / "jsonl"), spider="s")
    assert {r["_spider_name"] for r in spark.read.json(str(tmp_path / "jsonl")).collect()} == {"s"}
    sinks.json_array(data.coalesce(1), str(tmp_path / "array"))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "array")).count() == 2
    docs = sinks.documents(data.select("i", "t").union(data.select("i", "t")))
    assert docs.count() == 2 and len(docs.first()["_id"]) == 32
    assert ("cf:t", "") in {(r["column"], r["value"]) for r in sinks.cells(data.select("i", "t")).collect()}
    lines = {r["line"] for r in sinks.exposition(spark.createDataFrame([("a/b", 1, "counter"), ("a-b", 2, "counter")], "key string, value int, kind string")).collect()}
    assert lines == {"# TYPE app_a_b counter", "app_a_b 3"}
    sinks.save_checkpoint(str(tmp_path / "ck"), q.withColumn("seq", F.lit(1)), spark.sql("SELECT 'f' AS fp"), spark.sql("SELECT 'k' AS key, 1 AS value"))
    assert [r["key"] for r in sources.load_checkpoint(spark, str(tmp_path / "ck"))["requests"].collect()][:1] != ["k1"]
    sinks.blobs(spark.createDataFrame([("a.txt", bytearray(b"1")), ("a.txt", bytearray(b"2"))], "n string, b binary"), "n", "b", str(tmp_path / "blobs"))
    assert {r["name"] for r in spark.read.parquet(str(tmp_path / "blobs")).collect()} == {"a.txt", "a_1.txt"}
    assert sinks.statement("postgresql", "t", ["a", "b"], ["a"], mode="upsert") == 'INSERT INTO "t" ("a", "b") VALUES (%s, %s) ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'
    assert sinks.statement("sqlite", "t", ["a"], mode="ignore") == 'INSERT OR IGNORE INTO "t" ("a") VALUES (?)'


def test_sql_sink(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (i INTEGER PRIMARY KEY, v TEXT)")
    data = spark.createDataFrame([(i % 5, str(i)) for i in range(10)], "i int, v string").coalesce(1)
    insert = sinks.statement("sqlite", "t", ["i", "v"], mode="insert")
    seen = str(tmp_path / "seen")

    def count(held):
        with open(seen, "a") as f:
            f.write("x" * len(held))

    dead = sinks.rows_to(data, lambda: sqlite3.connect(path), insert, str(tmp_path / "dead"), batch=4, before=lambda held: [r | {"v": "v" + r["v"]} for r in held], after=count)
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*), count(DISTINCT i), min(v) FROM t").fetchone() == (5, 5, "v0")
    assert sorted((r["i"], r["v"], r["_action"]) for r in dead.collect()) == [(i, f"v{i + 5}", "skip") for i in range(5)] and "UNIQUE" in dead.first()["_error"]
    assert len(open(seen).read()) == 5
    with pytest.raises(Exception, match="2 batches in a row"):
        sinks.rows_to(data, lambda: sqlite3.connect(path), "INSERT INTO nothing VALUES (?, ?)", str(tmp_path / "dead2"), batch=2, give_up=2)


class Flaky:
    """A connection whose first writes fail with an error that passes, and which refuses a value for good."""

    def __init__(self):
        self.calls, self.kept = 0, []

    def cursor(self):
        return self

    def executemany(self, sql, values):
        self.calls += 1
        if self.calls < 3:
            raise OSError(2006, "gone away")
        if any(v == ("bad",) for v in values):
            raise OSError(1, "refused")
        self.kept += values

    def execute(self, sql, value):
        if value == ("bad",):
            raise OSError(1062, "twice")
        self.kept.append(value)

    def commit(self):
        pass

    rollback = close = commit


def test_retries_of_a_sink():
    c = Flaky()
    assert sinks._send(c, "", ["v"], [{"v": "a"}, {"v": "b"}], 3, 0.0) == ([{"v": "a"}, {"v": "b"}], []) and c.calls == 3
    sent, failed = sinks._send(c, "", ["v"], [{"v": "c"}, {"v": "bad"}], 3, 0.0)
    assert sent == [{"v": "c"}] and failed[0]["_action"] == "skip" and c.calls == 4 and c.kept == [("a",), ("b",), ("c",)]


def test_map_or_null(spark):
    def call(held):
        return [10 // r["i"] for r in held]

    out = chain.map_or_null(spark.createDataFrame([(i,) for i in (1, 2, 0, 5)], "i int"), call, "x", T.LongType(), batch=2)
    assert sorted((r["i"], r["x"]) for r in out.collect()) == [(0, None), (1, 10), (2, 5), (5, 2)]


def test_once_in_null_keys_and_ties(spark):
    data = [(None, T0, 1), (None, T0 + timedelta(seconds=1), 2), (1, T0, 4), (1, T0, 3), (1, T0 + timedelta(seconds=300), 5), (None, None, 6), (None, T0 + timedelta(seconds=301), 7)]
    out = dedup.once_in(spark.createDataFrame(data, "k long, ts timestamp_ntz, i int"), ["k"], "ts", 300, ["i"])
    assert sorted(r["i"] for r in out.collect()) == [1, 3, 5, 6, 7]
    assert dedup.once_in(out.limit(0), ["k"], "ts", 300).count() == 0


def test_exact_percentiles(spark):
    import random

    rng = random.Random(1)
    data = [("big", float(rng.choice([1, 1, 1, rng.random() * 100]))) for _ in range(2000)] + [(None, 5.0), (None, 7.0), ("none", None), ("one", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = (0.0, 0.25, 0.5, 0.99, 1.0)
    want = {r["k"]: r["p"] for r in df.groupBy("k").agg(stats.percentiles("v", *shares).alias("p")).collect()}
    assert {r["k"]: pytest.approx(r["p"]) for r in stats.exact_percentiles(df, ["k"], "v", *shares).collect()} == want
    assert want[None][2] == 6.0 and want["none"] == [0.0] * 5
    assert stats.exact_percentiles(df.limit(0), ["k"], "v", 0.5).count() == 0
    assert [r["v"] for r in stats.series(df.filter("k IS NULL"), "k", "v", ["v"]).collect()] == [5.0, 7.0]
    assert stats.count_where(df, {"k": "one", "v": 3.0}).first()["count"] == 1


def test_dead_letters(spark, tmp_path):
    path = str(tmp_path / "dead")

    def broken(batch, i):
        raise ConnectionError("no")

    streaming.with_retries(broken, path, 2)(spark.createDataFrame([("k", T0)], "key string, failed_at timestamp_ntz"), 7)
    letters = sources.dead_letters(spark, path)
    assert letters.first()["error"] == "ConnectionError: no" and letters.first()["attempts"] == 2
    front = spark.createDataFrame([], "key string, processed boolean")
    back, left = sources.retry_dead(letters, front, 1)
    assert rows(back) == [("k", False)] and left.count() == 0


def _stream(spark, tmp_path, data):
    data.write.parquet(str(tmp_path / "in"))
    return streaming.read_events(spark, str(tmp_path / "in"))


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(i, T0 + timedelta(seconds=20 * i), i % 2, 1.0) for i in range(12)], "event_id long, ts timestamp_ntz, user_id long, value double")
    events = _stream(spark, tmp_path, data)
    _run(streaming.tumbling(events, ["user_id"], 60), "tumbling", "complete")
    assert rows(spark.table("tumbling").groupBy().agg(F.sum("n"), F.count("*"))) == [(12, 8)]
    _run(streaming.sessions(events, "user_id", "1 minute"), "sessions", "complete")
    assert rows(spark.table("sessions").select("user_id", "n")) == [(0, 6), (1, 6)]
    _run(streaming.dedup(events, ["user_id"], "10 minutes"), "dedup")
    assert spark.table("dedup").count() == 2
    _run(streaming.rate_limit(events, "user_id", 0.01, 2.0), "limited")
    live = rows(spark.table("limited").select("event_id", "allowed"))
    assert live == rows(streaming.rate_limit_batch(data, "user_id", 0.01, 2.0).select("event_id", "allowed")) and sum(a for _, a in live) == 8


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _stateful(spark, tmp_path, data, processor, schema, name, mode, time_mode):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = _stream(spark, tmp_path, data).withWatermark("ts", "0 seconds")
        _run(events.groupBy("user_id").transformWithStateInPandas(processor, schema, mode, time_mode), name, mode)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_first_sighting_stream(spark, tmp_path):
    data = spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1) for i, s in enumerate((0, 200, 299, 301, 700))], "event_id long, ts timestamp_ntz, user_id long").coalesce(1)
    _stateful(spark, tmp_path, data, streaming.FirstSighting(300), "event_id long, ts timestamp, user_id long", "sightings", "Append", "EventTime")
    assert rows(spark.table("sightings").select("event_id")) == [(0,), (3,), (4,)]


def test_failover_stream(spark, tmp_path):
    data = spark.createDataFrame([(0, T0, 1), (1, T0 + timedelta(seconds=10), 2), (2, T0 + timedelta(seconds=500), 2)], "event_id long, ts timestamp_ntz, user_id long").coalesce(1)
    _stateful(spark, tmp_path, data, streaming.Failover(90, 60), "worker long, state string, at_ms long", "failover", "Update", "EventTime")
    assert {("alive", 1), ("alive", 2)} <= {(r["state"], r["worker"]) for r in spark.table("failover").collect()}


def test_overflow(spark):
    queue = spark.createDataFrame([(i % 3, i) for i in range(6)], "priority int, seq int")
    kept, dropped = streaming.overflow(queue, 4)
    assert rows(kept) == [(0, 0), (0, 3), (1, 1), (1, 4)] and dropped == 2 and streaming.overflow(queue, 6)[1] == 0
    with pytest.raises(OverflowError, match="6 rows"):
        streaming.overflow(queue, 4, "raise")


def test_csv_for_other_readers(spark, tmp_path):
    """Quotes are doubled, white space stays: Python's csv reads back what was written."""
    import csv
    import glob

    data = [("1", 'a "b", c'), ("2", "back\\slash"), ("3", ' "lead'), ("4", "line\nbreak"), ("5", '""'), ("6", "plain"), ("7", " padded ")]
    sinks.csv(spark.createDataFrame(data, "i string, t string").coalesce(1), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv" / "part-*"))[0], newline="") as f:
        assert list(csv.reader(f)) == [["i", "t"], *map(list, data)]


def test_blob_names(spark, tmp_path):
    """Names differ whatever numbers they have already; equal values of one name are one file."""
    rows = [("file.bin", b"a"), ("file.bin", b"b"), ("file_1.bin", b"c"), ("file_1.bin", b"d"), ("file_1_1.bin", b"e"), ("none", b"f"), ("none", b"f"), (None, b"g"), ("none", None)]
    rows += [("hot.txt", str(i).encode()) for i in range(600)]
    sinks.blobs(spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "n string, b binary"), "n", "b", str(tmp_path / "blobs"))
    found = [(r["name"], r["body"]) for r in spark.read.parquet(str(tmp_path / "blobs")).collect()]
    assert len(found) == len(rows) - 1 == len({n for n, _ in found}) and {b if b is None else bytes(b) for _, b in found} == {b for _, b in rows}
    assert {n for n, _ in found} >= {"hot.txt", "hot_1.txt", "hot_599.txt", "file.bin", "file_1.bin", "file_1_1.bin"}


def test_sink_connects_again():
    """A connection that has gone away is opened anew, in a batch and row by row."""
    opened, kept = [], []

    class Gone:
        def __init__(self):
            opened.append(self)
            self.left = 2

        def cursor(self):
            return self

        def execute(self, sql, value):
            self.left -= 1
            if self.left < 0:
                raise OSError(2006, "gone away")
            if value == ("bad",):
                raise OSError(1062, "twice")
            kept.append(value)

        def executemany(self, sql, values):
            if len(opened) < 2:
                raise OSError(2013, "lost")
            raise OSError(1, "refused")

        def commit(self):
            pass

        def rollback(self):
            if self.left < 0:
                raise OSError(2006, "gone away")

        def close(self):
            raise OSError("closed already")

    sent, failed = sinks._send(sinks.Link(Gone), "", ["v"], [{"v": x} for x in ("a", "bad", "b", "c", "d")], 3, 0.0)
    assert [r["v"] for r in sent] == ["a", "b", "c", "d"] and [(r["v"], r["_action"]) for r in failed] == [("bad", "skip")]
    assert kept == [("a",), ("b",), ("c",), ("d",)] and len(opened) > 2


def test_observed_metrics(spark, tmp_path):
    """Counts and aggregates of a write, without a pass of their own."""
    rows, seen = sinks.observed(spark.range(10), "w", largest=F.max("id"), nothing=F.max(F.lit(None).cast("int")))
    rows.write.parquet(str(tmp_path / "o"))
    lines = {r["line"] for r in sinks.exposition(sinks.observed_stats(spark, seen)).collect()}
    assert lines == {"# TYPE app_rows counter", "app_rows 10.0", "# TYPE app_largest gauge", "app_largest 9.0"}


def test_blobs_keep_the_name_asked_for(spark, tmp_path):
    """Files whose names were told apart by a number still say which name they were given for."""
    rows = [("a?b.org/x", b"1"), ("a?b.org/x", b"2"), ("file_1.bin", b"3"), ("file.bin", b"4"), ("file.bin", b"5")]
    sinks.blobs(spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "n string, b binary"), "n", "b", str(tmp_path / "asked"))
    found = spark.read.parquet(str(tmp_path / "asked")).collect()
    assert len({r["name"] for r in found}) == 5 and sorted(r["asked"] for r in found) == ["a_b.org_x", "a_b.org_x", "file.bin", "file.bin", "file_1.bin"]


def test_first_sighting_ties(spark, tmp_path):
    """Of events of one time that of the smallest tie passes, in whatever order they come."""
    data = spark.createDataFrame([(40 - i, T0 + timedelta(seconds=400 * (i // 20)), 1) for i in range(40)], "event_id long, ts timestamp_ntz, user_id long").coalesce(1)
    _stateful(spark, tmp_path, data, streaming.FirstSighting(300, tie="event_id"), "event_id long, ts timestamp, user_id long", "ties", "Append", "EventTime")
    assert rows(spark.table("ties").select("event_id")) == [(1,), (21,)]
