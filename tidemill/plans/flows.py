"""Queries that write and read back, run chains of transforms, and run streams to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import sources, streaming
from tidemill.operators import chain, dedup
from tidemill.plans import events
from tidemill.plans.base import Book, scratch, table
from tidemill.sources import sinks
from tidemill.streaming import delivery

book = Book()

_CUSTOMER = "c_custkey long, c_name string, c_mktsegment string"
# names with marks that must be quoted, and nulls
_ODD = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'a \"b\", ' || c_name ELSE c_name END"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ODD).alias("c_name"), "c_mktsegment")


@book.add(f"SELECT c_custkey, {_ODD} AS c_name, c_mktsegment FROM customer")
def csv_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    sinks.csv(_customers(spark, sf_dir), path)
    return spark.read.schema(_CUSTOMER).csv(path, header=True, escape='"', nullValue="")


@book.add(f"SELECT c_mktsegment, {_ODD} AS c_name FROM customer")
def csv_fields_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in a given order, others left out, another delimiter."""
    path = scratch(spark, "csv")
    sinks.csv(_customers(spark, sf_dir), path, ["c_mktsegment", "c_name"], ";")
    return spark.read.schema("c_mktsegment string, c_name string").csv(path, header=True, sep=";", escape='"', nullValue="")


@book.add(f"SELECT c_custkey, {_ODD} AS c_name, c_mktsegment, '2024-01-02' AS _crawl_time, 'shop' AS _spider_name FROM customer")
def json_lines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    sinks.json_lines(_customers(spark, sf_dir), path, "2024-01-02", "shop")
    return spark.read.schema(_CUSTOMER + ", _crawl_time string, _spider_name string").json(path)


@book.add(f"SELECT c_custkey, {_ODD} AS c_name, c_mktsegment FROM customer")
def json_array_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "json")
    sinks.json_array(_customers(spark, sf_dir), path)
    return spark.read.schema(_CUSTOMER).json(path, multiLine=True)


@book.add("SELECT 'run-' || (o_custkey % 5) AS spider, o_orderpriority AS key, count(*) AS value FROM orders GROUP BY ALL")
def run_stats_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "runs")
    named = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("run-"), (F.col("o_custkey") % 5).cast("string")).alias("spider"), F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("value"))
    sinks.run_stats(named, path)
    return sources.runs(spark, path, "key string, value long, spider string").select("spider", "key", "value")


@book.add("SELECT 'k' || o_orderkey AS key, (o_custkey % 9 - 4)::INT AS priority, o_orderkey AS seq FROM orders")
def checkpoint_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "saved")
    requests = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), "o_orderkey").alias("key"), (F.col("o_custkey") % 9 - 4).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))
    sinks.save_checkpoint(path, requests, requests.select(F.md5("key").alias("fp")), requests.groupBy("priority").count())
    return sources.load_checkpoint(spark, path)["requests"]


@book.add("SELECT fp, count(*) AS n FROM (SELECT DISTINCT md5(o_orderpriority) AS fp, o_orderpriority FROM orders) GROUP BY fp")
def fingerprint_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "fingerprints")
    table(spark, sf_dir, "orders").select(F.concat(F.lit("  "), F.md5("o_orderpriority"), F.lit(" ")).alias("value")).distinct().union(spark.sql("SELECT ' ' AS value")).write.text(path)
    return sources.fingerprints(spark, path).groupBy("fp").agg(F.count("*").alias("n"))


_STEPS = """p AS (SELECT page_id, url, html, row_number() OVER (PARTITION BY html ORDER BY page_id) AS rn FROM pages),
    d AS (SELECT page_id, CASE WHEN rn > 1 THEN 'dedup' WHEN contains(url, 'spam') THEN 'spam' WHEN length(html) < 1500 THEN 'short' END AS _discarded_by FROM p)"""


@book.add(f"WITH {_STEPS} SELECT page_id, coalesce(_discarded_by, 'kept') AS ended FROM d")
def item_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by priority, deduplication first; what a step discards skips the rest and says by which."""
    steps = {
        "short": (400, lambda t: (t.filter("length(html) >= 1500"), t.filter("length(html) < 1500"))),
        "spam": (300, lambda t: (t.filter("NOT contains(url, 'spam')"), t.filter("contains(url, 'spam')"))),
        "dedup": (900, lambda t: dedup.split_duplicates(t, ["html"], ["page_id"])),
    }
    kept, gone = chain.Chain.of(steps, dedup="dedup").run(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return kept.select("page_id", F.lit("kept").alias("ended")).union(gone.select("page_id", F.col("_discarded_by").alias("ended")))


@book.add("SELECT page_id, '2' AS there, '12' AS back FROM pages")
def middleware_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes out meets the steps by priority, what comes back meets them the other way round."""
    seen = lambda column, n: lambda t: t.withColumn(column, F.concat(F.col(column), F.lit(n)))
    there = chain.Chain.of([("short", lambda t: t.withColumn("there", F.lit(""))), ("two", seen("there", "2"))])
    back = chain.Chain.of([("two", seen("back", "2")), ("one", seen("back", "1"))]).reversed()
    out, _ = there.run(table(spark, sf_dir, "pages").select("page_id"))
    return back.run(out.withColumn("back", F.lit("")))[0]


@book.add("SELECT CASE WHEN event_type = 'purchase' THEN 'item' WHEN event_type = 'click' THEN 'request' ELSE 'neither' END AS went, count(*) AS n FROM events GROUP BY 1")
def routed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "item").when(F.col("event_type") == "click", "request").otherwise(F.when(F.col("event_type") == "view", "page"))
    parts = chain.route(table(spark, sf_dir, "events").withColumn("kind", kind))
    named = [p.select(F.lit(n).alias("went")) for n, p in zip(("request", "item", "neither"), parts, strict=True)]
    return named[0].union(named[1]).union(named[2]).groupBy("went").agg(F.count("*").alias("n"))


@book.add("SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id * 2 END AS doubled FROM events")
def mapped_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over batches that fails for some rows: they have null and stay."""

    def call(rows: list[dict]) -> list[int]:
        if any(r["event_id"] % 11 == 0 for r in rows):
            raise ValueError("a row that can't be mapped")
        return [r["user_id"] * 2 for r in rows]

    return chain.map_or_null(table(spark, sf_dir, "events").select("event_id", "user_id"), call, "doubled", T.LongType()).select("event_id", "doubled")


@book.add("SELECT CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '[/\\\\<>:\"|?*]', '_', 'g') ELSE 'file.bin' || '' END AS stem, count(*) AS n FROM pages GROUP BY 1")
def blobs_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files with safe names; equal ones are told apart by a number."""
    path = scratch(spark, "blobs")
    pages = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("file.bin").alias("name"), F.encode(F.concat(F.col("page_id").cast("string"), "html"), "utf-8").alias("body"))
    sinks.blobs(pages, "name", "body", path)
    found = spark.read.parquet(path).groupBy("name").agg(F.min("asked").alias("stem"))  # all names differ
    return found.groupBy("stem").agg(F.count("*").alias("n"))


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """A stream's whole output, written as Parquet."""
    path = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files."""
    path = scratch(spark, "events")
    table(spark, sf_dir, "events").write.parquet(path)
    return streaming.read_events(spark, path)


_ENDED = "(SELECT max(ts) - INTERVAL 2 MINUTE FROM events)"


@book.add(f"SELECT start, event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= {_ENDED}")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that the watermark has passed."""
    found = _run(spark, streaming.tumbling(_events(spark, sf_dir), ["event_type"], 3600), "tumbling")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@book.add(
    f"""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) AS start, event_type, value FROM events, (SELECT unnest(range(0, 2)) AS k))
    SELECT start, event_type, n, mean FROM (SELECT start, event_type, count(*) AS n, round(avg(value), 7) AS mean FROM w GROUP BY ALL) WHERE start + INTERVAL 12 HOUR <= {_ENDED}"""
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, streaming.sliding(_events(spark, sf_dir), ["event_type"], "12 hours", "6 hours"), "sliding")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 7).alias("mean"))


@book.add("SELECT DISTINCT user_id FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each key for as long as the keys are remembered, here all the time."""
    return _run(spark, streaming.dedup(_events(spark, sf_dir), ["user_id"], "400 days"), "distinct").select("user_id")


@book.add("SELECT event_type, count(*) AS n, 3 AS attempts, 'ValueError: no' AS error FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that fail as often as they may are dead letters, with the error."""
    path = scratch(spark, "letters")

    def process(batch: DataFrame, number: int) -> None:
        raise ValueError("no")

    stream = _events(spark, sf_dir).filter("event_type = 'error'")
    stream.writeStream.foreachBatch(streaming.with_retries(process, f"{path}/dead", 3)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sources.dead_letters(spark, f"{path}/dead").groupBy("event_type", "attempts", "error").agg(F.count("*").alias("n"))


@book.add(events.ORACLES["first_sightings"])
def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user for half an hour, by a stream of files in order of time; a key's state goes once the watermark is past that time."""
    path = scratch(spark, "sightings")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    low, high = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    parts = 4
    for k in range(parts):  # files are read in the order in which they were written
        share = F.least(F.floor((F.col("ts").cast("double") - low) / (high - low + 1) * parts), F.lit(parts - 1))
        rows.filter(share == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").withWatermark("ts", "1 minute")
        first = stream.groupBy("user_id").transformWithStateInPandas(streaming.FirstSighting(1800, tie="event_id"), "event_id long, ts timestamp, user_id long", "Append", "EventTime")
        query = first.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(first.schema).parquet(f"{path}/out").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@book.add("SELECT event_type, count(*) FILTER (event_id % 100 <> 7) AS taken, count(*) FILTER (event_id % 100 = 7) AS refused, CASE WHEN count(*) FILTER (event_id % 100 = 7) > 0 THEN 'ValueError: no' END AS error FROM events GROUP BY 1")
def stream_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of which one row in a hundred is refused: the others are taken, and only those rows are dead letters."""
    path = scratch(spark, "delivered")

    def open_send() -> delivery.Send:
        def send(rows: list[dict], token: str) -> None:
            if any(r["event_id"] % 100 == 7 for r in rows):
                raise ValueError("no")

        return send

    stream = _events(spark, sf_dir).select("event_id", "event_type")
    stream.writeStream.foreachBatch(delivery.delivery(open_send, f"{path}/rows")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("event_type").agg(F.count(F.when(F.col("_error").isNull(), 1)).alias("taken"), F.count("_error").alias("refused"), F.max("_error").alias("error"))


QUERIES, ORACLES = book.queries, book.oracles
