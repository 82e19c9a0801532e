"""Queries over what requests, workers and queues are made of, with events, orders and pages standing in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import sources
from tidemill.functions import dates, pressure, records, text, web
from tidemill.operators import dedup, stats
from tidemill.plans.base import Book, table
from tidemill.sources import sinks

book = Book()

book.on(
    "events", "queue_totals",
    lambda t: stats.queue_stats(t.select("ts", F.when(F.col("event_type") == "click", "dequeue").otherwise("enqueue").alias("kind"), F.col("value").cast("decimal(18,2)").alias("wait_s"), (F.col("event_id") % 97).alias("size"))).select("dequeued", F.round("throughput", 9).alias("throughput"), F.round(F.col("avg_wait").cast("double"), 6).alias("avg_wait"), "max_size"),
    """SELECT count(*) FILTER (event_type = 'click') AS dequeued, round(count(*) FILTER (event_type = 'click') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS throughput,
      round(avg(value::DECIMAL(18, 2)) FILTER (event_type = 'click'), 6) AS avg_wait, max(event_id % 97) AS max_size FROM events""",
)
book.on(
    "events", "cluster_progress",
    lambda t: stats.cluster_progress(t.select("ts", F.col("user_id").alias("completed"), (F.col("event_id") % 3).alias("failed"), (F.col("event_id") % 5).alias("items"))).withColumn("items_per_sec", F.round("items_per_sec", 9)),
    "SELECT sum(user_id)::BIGINT AS total_completed, sum(event_id % 3)::BIGINT AS total_failed, sum(event_id % 5)::BIGINT AS total_items, round(sum(event_id % 5) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS items_per_sec FROM events",
)
book.on(
    "events", "cluster_diagnosis",
    lambda t: t.select("event_id", F.array_join(stats.diagnose(F.col("event_id") % 3, F.col("event_id") % 4, F.col("event_id") % 2000, F.col("event_id") % 7, F.col("event_id") % 5, F.col("user_id")), "; ").alias("issues")),
    """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 3 > 0 AND event_id % 4 > 0 THEN (event_id % 3) || ' idle workers with ' || (event_id % 4) || ' pending tasks' END,
      CASE WHEN event_id % 2000 > 1000 THEN 'high pending count ' || (event_id % 2000) END, CASE WHEN event_id % 7 > 0 THEN (event_id % 7) || ' dead letters' END,
      CASE WHEN event_id % 5 = 0 AND user_id > 60 THEN 'no progress for 60 s' END) AS issues FROM events""",
)
book.on("events", "worker_states", lambda t: stats.cluster_status(t.select(F.col("event_type").alias("status"))), "SELECT event_type AS status, count(*) AS workers FROM events GROUP BY 1")
book.on(
    "events", "generation_rate",
    lambda t: stats.generation(t.select((F.col("event_id") % 10).alias("generated"), F.col("value").cast("decimal(18,2)").alias("seconds"))).select("generated", F.round(F.col("rate").cast("double"), 6).alias("rate")),
    "SELECT sum(event_id % 10)::BIGINT AS generated, round(sum(event_id % 10) / sum(value::DECIMAL(18, 2))::DOUBLE, 6) AS rate FROM events",
)
book.on(
    "events", "duplicate_rates",
    lambda t: stats.duplicate_rate(t.select("user_id", "event_id", F.col("event_id").cast("double").alias("t"), (F.col("event_id") * 3).alias("counter")), W.partitionBy("user_id").orderBy("event_id")).select("event_id", F.round("rps", 6).alias("rps")),
    """SELECT event_id, round(CASE WHEN event_id > first(event_id) OVER w THEN (event_id * 3 - first(event_id * 3) OVER w) / least(60.0, event_id - first(event_id) OVER w) ELSE 0 END, 6) AS rps
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 64 PRECEDING AND CURRENT ROW)""",
)


@book.add(
    """WITH d AS (SELECT date_trunc('day', ts) AS i, avg(value::DECIMAL(18, 2))::DOUBLE AS rss FROM events GROUP BY 1),
    w AS (SELECT i, avg(rss) OVER w AS mean, (max(rss) OVER w - min(rss) OVER w) / avg(rss) OVER w * 100 AS spread, count(*) OVER w AS n FROM d WINDOW w AS (ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT round(arg_min(mean, i) FILTER (n = 5 AND mean > 0 AND spread < 15), 6) AS baseline FROM w"""
)
def stable_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stable level of daily means; days are few, so the window without a key is small."""
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("i")).agg(F.avg(F.col("value").cast("decimal(18,2)")).cast("double").alias("rss"))
    return stats.stable_baseline(days, W.orderBy("i"), 15.0).select(F.round("baseline", 6).alias("baseline"))


book.on(
    "events", "task_verdicts",
    lambda t: t.select("event_id", web.task_verdict(F.when(F.col("event_id") % 9 == 0, "TimeoutError").otherwise("X"), F.concat(F.lit("HTTP "), (F.col("event_id") % 600).cast("string"), F.when(F.col("event_id") % 8 == 0, " Connection reset").otherwise(""))).alias("verdict"), web.depth_priority(F.col("event_id") % 10, F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3), 2).alias("priority")),
    """SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 8 = 0 THEN 'retry' WHEN event_id % 600 IN (404, 500) THEN 'ack' ELSE 'retry' END AS verdict,
      event_id % 10 - CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 1 END * 2 AS priority FROM events""",
)
book.on(
    "events", "error_categories",
    lambda t: t.select("event_id", text.error_category(F.element_at(F.array(*(F.lit(x) for x in ("MemoryError", "TimeoutError", "PermissionError", "KeyError", "Odd"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("category")),
    "SELECT event_id, ['critical', 'network', 'network', 'data', 'unknown'][event_id % 5 + 1] AS category FROM events",
)
book.on(
    "events", "concurrency",
    lambda t: t.select("event_id", pressure.concurrency(F.col("value") / 50, F.col("event_id") % 40, 12).alias("tasks"), pressure.composite_delay(pressure.fixed_delay(F.col("value") / 100), F.lit(0.2)).alias("delay")).withColumn("delay", F.round("delay", 6)),
    """SELECT event_id, CASE WHEN value / 50 < 0.2 THEN least(event_id % 40 + 5, 36) WHEN value / 50 > 1 THEN greatest(event_id % 40 - 5, 4) ELSE event_id % 40 END AS tasks,
      round(greatest(0.2, CASE WHEN value / 100 >= 0.95 THEN 5.0 WHEN value / 100 >= 0.90 THEN 0.4 WHEN value / 100 >= 0.8 THEN 0.1 * (1 + (value / 100 - 0.8) / (0.95 - 0.8) * 3) ELSE 0.0 END), 6) AS delay FROM events""",
)
book.on(
    "events", "adaptive_delays",
    lambda t: t.select("event_id", F.round(pressure.adaptive_delay(pressure.fixed_delay(F.col("value") / 100), F.col("value") / 40, W.partitionBy("user_id").orderBy("ts", "event_id")), 6).alias("delay")),
    """WITH d AS (SELECT event_id, CASE WHEN value / 100 >= 0.95 THEN 5.0 WHEN value / 100 >= 0.90 THEN 0.4 WHEN value / 100 >= 0.8 THEN 0.1 * (1 + (value / 100 - 0.8) / (0.95 - 0.8) * 3) ELSE 0.0 END AS base,
        avg(value / 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent FROM events)
      SELECT event_id, round(CASE WHEN recent > base AND base > 0 THEN least(base * least(recent / base, 2.0), 5.0) ELSE base END, 6) AS delay FROM d""",
)
book.on(
    "pages", "query_maps",
    lambda t: t.select("page_id", text.form_to_map(F.regexp_extract("url", r"\?([^#]*)", 1)).alias("m")).select("page_id", F.col("m")["page"].alias("page"), F.col("m")["ref"].alias("ref"), F.size("m").alias("n")),
    r"""WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)
      SELECT page_id, nullif(regexp_extract(q, '(?:^|&)page=([^&]*)', 1), '') AS page, nullif(regexp_extract(q, '(?:^|&)ref=([^&]*)', 1), '') AS ref, len(regexp_extract_all(q, '='))::INT AS n FROM q""",
)
book.on(
    "pages", "attachment_names",
    lambda t: t.select("page_id", text.attachment_name(F.col("url"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('attachment; filename="f'), F.col("page_id").cast("string"), F.lit('.pdf"'))), F.lit("image/png; q=1")).alias("name"), text.content_type_allowed(F.lit(".png"), F.when(F.col("page_id") % 2 == 0, "image/png").otherwise("text/html")).alias("allowed")),
    r"""WITH p AS (SELECT page_id, url, regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), '([^/]*)$', 1) AS last FROM pages)
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'f' || page_id || '.pdf' WHEN contains(last, '.') THEN last ELSE 'attachment_' || left(md5(url), 8) || '.png' END AS name, page_id % 2 = 0 AS allowed FROM p""",
)
book.on(
    "pages", "ajax_urls",
    lambda t: t.select("page_id", web.escape_ajax(F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#!k=v"))).alias("url")),
    r"SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN '&' ELSE '?' END || '_escaped_fragment_=k%3Dv' AS url FROM pages",
)
book.on(
    "orders", "cron_runs",
    lambda t: t.select("o_orderkey", dates.cron_next(F.lit("30 6 * * *"), F.col("o_orderdate")).alias("daily"), dates.cron_next(F.lit("0 0 1 * *"), F.col("o_orderdate")).alias("monthly")),
    "SELECT o_orderkey, CASE WHEN o_orderdate < date_trunc('day', o_orderdate) + INTERVAL '6 hours 30 minutes' THEN date_trunc('day', o_orderdate) ELSE date_trunc('day', o_orderdate) + INTERVAL 1 DAY END + INTERVAL '6 hours 30 minutes' AS daily, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS monthly FROM orders",
)
book.on(
    "events", "epoch_times",
    lambda t: t.select("event_id", F.round(dates.to_timestamp(F.col("ts")), 3).alias("seconds"), dates.from_timestamp(F.col("event_id") * 3601).alias("time"), records.tenure(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("至今")))["start"].cast("string").alias("since")),
    "SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS seconds, make_timestamp(event_id * 3601000000) AS time, strftime(ts, '%Y-%m-%d') AS since FROM events",
)
book.on(
    "customer", "request_log_lines",
    lambda t: sinks.for_sql(t.select("c_custkey", F.array("c_name", "c_mktsegment").alias("tags"), F.struct("c_nationkey").alias("at"))),
    """SELECT c_custkey, '["' || c_name || '","' || c_mktsegment || '"]' AS tags, '{"c_nationkey":' || c_nationkey || '}' AS at FROM customer""",
)
book.on(
    "events", "exposition_lines",
    lambda t: sinks.exposition(stats.counters(t, F.concat(F.lit("event/"), "event_type")).withColumn("kind", F.lit("counter"))),
    "WITH c AS (SELECT 'app_event_' || event_type AS n, count(*) AS v FROM events GROUP BY 1) SELECT '# TYPE ' || n || ' counter' AS line FROM c UNION ALL SELECT n || ' ' || v FROM c",
)


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").cast("string").alias("key"), (F.col("o_custkey") % 5).alias("priority"), F.col("o_orderdate").alias("enqueued_at"), (F.col("o_orderstatus") == "F").alias("processed"), F.col("o_orderkey").alias("seq"))


@book.add("SELECT o_orderkey::VARCHAR AS key, o_custkey % 5 AS priority FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_custkey % 5, o_orderdate, o_orderkey::VARCHAR LIMIT 50")
def queue_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty requests of a queue."""
    return sources.queue(_frontier(spark, sf_dir), 50)[0].select("key", "priority")


@book.add(
    """WITH t AS (SELECT o_orderkey::VARCHAR AS key, o_orderstatus = 'F' OR row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY o_custkey % 5, o_orderdate, o_orderkey::VARCHAR) <= 50 AS processed FROM orders)
    SELECT processed, count(*) AS n FROM t GROUP BY 1"""
)
def queue_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a queue is processed after such a read."""
    return sources.queue(_frontier(spark, sf_dir), 50)[1].groupBy("processed").agg(F.count("*").alias("n"))


@book.add("SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey % 5 END AS priority FROM orders")
def queue_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frontier after requests that it has come again with another priority."""
    front = _frontier(spark, sf_dir)
    again = front.filter("seq % 4 = 0").withColumn("priority", F.lit(-1).cast("long"))
    return sinks.enqueue(front.withColumn("priority", F.col("priority").cast("long")), again).select("key", "priority")


@book.add("SELECT md5(text) AS fp FROM documents UNION SELECT md5(text) FROM benchmark")
def fingerprint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, t).select(F.md5("text").alias("fp")) for t in ("documents", "benchmark"))
    return dedup.remember(a, b, ["fp"])


@book.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sql_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with arguments, limited by its caller."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tidemill_orders")
    return sources.fetch_all(spark, "SELECT o_orderkey, o_totalprice FROM tidemill_orders WHERE o_totalprice > :least ORDER BY o_totalprice DESC, o_orderkey", {"least": 200000}, 20)


book.on("part", "map_likeness", lambda t: t.select("p_partkey", F.round(records.map_similarity(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type"), F.create_map(F.lit("brand"), F.lit("Brand#11"), F.lit("name"), "p_name")), 6).alias("score")))
book.on("pages", "curl_commands", lambda t: t.select("page_id", sources.parse_curl(F.concat(F.lit("curl -H 'A: b' -d 'k=v' '"), "url", F.lit("'"))).alias("c")).select("page_id", "c.method", "c.url", "c.body"), "SELECT page_id, 'POST' AS method, url, 'k=v' AS body FROM pages")

book.on(
    "orders", "rendered_texts",
    lambda t: t.select("o_orderkey", text.render("order {id} of {{customer}}: {status} {other}", {"id": F.col("o_orderkey"), "customer": F.col("o_custkey"), "status": F.col("o_orderstatus")}).alias("text")),
    "SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || coalesce(o_custkey::VARCHAR, 'None') || ': ' || coalesce(o_orderstatus, 'None') || ' {other}' AS text FROM orders",
)
book.on(
    "events", "header_values",
    lambda t: t.select("event_id", text.header_value(F.create_map(F.element_at(F.array(*map(F.lit, ["x-type", "X-Type", "X-TYPE", "y"])), (F.col("event_id") % 4 + 1).cast("int")), F.col("event_type")), "X-type", "none").alias("value")),
    "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type ELSE 'none' END AS value FROM events",
)
book.on(
    "events", "cookie_values",
    lambda t: t.select("event_id", text.parse_cookies(F.concat(F.lit("id="), "event_id", F.lit("; Secure; type="), "event_type", F.lit("; id = "), "user_id")).alias("m")).select("event_id", F.col("m")["id"].alias("id"), F.col("m")["type"].alias("kind"), F.size("m").alias("n")),
    "SELECT event_id, user_id::VARCHAR AS id, event_type AS kind, 2 AS n FROM events",
)
book.on(
    "part", "table_names",
    lambda t: t.select("p_partkey", text.table_name("p_name").alias("by_name"), text.table_name(F.concat("p_type", F.lit("-"), "p_brand")).alias("by_type")),
    """SELECT p_partkey, CASE WHEN regexp_full_match(translate(trim(p_name), ' -', '__'), '[a-zA-Z0-9_]+') THEN translate(trim(p_name), ' -', '__') END AS by_name,
      CASE WHEN regexp_full_match(translate(trim(p_type || '-' || p_brand), ' -', '__'), '[a-zA-Z0-9_]+') THEN translate(trim(p_type || '-' || p_brand), ' -', '__') END AS by_type FROM part""",
)
book.on(
    "events", "zoned_times",
    lambda t: t.select("event_id", dates.to_local(F.col("ts")).alias("local"), dates.to_utc(dates.to_local(F.col("ts")), dates.LOCAL_ZONE).alias("utc"), dates.to_timezone(F.col("ts"), "Asia/Kolkata").alias("kolkata")),
    "SELECT event_id, ts + INTERVAL 8 HOUR AS local, ts AS utc, ts + INTERVAL 330 MINUTE AS kolkata FROM events",
)
QUERIES, ORACLES = book.queries, book.oracles
