"""Queries over events: statistics, row frames, order, pressure and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill import streaming
from tidemill.functions import pressure, web
from tidemill.operators import dedup, frames, order, stats, windows
from tidemill.plans.base import Book, scratch, table

book = Book()


def _by_user() -> WindowSpec:
    return W.partitionBy("user_id").orderBy("ts", "event_id")


def _status() -> Column:
    """An event as a fetch."""
    return (F.lit(200) + (F.col("event_id") % 5) * 100 + F.col("event_id") % 3).cast("int")


_STATUS_SQL = "(200 + event_id % 5 * 100 + event_id % 3)::INT"

book.on("events", "counters", lambda t: stats.counters(t, F.concat(F.lit("event/"), "event_type"), F.col("value").cast("decimal(18,2)")).withColumn("value", F.col("value").cast("double")), "SELECT 'event/' || event_type AS key, sum(value::DECIMAL(18, 2))::DOUBLE AS value FROM events GROUP BY 1")
book.on(
    "events", "gauges",
    lambda t: stats.gauges(t.withColumn("at", F.struct("ts", "event_id")), "event_type", "value", "at").select("event_type", "last", "max", "min", "n"),
    "SELECT event_type, arg_max(value, (ts, event_id)) AS last, max(value) AS max, min(value) AS min, count(value) AS n FROM events GROUP BY 1",
)
book.on(
    "events", "status_rollup",
    lambda t: stats.rollup(t.select(F.concat(F.lit("response_status_code/"), _status().cast("string")).alias("key"), F.lit(1).alias("value"))),
    f"SELECT 'response_status_code/' || CASE WHEN s BETWEEN 200 AND 599 THEN (s // 100) || 'xx' ELSE 'other/' || s END AS key, count(*) AS value FROM (SELECT {_STATUS_SQL} AS s FROM events) GROUP BY 1",
)
book.on(
    "events", "status_filter",
    lambda t: t.filter(web.status_allowed(_status(), [404, 302], [201])).select("event_id", web.status_category(_status()).alias("category"), web.status_flags(_status())["is_success"].alias("ok")),
    f"SELECT event_id, CASE WHEN s BETWEEN 200 AND 599 THEN (s // 100) || 'xx' ELSE 'other' END AS category, s BETWEEN 200 AND 299 AS ok FROM (SELECT event_id, {_STATUS_SQL} AS s FROM events) WHERE s <> 201 AND (s IN (404, 302) OR s BETWEEN 200 AND 299)",
)
book.on(
    "events", "retry_decisions",
    lambda t: t.select("event_id", web.retry_decision(_status(), (F.col("event_id") % 7).cast("int"), F.col("event_id") % 11 == 0).alias("r")).select("event_id", "r.*"),
    f"""WITH x AS (SELECT event_id, (event_id % 7)::INT AS n, {_STATUS_SQL} IN (500, 502, 503, 504, 408, 429) AND event_id % 11 <> 0 AND event_id % 7 < 3 AS retry FROM events)
      SELECT event_id, retry, CASE WHEN retry THEN least(pow(2.0, n), 30.0) END AS delay_s, CASE WHEN retry THEN n + 1 END AS attempt FROM x""",
)
book.on(
    "pages", "top_domains",
    lambda t: order.top(stats.counters(t, web.domain(F.col("url"))), 5, "value", ["key"]),
    r"""SELECT coalesce(nullif(regexp_replace(split_part(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), ':', 1), '^www\.', ''), ''), 'default') AS key, count(*) AS value FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)


@book.add(
    """WITH s AS (SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY 1)
    SELECT event_type, n, CASE WHEN seconds > 0 THEN round(n / seconds * 60, 2) END AS per_minute FROM s"""
)
def rate_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), span.alias("seconds"))
    return found.select("event_type", "n", stats.per_minute(F.col("n"), F.col("seconds")).alias("per_minute"))


@book.add(
    """WITH r AS (SELECT 'run' || user_id % 3 AS spider, ts, 'http://h' || user_id % 20 || '.example.com/' AS url,
      CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' WHEN 'purchase' THEN 'item' WHEN 'error' THEN 'error' ELSE 'request' END AS kind FROM events),
    b AS (SELECT spider, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS duration_seconds, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'response') AS responses,
      count(*) FILTER (kind = 'item') AS items, count(*) FILTER (kind = 'error') AS errors FROM r GROUP BY 1),
    d AS (SELECT spider, split_part(url, '/', 3) AS domain, count(*) AS n FROM r WHERE kind = 'request' GROUP BY 1, 2),
    t AS (SELECT spider, string_agg(domain || ':' || n, ',' ORDER BY n DESC, domain) AS top FROM (SELECT *, row_number() OVER (PARTITION BY spider ORDER BY n DESC, domain) AS k FROM d) WHERE k <= 5 GROUP BY 1)
    SELECT b.*, round(responses / greatest(1, requests) * 100, 2) AS success_rate, round(requests / greatest(1.0, duration_seconds), 2) AS requests_per_second, top FROM b JOIN t USING (spider)"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "response").when(F.col("event_type") == "purchase", "item").when(F.col("event_type") == "error", "error").otherwise("request")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("spider"), "ts", F.concat(F.lit("http://h"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com/")).alias("url"), kind.alias("kind")
    )
    found = stats.run_summary(rows)
    return found.withColumn("top", F.array_join(F.transform("top_domains", lambda d: F.concat(d["domain"], F.lit(":"), d["n"].cast("string"))), ",")).drop("top_domains")


book.on("events", "latency_percentiles", lambda t: stats.exact_percentiles(t, ["event_type"], "value", 0.5, 0.95, 0.99).select("event_type", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99")))), "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
book.on("events", "latest_p99", lambda t: stats.latest(t, ["ts", "event_id"], 1000).agg(F.round(F.percentile("value", 0.99), 6).alias("p99")), "SELECT round(quantile_cont(value, 0.99), 6) AS p99 FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
book.on(
    "events", "sink_latency",
    lambda t: stats.sink_latency(t.filter("event_type = 'purchase'").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("seconds"))).select(F.round("p99", 6).alias("p99")),
    """WITH b AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS n, sum(value::DECIMAL(18, 2))::DOUBLE AS s FROM events WHERE event_type = 'purchase' GROUP BY 1),
      x AS (SELECT ts, s / n AS value, unnest(range(1, least(n, 50) + 1)) AS k FROM b)
      SELECT round(quantile_cont(value, 0.99), 6) AS p99 FROM (SELECT value FROM x ORDER BY ts DESC, k DESC LIMIT 1000)""",
)
book.on(
    "events", "ignore_counts",
    lambda t: stats.ignore_counts(t.select(F.col("event_type").alias("reason"), F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string")).alias("domain"))),
    "SELECT 'reason' AS dimension, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'domain', 'd' || user_id % 9, count(*) FROM events GROUP BY 2",
)
book.on(
    "events", "response_totals",
    lambda t: stats.status_bytes(t.select(_status().alias("status"), F.col("user_id").alias("content_length"))),
    f"SELECT count(*) FILTER (s BETWEEN 200 AND 299) AS success_count, count(*) FILTER (s >= 400) AS error_count, sum(user_id)::BIGINT AS bytes FROM (SELECT user_id, {_STATUS_SQL} AS s FROM events)",
)
book.on(
    "events", "task_totals",
    lambda t: t.select(F.when(F.col("event_type") == "error", "exception").when(F.col("event_type") == "signup", "timeout").otherwise("ok").alias("outcome"), (F.col("event_type") != "error").alias("ok"), F.col("user_id").alias("bytes")).agg(*stats.outcome_counts(), *stats.fetch_counts()),
    "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS exception, 0::BIGINT AS cancelled, count(*) FILTER (event_type = 'signup') AS timeout, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS success, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, (sum(user_id) FILTER (event_type <> 'error'))::BIGINT AS total_bytes FROM events",
)
book.on(
    "events", "alerts",
    lambda t: stats.alert_summary(t.select(F.col("event_type").alias("level"), F.concat(F.lit("m"), "event_id").alias("message"), F.struct("ts", "event_id").alias("ts"))).select("level", "n", "latest"),
    "SELECT event_type AS level, count(*) AS n, 'm' || arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1",
)
book.on(
    "events", "progress_eta",
    lambda t: t.select("event_id", stats.eta(F.col("user_id"), F.lit(500), F.round(F.col("value"), 0)).alias("e"), stats.success_rate(F.col("user_id") % 5, F.col("event_id") % 2).alias("success_rate")).select("event_id", "e.eta_str", "e.percent", "success_rate"),
    """WITH e AS (SELECT event_id, user_id, round(value, 0) AS rate, round(value, 0) <= 0 OR user_id >= 500 AS none, (500 - user_id) / round(value, 0) AS left_s FROM events)
      SELECT event_id, CASE WHEN none THEN 'N/A' ELSE CASE WHEN left_s >= 3600 THEN floor(left_s / 3600)::BIGINT || 'h ' ELSE '' END || floor(left_s % 3600 / 60)::BIGINT || 'm' END AS eta_str,
        CASE WHEN none THEN CASE WHEN user_id > 0 THEN 100.0 ELSE 0.0 END ELSE round(user_id / 500 * 100, 1) END::DOUBLE AS percent,
        coalesce(user_id % 5 * 100.0 / nullif(user_id % 5 + event_id % 2, 0), 100.0)::DOUBLE AS success_rate FROM e""",
)
book.on(
    "events", "health_report",
    lambda t: stats.health(t.select("ts", F.when(F.col("event_type") == "view", "request").otherwise("response").alias("kind"), _status().alias("status"))).select("requests", "responses", "errors", F.round("error_rate", 9).alias("error_rate"), "level"),
    f"""WITH h AS (SELECT count(*) FILTER (event_type = 'view') AS requests, count(*) FILTER (event_type <> 'view') AS responses, count(*) FILTER (event_type <> 'view' AND {_STATUS_SQL} >= 400) AS errors FROM events)
      SELECT *, round(errors / responses, 9) AS error_rate, CASE WHEN errors / responses > 0.1 THEN 'warning' WHEN errors / responses > 0.05 THEN 'info' ELSE 'ok' END AS level FROM h""",
)
book.on(
    "events", "memory_trend",
    lambda t: stats.memory_trend(t.select("user_id", "event_id", F.col("event_id").cast("double").alias("i"), (F.col("value") * 1048576).alias("rss")), W.partitionBy("user_id").orderBy("event_id")).select("event_id", F.round("slope", 3).alias("slope"), "trend"),
    """WITH s AS (SELECT event_id, count(*) OVER w AS n, regr_slope(value * 1048576, event_id) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
      SELECT event_id, round(CASE WHEN n < 5 THEN 0.0 ELSE b END, 3) AS slope, CASE WHEN n < 5 THEN 'INSUFFICIENT_DATA' WHEN b / 1048576 <= 10 AND abs(b / 1048576) < 5 THEN 'STABLE' WHEN b / 1048576 > 10 THEN 'GROWING' ELSE 'DECREASING' END AS trend FROM s""",
)
book.on(
    "events", "ring_stats",
    lambda t: t.select("event_id", *(F.round(c, 6).alias(f"ring_{n}") for n, c in windows.ring("value", _by_user(), 10).items()), F.round(windows.ring_percentile("value", _by_user(), 10, 0.9), 6).alias("ring_p90")),
    """SELECT event_id, round(sum(value) OVER w, 6) AS ring_sum, round(avg(value) OVER w, 6) AS ring_mean, round(min(value) OVER w, 6) AS ring_min, round(max(value) OVER w, 6) AS ring_max, count(value) OVER w AS ring_count, round(quantile_cont(value, 0.9) OVER w, 6) AS ring_p90
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
@book.add(
    """SELECT event_id, round(sum(value) OVER w, 6) AS ring_sum, round(max(value) OVER w, 6) AS ring_max, count(value) OVER w AS ring_count, round(quantile_cont(value, 0.9) OVER w, 6) AS ring_p90,
      lag(event_type) OVER o AS before, round((epoch_us(ts) - epoch_us(lag(ts) OVER o)) / 1e6, 3) AS gap
      FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), o AS (ORDER BY ts, event_id)"""
)
def hot_key_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten events, the type and the time before, of all events as of one key, which no task holds."""

    def make(w: WindowSpec) -> dict[str, Column]:
        rings = {f"ring_{n}": F.round(c, 6) for n, c in windows.ring("value", w, 10).items() if n in ("sum", "max")} | {"ring_count": windows.ring("value", w, 10)["count"]}
        return rings | {"ring_p90": F.round(windows.ring_percentile("value", w, 10, 0.9), 6), "before": F.lag("event_type").over(w), "gap": F.round(windows.since_last(F.col("ts"), w), 3)}

    events = table(spark, sf_dir, "events").select(F.lit("all").alias("key"), "ts", "event_id", "event_type", "value")
    out = frames.framed(events, ["key"], ["ts", "event_id"], 10, make, scratch(spark, "frames"))
    return out.select("event_id", "ring_sum", "ring_max", "ring_count", "ring_p90", "before", "gap")


book.on(
    "events", "level_changes",
    lambda t: windows.changes(t, "event_type", _by_user()).select("event_id", "event_type", "before"),
    "SELECT event_id, event_type, before FROM (SELECT event_id, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NULL OR before <> event_type",
)
book.on(
    "events", "frame_rates",
    lambda t: t.select("event_id", F.round(windows.since_last(F.col("ts"), _by_user()), 3).alias("gap"), F.round(windows.delta(F.col("value"), _by_user()), 6).alias("delta"), (F.round(pressure.growth_rate(F.col("value"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, _by_user()), 6) + F.lit(0.0)).alias("growth")),
    """SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) AS gap, round(value - coalesce(lag(value) OVER w, 0), 6) AS delta,
      round(CASE WHEN epoch_us(ts) > epoch_us(first(ts) OVER f) THEN (value - first(value) OVER f) / ((epoch_us(ts) - epoch_us(first(ts) OVER f)) / 1e6) ELSE 0 END, 6) + 0.0 AS growth
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
book.on(
    "events", "interval_deltas",
    lambda t: windows.interval_deltas(t, "ts", 3600, ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "delta"),
    "SELECT event_type, start, n, n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY start), 0) AS delta FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)",
)
book.on(
    "events", "tumbling_60s",
    lambda t: t.groupBy(F.window("ts", "60 seconds").start.cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n")),
    "SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
book.on(
    "events", "session_gaps",
    lambda t: windows.sessions(t, ["user_id"], "ts", "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n"),
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events),
      k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM k GROUP BY user_id, k""",
)
book.on(
    "events", "pacing",
    lambda t: streaming.pace(t, "user_id", 2, 3600).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "over"),
    "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1, 2",
)
book.on(
    "events", "heartbeats",
    lambda t: streaming.heartbeats(t, "user_id", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 86400.0, 86400.0),
    "SELECT user_id, max(ts) AS last_beat, CASE WHEN epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts)) > 172800000000 THEN 'dead' WHEN epoch_us(TIMESTAMP '2024-01-30') - epoch_us(max(ts)) > 86400000000 THEN 'suspect' ELSE 'alive' END AS state FROM events GROUP BY 1",
)
book.on(
    "events", "first_sightings",
    lambda t: dedup.once_in(t.select("user_id", "ts", "event_id"), ["user_id"], "ts", 1800, ["event_id"]),
    """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      w AS (SELECT user_id, ts, event_id, rn FROM e WHERE rn = 1
        UNION ALL SELECT n.user_id, n.ts, n.event_id, n.rn FROM (
          SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.rn) AS k FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.rn > w.rn AND e.ts >= w.ts + INTERVAL 30 MINUTE) n WHERE k = 1)
      SELECT user_id, ts, event_id FROM w""",
)
book.on("events", "token_bucket", lambda t: streaming.rate_limit_batch(t.select("user_id", "ts", "event_id"), "user_id", 1 / 3600, 2.0))
book.on(
    "events", "pressure_scores",
    lambda t: t.select("event_id", F.round(pressure.score(F.col("user_id") % 100 / 100, F.col("value") / 10, F.col("event_id") % 10 / 20, F.col("event_id") % 7 / 7), 6).alias("score"))
    .withColumn("level", pressure.level(F.col("score"))).withColumn("delay", F.round(pressure.fixed_delay(F.col("score") / 100), 6)),
    """WITH s AS (SELECT event_id, round(user_id % 100 / 100 * 100 * 0.4 + least(abs(value / 10) * 10, 100.0) * 0.3 + ((1 - event_id % 10 / 20) * 50 + event_id % 7 / 7 * 50) * 0.3, 6) AS score FROM events)
      SELECT event_id, score, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'danger' WHEN score >= 50 THEN 'warning' ELSE 'normal' END AS level,
        round(CASE WHEN score / 100 >= 0.95 THEN 5.0 WHEN score / 100 >= 0.90 THEN 0.4 WHEN score / 100 >= 0.8 THEN 0.1 * (1 + (score / 100 - 0.8) / (0.95 - 0.8) * 3) ELSE 0.0 END, 6) AS delay FROM s""",
)


@book.add(
    """WITH r AS (SELECT event_id, user_id, ts, least(CASE event_type WHEN 'view' THEN 0.15 WHEN 'click' THEN 0.65 WHEN 'purchase' THEN 1.75 WHEN 'error' THEN 3.75 ELSE 0.15 END
      * CASE WHEN value > 90 THEN 1.5 WHEN value > 80 THEN 1.2 ELSE 1.0 END + CASE WHEN value > 50 THEN 0.3 WHEN value > 20 THEN 0.1 ELSE 0.0 END, 5.0) AS raw FROM events),
    l AS (SELECT event_id, raw, lag(raw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM r)
    SELECT event_id, round(CASE WHEN before IS NULL THEN raw ELSE greatest(least(raw, before + 0.5), before - 0.5) END, 6) AS delay FROM l"""
)
def smooth_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "view", "normal").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "purchase", "danger").when(F.col("event_type") == "error", "critical")
    usage = F.least(F.col("value") / 100, F.lit(1.0))
    raw = pressure.raw_delay(level, pressure.adjustment(usage, F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.least(pressure.prediction(F.col("value")), F.lit(0.3)))
    rows = table(spark, sf_dir, "events").withColumn("raw", raw)
    return rows.select("event_id", F.round(pressure.smooth_delay(F.col("raw"), _by_user()), 6).alias("delay"))


book.on(
    "orders", "next_requests",
    lambda t: order.next_requests(t.select("o_orderkey", (F.col("o_custkey") % 7).alias("priority"), F.col("o_orderkey").alias("seq")), 100),
    "SELECT o_orderkey, o_custkey % 7 AS priority, o_orderkey AS seq FROM orders ORDER BY 2, 3 LIMIT 100",
)
book.on(
    "orders", "two_lanes",
    lambda t: order.two_lanes(t.select("o_orderkey", (F.col("o_custkey") % 7 - 1).alias("priority"), F.struct("o_orderdate", "o_orderkey").alias("enqueued_at")), 100).select("o_orderkey", "priority"),
    "SELECT o_orderkey, o_custkey % 7 - 1 AS priority FROM orders ORDER BY o_custkey % 7 - 1 >= 0, o_orderdate, o_orderkey LIMIT 100",
)
book.on(
    "lineitem", "best_matches",
    lambda t: order.best_matches(t.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity", 10.0),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem WHERE l_quantity >= 10) WHERE r = 1",
)


@book.add(
    """WITH q AS (SELECT event_id, (event_id % 5 - 2)::INT AS priority, (event_id % 4)::INT AS depth, CASE WHEN event_type = 'view' THEN 'html' ELSE 'image' END AS content_type, 'h' || user_id % 40 AS domain, 'http://h' || user_id % 40 || '/' || user_id AS url, ts, value, event_type FROM events),
    d AS (SELECT domain, count(*) AS n, max(ts) AS last_time, avg(value::DECIMAL(18, 2)) / 20 AS mean, count(*) FILTER (event_type = 'error') AS errors FROM q GROUP BY 1),
    u AS (SELECT url, count(*) AS n FROM q GROUP BY 1)
    SELECT event_id, (2 * priority - CASE WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_time) < 5000000 THEN 2 WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_time) < 30000000 THEN 1 ELSE 0 END
      - CASE WHEN d.n > 10 THEN 1 ELSE 0 END - CASE WHEN u.n > 1 THEN u.n ELSE 0 END - depth - CASE WHEN mean > 5 THEN 1 WHEN mean < 1 THEN -1 ELSE 0 END
      - CASE WHEN errors > 3 THEN least(errors, 5) ELSE 0 END + CASE WHEN content_type = 'html' THEN 1 ELSE 0 END - CASE WHEN d.n > 100 THEN 1 ELSE 0 END)::BIGINT AS final_priority
    FROM q JOIN d USING (domain) JOIN u ON q.url = u.url"""
)
def learned_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    host = F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string"))
    q = e.select(
        "event_id", (F.col("event_id") % 5 - 2).cast("int").alias("priority"), (F.col("event_id") % 4).cast("int").alias("depth"), F.when(F.col("event_type") == "view", "html").otherwise("image").alias("content_type"),
        F.concat(F.lit("http://"), host, F.lit("/"), F.col("user_id").cast("string")).alias("url"), host.alias("host"), "ts", "value", "event_type",
    )
    domains = q.groupBy(F.col("host").alias("domain")).agg(F.count("*").alias("count"), F.max("ts").alias("last_time"), (F.avg(F.col("value").cast("decimal(18,2)")).cast("double") / 20).alias("mean_seconds"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("last_hour"))
    urls = q.groupBy("url").agg(F.count("*").alias("count"))
    found = order.learned_priority(q.select("event_id", "url", "priority", "depth", "content_type"), domains, urls, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return found.select("event_id", "final_priority")


QUERIES, ORACLES = book.queries, book.oracles
