"""Counters, rates, percentiles and reports over events and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidemill.functions.web import authority


def counters(events: DataFrame, key: Column, amount: Column | None = None) -> DataFrame:
    """key and value: sums of amount, or counts."""
    return events.groupBy(key.alias("key")).agg((F.count("*") if amount is None else F.sum(amount)).alias("value"))


def gauges(events: DataFrame, key: str, value: str, time: str) -> DataFrame:
    """Last, largest and smallest value of each key, and how many there are. The values themselves stay rows: see series."""
    return events.groupBy(key).agg(F.max_by(value, time).alias("last"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("n"))


def series(events: DataFrame, key: str, value: str, time: list[str]) -> DataFrame:
    """What was appended to each key, in order: key, time and value, sorted by ranges, so that a key of many values is spread."""
    return events.select(key, *time, value).orderBy(key, *time)


def count_where(rows: DataFrame, conditions: dict[str, object]) -> DataFrame:
    for k, v in conditions.items():
        rows = rows.filter(F.col(k) == F.lit(v))
    return rows.agg(F.count("*").alias("count"))


def per_minute(count: Column, seconds: Column) -> Column:
    """Rounded to two places; null without time passed."""
    return F.when(seconds > 0, F.round(count / seconds * 60, 2))


def rolled_key(key: Column) -> Column:
    """Counter names by class: status codes by hundreds, reasons of ignored requests by the code that they hold."""
    # fixed values: the names of the counters and the words before a code
    reason = F.regexp_extract(key, r"^request_ignore_count/reason/(.*)$", 1)
    in_text = F.regexp_extract(reason, r"状态码\s+(\d+)", 1)
    code = F.when(in_text != "", in_text).when(F.rlike(reason, F.lit(r"^\d+$")), reason)
    status = F.regexp_extract(key, r"^response_status_code/([+-]?\d+)$", 1)
    number = F.when(status != "", status).cast("int")
    by_class = F.when(number.between(200, 599), F.concat(F.floor(number / 100).cast("string"), F.lit("xx"))).otherwise(F.concat(F.lit("other/"), number.cast("string")))
    return F.when(code.isNotNull(), F.concat(F.lit("request_ignore_count/status_code/"), code)).when(status != "", F.concat(F.lit("response_status_code/"), by_class)).otherwise(key)


def rollup(stats: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    return stats.groupBy(rolled_key(F.col(key)).alias("key")).agg(F.sum(value).alias("value"))


def run_summary(requests: DataFrame, by: str = "spider", top: int = 5) -> DataFrame:
    """One row a run: duration, counts, success rate, rate, and its top domains. requests: by, url, ts, kind (request, response, item, error)."""
    base = requests.groupBy(by).agg(
        F.round((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6, 2).alias("duration_seconds"),
        *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("request", "requests"), ("response", "responses"), ("item", "items"), ("error", "errors"))),
    )
    hosts = requests.filter("kind = 'request'").groupBy(by, authority(F.col("url"), "").alias("domain")).agg(F.count("*").alias("n"))
    ranked = hosts.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "domain"))).filter(F.col("r") <= top)
    tops = ranked.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "domain", "n"))), lambda x: F.struct(x["domain"].alias("domain"), x["n"].alias("n"))).alias("top_domains"))
    return base.join(tops, by, "left").select(
        by, "duration_seconds", "requests", "responses", "items", "errors",
        F.round(F.col("responses") / F.greatest(F.lit(1), F.col("requests")) * 100, 2).alias("success_rate"),
        F.round(F.col("requests") / F.greatest(F.lit(1.0), F.col("duration_seconds")), 2).alias("requests_per_second"),
        "top_domains",
    )


def percentiles(value: str, *shares: float) -> Column:
    """Exact, by linear interpolation; 0.0 for none. For groups whose distinct values fit in a task; exact_percentiles is for any."""
    found = F.percentile(value, F.array(*(F.lit(s) for s in shares)))
    return F.coalesce(found, F.array(*(F.lit(0.0) for _ in shares)))


def at_ranks(values: DataFrame, wanted: DataFrame, buckets: int = 200) -> DataFrame:
    """Of values (k, v) those at wanted (k, name, rank from 0) in each k's order: k, name, v. Null values are left out.

    Approximate cuts divide a group into buckets, whose counts, a few hundred rows a group, tell which of them hold the ranks; only
    the values of these are counted and ordered.
    """
    known = values.filter("v IS NOT NULL")
    cuts = known.groupBy("k").agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("cuts"))
    placed = known.join(cuts, "k").select("k", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))
    sizes = placed.groupBy("k", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("k", "bucket", "n", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    asked = wanted.join(before, "k").filter("rank >= before AND rank < before + n").select("k", "bucket", "name", (F.col("rank") - F.col("before")).alias("rank"))
    held = placed.join(asked.select("k", "bucket").distinct(), ["k", "bucket"]).groupBy("k", "bucket", "v").agg(F.count("*").alias("n"))
    upto = held.withColumn("upto", F.sum("n").over(W.partitionBy("k", "bucket").orderBy("v")))
    return upto.join(asked, ["k", "bucket"]).filter("rank < upto AND rank >= upto - n").select("k", "name", "v")


def exact_percentiles(rows: DataFrame, by: list[str], value: str, *shares: float) -> DataFrame:
    """by and p, an array of exact percentiles by linear interpolation (0.0 for none), for groups of any size."""
    # a struct is equal to another with the same nulls
    values = rows.select(F.struct(*by).alias("k"), F.col(value).cast("double").alias("v"))
    sizes = values.groupBy("k").agg(F.count("v").alias("n"))
    places = sizes.select("k", "n", F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("i", "share")).withColumn("at", F.col("share") * F.greatest(F.col("n") - 1, F.lit(0)))
    ends = F.array(F.struct(F.lit("low").alias("end"), F.floor("at").alias("rank")), F.struct(F.lit("high").alias("end"), F.ceil("at").alias("rank")))
    wanted = places.select("k", F.explode(F.transform(ends, lambda e: F.struct(F.struct("i", e["end"].alias("end")).alias("name"), e["rank"].alias("rank")))).alias("e")).select("k", "e.*")
    found = at_ranks(values, wanted).groupBy("k", F.col("name.i").alias("i")).agg(F.max(F.when(F.col("name.end") == "low", F.col("v"))).alias("low"), F.max(F.when(F.col("name.end") == "high", F.col("v"))).alias("high"))
    mixed = places.join(found, ["k", "i"], "left").withColumn("v", F.coalesce(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")), F.lit(0.0)))
    return mixed.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("p")).select("k.*", "p")


def latest(rows: DataFrame, time: list[str], n: int = 1000) -> DataFrame:
    """The last n samples; each task keeps n."""
    return rows.orderBy(*(F.desc(t) for t in time)).limit(n)


def sink_latency(batches: DataFrame, n: int = 1000) -> DataFrame:
    """P99 of the last n samples of batches (ts, rows, seconds): a batch counts its mean as often as it has rows, 50 times at most."""
    samples = batches.withColumn("sample", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("rows", F.lit(50)))))).withColumn("value", F.col("seconds") / F.greatest("rows", F.lit(1)))
    return latest(samples, ["ts", "sample"], n).agg(F.coalesce(F.percentile("value", 0.99), F.lit(0.0)).alias("p99"))


def queue_stats(queue: DataFrame) -> DataFrame:
    """Throughput a second, mean wait and largest size of queue events (ts, kind enqueue or dequeue, wait_s, size)."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    done = F.count_if(F.col("kind") == "dequeue")
    return queue.agg(done.alias("dequeued"), F.when(span > 0, done / span).otherwise(0.0).alias("throughput"), F.avg(F.when(F.col("kind") == "dequeue", F.col("wait_s"))).alias("avg_wait"), F.max("size").alias("max_size"))


def ignore_counts(ignored: DataFrame) -> DataFrame:
    """Counts by reason and by domain in one pass: dimension, name, n."""
    sets = ignored.groupingSets([["reason"], ["domain"]], "reason", "domain").agg(F.count("*").alias("n"), F.grouping("reason").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "reason").otherwise("domain").alias("dimension"), F.when(F.col("g") == 0, F.col("reason")).otherwise(F.col("domain")).alias("name"), "n")


def status_bytes(responses: DataFrame) -> DataFrame:
    return responses.agg(F.count_if(F.col("status").between(200, 299)).alias("success_count"), F.count_if(F.col("status") >= 400).alias("error_count"), F.coalesce(F.sum("content_length"), F.lit(0)).alias("bytes"))


def fetch_counts() -> list[Column]:
    """Aggregates over ok and bytes."""
    return [F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("bytes"))), F.lit(0)).alias("total_bytes")]


def fetch_summary(results: DataFrame) -> DataFrame:
    return results.agg(*fetch_counts())


def success_rate(done: Column, failed: Column) -> Column:
    """Percent; 100 before anything is done."""
    return F.coalesce(F.try_divide(done * 100.0, done + failed), F.lit(100.0))


def outcome_counts() -> list[Column]:
    """Aggregates over outcome; success is what is left."""
    kinds = ("exception", "cancelled", "timeout")
    return [F.count("*").alias("total"), *(F.count_if(F.col("outcome") == k).alias(k) for k in kinds), F.count_if(~F.coalesce(F.col("outcome").isin(*kinds), F.lit(False))).alias("success")]


def task_stats(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*outcome_counts())


def cluster_progress(workers: DataFrame) -> DataFrame:
    """Totals over partial and final reports of workers, and items a second of the time passed."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return workers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("completed", "failed", "items")), F.coalesce(F.try_divide(F.sum("items"), span), F.lit(0.0)).alias("items_per_sec"))


def eta(completed: Column, expected: Column, rate: Column) -> Column:
    """struct(eta, eta_str, percent); N/A where nothing moves or all is done."""
    left = (expected - completed) / rate
    hours, minutes = F.floor(left / 3600), F.floor(left % 3600 / 60)
    none = (rate <= 0) | (completed >= expected)
    text = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""), minutes.cast("string"), F.lit("m"))
    return F.struct(
        F.when(none, F.lit(0)).otherwise(F.bround(left)).cast("long").alias("eta"),
        F.when(none, "N/A").otherwise(text).alias("eta_str"),
        F.when(none, F.when(completed > 0, 100.0).otherwise(0.0)).otherwise(F.round(completed / expected * 100, 1)).alias("percent"),
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts and the latest message by level."""
    return alerts.groupBy("level").agg(F.count("*").alias("n"), F.max_by("message", "ts").alias("latest"), F.max("ts").alias("latest_ts"))


def memory_trend(samples: DataFrame, order: WindowSpec, leak_mb: float = 10.0, stable: float = 5.0) -> DataFrame:
    """samples (i, rss) with slope (least squares over the last five) and trend."""
    last = order.rowsBetween(-4, 0)
    n = F.count("rss").over(last)
    slope = F.regr_slope("rss", "i").over(last)
    mb = slope / (1024 * 1024)
    trend = F.when(n < 5, "INSUFFICIENT_DATA").when((mb <= leak_mb) & (F.abs(mb) < stable), "STABLE").when(mb > leak_mb, "GROWING").otherwise("DECREASING")
    return samples.withColumn("slope", F.when(n < 5, 0.0).otherwise(slope)).withColumn("trend", trend)


def stable_baseline(samples: DataFrame, order: WindowSpec, percent: float = 5.0) -> DataFrame:
    """One row: the first mean of five samples whose spread is under percent of it."""
    last = order.rowsBetween(-4, 0)
    mean = F.avg("rss").over(last)
    spread = (F.max("rss").over(last) - F.min("rss").over(last)) / mean * 100
    marked = samples.withColumn("mean", mean).withColumn("spread", spread).withColumn("n", F.count("rss").over(last))
    return marked.filter((F.col("n") == 5) & (F.col("mean") > 0) & (F.col("spread") < percent)).agg(F.min_by("mean", "i").alias("baseline"))


def duplicate_rate(snapshots: DataFrame, order: WindowSpec) -> DataFrame:
    """snapshots (t seconds, counter) with rps: growth since the oldest of 65, over the time passed, 60 s at most."""
    frame = order.rowsBetween(-64, 0)
    took = F.least(F.lit(60.0), F.col("t") - F.first("t").over(frame))
    return snapshots.withColumn("rps", F.when(took > 0, (F.col("counter") - F.first("counter").over(frame)) / took).otherwise(0.0))


def health(events: DataFrame) -> DataFrame:
    """Requests, responses, their rates, error rate and its level: over 10 % is a warning, over 5 % worth a note."""
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    counted = events.agg(F.count_if(F.col("kind") == "request").alias("requests"), F.count_if(F.col("kind") == "response").alias("responses"), F.count_if((F.col("kind") == "response") & (F.col("status") >= 400)).alias("errors"), span.alias("seconds"))
    rate = F.coalesce(F.try_divide(F.col("errors"), F.col("responses")), F.lit(0.0))
    return counted.withColumn("error_rate", rate).withColumn("level", F.when(F.col("error_rate") > 0.10, "warning").when(F.col("error_rate") > 0.05, "info").otherwise("ok"))


def generation(batches: DataFrame) -> DataFrame:
    return batches.agg(F.sum("generated").alias("generated"), F.coalesce(F.try_divide(F.sum("generated"), F.sum("seconds")), F.lit(0.0)).alias("rate"))


def cluster_status(workers: DataFrame) -> DataFrame:
    return workers.groupBy("status").agg(F.count("*").alias("workers"))


def diagnose(idle: Column, pending: Column, processing: Column, dead: Column, rate: Column, elapsed: Column) -> Column:
    """What is wrong with a cluster; an empty array is healthy."""
    found = F.array(
        F.when((idle > 0) & (pending > 0), F.concat(idle.cast("string"), F.lit(" idle workers with "), pending.cast("string"), F.lit(" pending tasks"))),
        F.when(processing > 1000, F.concat(F.lit("high pending count "), processing.cast("string"))),
        F.when(dead > 0, F.concat(dead.cast("string"), F.lit(" dead letters"))),
        F.when((rate == 0) & (elapsed > 60), F.lit("no progress for 60 s")),
    )
    return F.filter(found, lambda x: x.isNotNull())
