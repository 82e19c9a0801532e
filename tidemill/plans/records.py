"""Queries over customers, orders, documents and conversations as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import dates, records
from tidemill.operators import bloom, joins, order, validate, writes
from tidemill.plans.base import Book, scratch, table
from tidemill.sources import sinks

book = Book()


@book.add("SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_exists(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"], "has_orders")


@book.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def existing_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter(writes.lookup({"o_totalprice__gt": 300000})).select(F.col("o_custkey").alias("c_custkey"))
    return joins.existing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@book.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def seen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.missing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_BACK = "(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09)"


def _parts_and_back(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    back = table(spark, sf_dir, "lineitem").filter(writes.lookup({"l_returnflag": "R", "l_discount__gt": 0.09}))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name"), back.select(F.col("l_partkey").alias("p_partkey"))


@book.add(f"SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN {_BACK}")
def bloom_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that never came back: most are cleared by a Bloom filter, the others by an exact join."""
    parts, back = _parts_and_back(spark, sf_dir)
    return bloom.unseen(parts, back, ["p_partkey"])


@book.add(f"SELECT count(*) FILTER (p_partkey IN {_BACK}) AS held, count(*) FILTER (p_partkey NOT IN {_BACK}) AS never, true AS few_false FROM part")
def bloom_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two filters of halves of the keys, merged: all keys are held, of the others at most one in a hundred."""
    parts, back = _parts_and_back(spark, sf_dir)
    n = back.select("p_partkey").distinct().count()
    odd, even = (bloom.Bloom.of(back.filter(F.col("p_partkey") % 2 == k), ["p_partkey"], n) for k in (1, 0))
    seen = back.distinct().withColumn("seen", F.lit(True))
    probed = odd.merge(even).probe(parts).join(seen, "p_partkey", "left")
    counts = probed.agg(F.count(F.when(F.col("seen") & F.col("maybe"), 1)).alias("held"), F.count(F.when(F.col("seen").isNull(), 1)).alias("never"), F.count(F.when(F.col("seen").isNull() & F.col("maybe"), 1)).alias("false"))
    return counts.select("held", "never", (F.col("false") <= F.ceil(0.01 * F.col("never"))).alias("few_false"))


@book.add("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey AND r.l_returnflag = 'R' AND r.l_discount > 0.09)")
def composite_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    back = lines.filter(writes.lookup({"l_returnflag": "R", "l_discount__gt": 0.09}))
    return joins.existing(lines.select("l_orderkey", "l_partkey", "l_suppkey"), back, ["l_partkey", "l_suppkey"])


@book.add(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.source END AS source, d.lang
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def listing_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("source"), F.lit("").alias("lang"))
    return joins.enrich(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), detail, ["doc_id"], ["source", "lang"])


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A table of older orders, and later writes to it, some for keys that it has, some twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    later = orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey"), F.lit("W").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("seq"))
    again = orders.filter("o_orderkey % 9 = 0").select(F.col("o_orderkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 2).alias("o_totalprice"), F.lit(2).alias("seq"))
    return orders.filter("o_orderkey % 2 = 0"), later.union(again)


_CHANGES = """t AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0),
    w AS (SELECT o_orderkey, 'W' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, 1 AS seq FROM orders WHERE o_orderkey % 3 = 0
      UNION ALL SELECT o_orderkey, 'X', o_totalprice + 2, 2 FROM orders WHERE o_orderkey % 9 = 0),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq) AS rn FROM w) WHERE rn = 1),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS rn FROM w) WHERE rn = 1)"""


@book.add(f"WITH {_CHANGES} SELECT o_orderkey, o_orderstatus, o_totalprice FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l) UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM l")
def write_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, rows = _changes(spark, sf_dir)
    return writes.replace(target, rows, ["o_orderkey"], ["seq"])


@book.add(f"WITH {_CHANGES} SELECT * FROM t UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def write_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, rows = _changes(spark, sf_dir)
    return writes.insert_ignore(target, rows, ["o_orderkey"], ["seq"])


@book.add(
    f"""WITH {_CHANGES} SELECT t.o_orderkey, t.o_orderstatus, coalesce(l.o_totalprice, t.o_totalprice) AS o_totalprice FROM t LEFT JOIN l ON t.o_orderkey = l.o_orderkey
    UNION ALL SELECT f.o_orderkey, f.o_orderstatus, l.o_totalprice FROM f JOIN l ON f.o_orderkey = l.o_orderkey WHERE f.o_orderkey NOT IN (SELECT o_orderkey FROM t)"""
)
def write_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, rows = _changes(spark, sf_dir)
    return writes.upsert(target, rows, ["o_orderkey"], ["o_totalprice"], ["seq"])


@book.add("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 7")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return writes.delete(writes.update(supplier, {"s_acctbal": 0.0}, {"s_nationkey": 3}), {"s_nationkey": 7}).select("s_suppkey", "s_name", "s_acctbal")


@book.add("SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_retailprice FROM part")
def write_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return writes.batch(a, b)


@book.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND o_orderpriority LIKE '1%' AND o_custkey % 1 = 0 AND o_orderstatus IN ('O', 'P')")
def lookup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = {"o_totalprice__gte": 100000, "o_orderstatus__ne": "F", "o_orderpriority__like": "1%", "o_orderstatus__in": ["O", "P"]}
    return table(spark, sf_dir, "orders").filter(writes.lookup(want)).select("o_orderkey", "o_totalprice")


_FIELDS = {"c_name": validate.Field(nullable=False, max_length=17), "c_mktsegment": validate.Field(default="NONE"), "c_acctbal": validate.Field(nullable=False)}
book.on(
    "customer", "field_validate",
    lambda t: validate.validate(t.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise("  ")).withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))), _FIELDS).select("c_custkey", "c_mktsegment", F.array_join("_errors", "; ").alias("errors")),
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE 'NONE' END AS c_mktsegment,
      CASE WHEN c_custkey % 5 = 0 OR c_name IS NULL THEN 'c_name: empty' WHEN length(c_name) > 17 THEN 'c_name: too long' ELSE '' END AS errors FROM customer""",
)
book.on(
    "orders", "time_arithmetic",
    lambda t: t.select(
        "o_orderkey", dates.time_diff(F.col("o_orderdate"), F.lit("1995-06-17 12:30:45").cast("timestamp_ntz"), "hours").alias("hours"), dates.add(F.col("o_orderdate"), 3, 1).alias("later"),
        dates.truncate(F.col("o_orderdate"), "month").alias("month"), dates.iso_format(F.col("o_orderdate")).alias("iso"), dates.to_local(F.col("o_orderdate")).alias("local"),
        F.size(dates.date_range(F.col("o_orderdate"), dates.add(F.col("o_orderdate"), 0, 1))).alias("days"), dates.report_date(F.col("o_orderdate")).cast("string").alias("report"),
        dates.is_recent(F.col("o_orderdate"), 100, F.lit("1995-06-17 12:30:45").cast("timestamp_ntz")).alias("recent"),
    ),
    """SELECT o_orderkey, (abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17 12:30:45')) // 3600000000)::BIGINT AS hours, o_orderdate + INTERVAL 3 DAY + INTERVAL 1 MONTH AS later,
      date_trunc('month', o_orderdate)::TIMESTAMP AS month, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, o_orderdate + INTERVAL 8 HOUR AS local,
      (date_diff('day', o_orderdate::DATE, (o_orderdate + INTERVAL 1 MONTH)::DATE) + 1)::INT AS days,
      CASE WHEN (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE = o_orderdate::DATE THEN o_orderdate::DATE ELSE (date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY)::DATE END::VARCHAR AS report,
      floor((epoch_us(TIMESTAMP '1995-06-17 12:30:45') - epoch_us(o_orderdate)) / 86400000000.0) < 100 AS recent FROM orders""",
)
book.on(
    "orders", "parse_times",
    lambda t: t.select("o_orderkey", dates.parse_time(F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 07:08:09"))).alias("a"), dates.parse_time(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("b"), dates.parse_time(F.lit("soon")).alias("c")),
    "SELECT o_orderkey, o_orderdate::DATE + INTERVAL '7 hours 8 minutes 9 seconds' AS a, o_orderdate::DATE::TIMESTAMP AS b, NULL::TIMESTAMP AS c FROM orders",
)
# fixed values in the SQL: the names of the units
book.on(
    "events", "durations",
    lambda t: t.select("event_id", dates.format_duration(F.col("event_id") * 37 % 200000).alias("shown")),
    """WITH d AS (SELECT event_id, event_id * 37 % 200000 AS s FROM events)
      SELECT event_id, CASE WHEN s < 60 THEN s || ' 秒' WHEN s < 3600 THEN (s // 60) || ' 分钟' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || ' 秒' ELSE '' END
        WHEN s < 86400 THEN (s // 3600) || ' 小时' || CASE WHEN s % 3600 // 60 > 0 THEN ' ' || (s % 3600 // 60) || ' 分钟' ELSE '' END
        ELSE (s // 86400) || ' 天' || CASE WHEN s % 86400 // 3600 > 0 THEN ' ' || (s % 86400 // 3600) || ' 小时' ELSE '' END END AS shown FROM d""",
)
# fixed values in the SQL: prefixes of stock codes by exchange
book.on(
    "part", "stock_codes",
    lambda t: t.select("p_partkey", records.exchange_suffix((F.col("p_partkey") * 7919 % 1000000).cast("string")).alias("code"), records.business_key(F.col("p_name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))).alias("id"), records.round_half_up(F.col("p_retailprice") / 7, 4).alias("price")),
    """WITH c AS (SELECT *, lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') AS s FROM part)
      SELECT p_partkey, s || CASE WHEN left(s, 2) IN ('60', '68') THEN '.SH' WHEN left(s, 2) IN ('00', '01', '02', '30') THEN '.SZ'
        WHEN left(s, 2) IN ('43', '82', '83', '87', '88') OR s LIKE '920%' THEN '.BJ' END AS code,
      CASE WHEN p_partkey % 3 > 0 THEN md5(trim(p_name) || trim(p_brand)) ELSE repeat('0', 32) END AS id, round((p_retailprice / 7)::DECIMAL(38, 15), 4)::DOUBLE AS price FROM c""",
)
book.on(
    "events", "compact_props",
    lambda t: t.select("event_id", F.map_keys(records.compact(F.create_map(F.lit("type"), "event_type", F.lit("none"), F.lit(None).cast("string"), F.lit("empty"), F.lit(""), F.lit("user"), F.col("user_id").cast("string")), {"type": "view"})).alias("keys")),
    "SELECT event_id, CASE WHEN event_type = 'view' THEN ['user'] ELSE ['type', 'user'] END AS keys FROM events",
)
book.on(
    "events", "json_props",
    lambda t: t.select("event_id", records.parse_json(F.col("props"), "k int")["k"].alias("k")),
    "SELECT event_id, (props->>'k')::INT AS k FROM events",
)
book.on(
    "orders", "record_cells",
    lambda t: sinks.cells(t.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("string").alias("o_orderdate"))).groupBy("column").agg(F.count("*").alias("n"), F.count_distinct("rowkey").alias("records"), F.max("value").alias("largest")),
    """WITH r AS (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderdate FROM orders)
      SELECT 'cf:o_orderkey' AS "column", count(*) AS n, count(*) AS records, max(o_orderkey::VARCHAR) AS largest FROM r
      UNION ALL SELECT 'cf:o_orderstatus', count(*), count(*), max(coalesce(o_orderstatus, '')) FROM r
      UNION ALL SELECT 'cf:o_orderdate', count(*), count(*), max(coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '')) FROM r""",
)


@book.add(
    """WITH RECURSIVE e AS (SELECT c_custkey AS s, c_custkey * 2 AS t FROM customer UNION SELECT c_custkey, c_custkey * 3 FROM customer),
    w(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT t, depth + 1 FROM w JOIN e ON s = node WHERE depth < 50)
    SELECT node::VARCHAR AS url, min(depth)::INT AS depth FROM w GROUP BY node"""
)
def link_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of pages that are reached from the first; page n links to 2n and 3n."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    text = lambda by: (F.col("c_custkey") * by).cast("string")
    links = c.select(text(1).alias("source"), text(2).alias("target")).union(c.select(text(1), text(3)))
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(scratch(spark, "depths"))
    return order.depths(links, spark.sql("SELECT '1' AS url"))


@book.add(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - to_days((o_orderkey % 40)::INTEGER) WHEN 1 THEN o_orderdate + to_hours((o_orderkey % 90)::BIGINT) + to_minutes(5)
        WHEN 2 THEN date_trunc('day', o_orderdate) - INTERVAL 1 DAY + INTERVAL '17:05' HOUR TO MINUTE ELSE o_orderdate - to_months((o_orderkey % 15)::INTEGER) END AS found FROM orders""".replace("INTERVAL '17:05' HOUR TO MINUTE", "INTERVAL 1025 MINUTE")
)
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times told by their distance from each order's date, in two languages."""
    n = lambda k: (F.col("o_orderkey") % k).cast("string")
    kind = F.col("o_orderkey") % 4
    said = F.when(kind == 0, F.concat(n(40), F.lit(" days ago"))).when(kind == 1, F.concat(F.lit("in "), n(90), F.lit(" hours, 5 minutes"))).when(kind == 2, F.lit("Yesterday at 5:05 PM")).otherwise(F.concat(n(15), F.lit("个月前")))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_time(said, F.col("o_orderdate")).alias("found"))


QUERIES, ORACLES = book.queries, book.oracles
