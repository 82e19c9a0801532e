"""URL filters by a temporal list join.

List entries say from when on a pattern is listed or no longer listed. They become validity intervals, and an as-of
join finds for every capture the entry that was active when it was fetched. A pattern is a host or domain
(``example.com`` covers its subdomains) or a host with a directory (``example.com/private/``); the longest that applies wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a last dot; null where url has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, since, until; until null while it lasts) of entries (pattern, dated, listed).

    An entry holds until the pattern's next one; of entries with one date, listed wins. Entries with a null pattern,
    date or flag say nothing. Patterns are compared in lower case.
    """
    dated = entries.filter("pattern IS NOT NULL AND dated IS NOT NULL AND listed IS NOT NULL").groupBy(F.lower("pattern").alias("pattern"), "dated").agg(F.max("listed").alias("listed"))
    ordered = W.partitionBy("pattern").orderBy("dated")
    return dated.select("pattern", F.col("dated").alias("since"), F.lead("dated").over(ordered).alias("until"), "listed").filter("listed").drop("listed")


def _shapes(patterns: DataFrame) -> tuple[list[int], list[int]]:
    """Which numbers of labels listed domains have, and which numbers of directories listed hosts with a directory have."""
    slashes, dots = (F.length("pattern") - F.length(F.replace("pattern", F.lit(mark))) for mark in "/.")
    found = patterns.select(F.when(slashes == 0, dots + 1).alias("labels"), F.when(slashes > 0, slashes).alias("depth")).distinct().collect()
    return [sorted({r[k] for r in found if r[k] is not None}) for k in ("labels", "depth")]


def _keys(host: Column, url: Column, labels: list[int], depths: list[int]) -> Column:
    """What a capture may be listed by, of the shapes that are listed: its host and the domains above it, and its host with its directories."""
    path = F.regexp_extract(url, PATH, 1)
    dots, slashes = (F.length(c) - F.length(F.replace(c, F.lit(mark))) for c, mark in ((host, "."), (path, "/")))
    found = [F.when(dots + 1 >= n, F.substring_index(host, ".", -n)) for n in labels]
    # the last part is a file
    found += [F.when(slashes >= n, F.concat(host, F.lower(F.substring_index(path, "/", n)), F.lit("/"))) for n in depths]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at, ...) with host, listed, pattern and since appended (columns of these names are replaced).

    listed says whether a pattern that covers the URL was listed at fetched_at (since <= fetched_at < until). A null or
    hostless URL and a null fetched_at are not listed. Rows that repeat, ties and other columns are carried along.
    """
    captures = captures.drop("host", "listed", "pattern", "since")
    hosted = captures.withColumn("host", host_of(F.col("url")))
    # each fetch of a URL is looked up once, however many rows hold it
    asked = hosted.filter("host IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at", "host").distinct()
    listed = intervals(entries)
    keyed = asked.select("url", "fetched_at", F.explode(_keys(F.col("host"), F.col("url"), *_shapes(listed))).alias("pattern"))
    met = keyed.join(listed, "pattern").filter("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    best = met.groupBy("url", "fetched_at").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("best"))
    best = best.select("url", "fetched_at", F.lit(True).alias("listed"), "best.pattern", "best.since")
    return hosted.join(best, ["url", "fetched_at"], "left").withColumn("listed", F.coalesce("listed", F.lit(False))).select(*captures.columns, "host", "listed", "pattern", "since")


def dated_list(hosts: DataFrame) -> DataFrame:
    """A list for the test pages (host), with entries drawn by the digits of the host's MD5: hosts listed, delisted and listed again, directories, and whole domains for some days."""

    def digits(a: int, n: int) -> Column:
        return F.conv(F.substring("m", a, n), 16, 10).cast("int")

    def day(n: Column) -> Column:
        return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(n)

    def entry(dated: Column, listed: bool, given: Column) -> Column:
        return F.struct(F.col("host").alias("pattern"), dated.alias("dated"), F.lit(listed).alias("listed"), given.alias("given"))

    m = hosts.filter("host IS NOT NULL").select("host").distinct().withColumn("m", F.md5("host"))
    first = digits(2, 3) % 300
    own = m.filter(digits(1, 1) < 6).select(
        F.explode(
            F.array(
                entry(day(first), True, F.lit(True)),
                entry(day(first + 1 + digits(6, 2) % 60), False, digits(5, 1) % 2 == 0),
                entry(day(first + 120), True, digits(8, 1) < 8),
            )
        ).alias("e")
    ).select("e.*").filter("given").drop("given")
    dirs = m.filter(digits(9, 1) < 3).select(F.concat("host", F.lit("/en/")).alias("pattern"), day(digits(10, 3) % 366).alias("dated"), F.lit(True).alias("listed"))
    above = m.select(F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("host")).filter("host <> ''").distinct().withColumn("m", F.md5("host"))
    whole = above.select(F.explode(F.array(entry(day(digits(1, 3) % 366), True, F.lit(True)), entry(day(digits(1, 3) % 366 + 10), False, F.lit(True)))).alias("e")).select("e.*").drop("given")
    return own.union(dirs).union(whole)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval((F.col("page_id") * 37 % 366).cast("int"), (F.col("page_id") % 24).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    entries = dated_list(pages.select(host_of(F.col("url")).alias("host")))
    return filter_urls(pages, entries).select("page_id", "url", "fetched_at", "host", "listed", "pattern", "since")


def _digits(a: int, n: int) -> str:
    return f"('0x' || substr(m, {a}, {n}))::INT"


_DAY = "TIMESTAMP '2024-01-01 00:00:00' + to_days(({0})::INT)"
_FIRST = f"{_digits(2, 3)} % 300"

ORACLE_SQL = f"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days((page_id * 37 % 366)::INT) + to_hours((page_id % 24)::INT) AS fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.$', ''), '') AS host,
    regexp_extract(url, '{PATH}', 1) AS path
  FROM pages
), m AS (
  SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
), u AS (
  SELECT host, md5(host) AS m FROM (SELECT DISTINCT regexp_extract(host, '^[^.]+\\.(.+)$', 1) AS host FROM m) WHERE host <> ''
), e AS (
  SELECT host AS pattern, {_DAY.format(_FIRST)} AS dated, true AS listed FROM m WHERE {_digits(1, 1)} < 6
  UNION ALL SELECT host, {_DAY.format(f"{_FIRST} + 1 + {_digits(6, 2)} % 60")}, false FROM m WHERE {_digits(1, 1)} < 6 AND {_digits(5, 1)} % 2 = 0
  UNION ALL SELECT host, {_DAY.format(f"{_FIRST} + 120")}, true FROM m WHERE {_digits(1, 1)} < 6 AND {_digits(8, 1)} < 8
  UNION ALL SELECT host || '/en/', {_DAY.format(f"{_digits(10, 3)} % 366")}, true FROM m WHERE {_digits(9, 1)} < 3
  UNION ALL SELECT host, {_DAY.format(f"{_digits(1, 3)} % 366")}, true FROM u
  UNION ALL SELECT host, {_DAY.format(f"{_digits(1, 3)} % 366 + 10")}, false FROM u
), i AS (
  SELECT * FROM (SELECT pattern, dated AS since, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS until, listed
    FROM (SELECT pattern, dated, bool_or(listed) AS listed FROM e GROUP BY ALL)) WHERE listed
), j AS (
  SELECT c.*, i.pattern, i.since, row_number() OVER (PARTITION BY page_id ORDER BY length(i.pattern) DESC NULLS LAST, i.pattern DESC) AS rn
  FROM c LEFT JOIN i ON since <= fetched_at AND (until IS NULL OR fetched_at < until)
    AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND starts_with(host || lower(path), pattern)))
)
SELECT page_id, url, fetched_at, host, pattern IS NOT NULL AS listed, pattern, since FROM j WHERE rn = 1
"""
