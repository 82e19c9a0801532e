"""What records are read from: pages, queues, dead letters, runs, checkpoints, SQL tables, curl commands."""

from __future__ import annotations

import json
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRONTIER = "key string, url string, method string, body string, priority int, seq long, enqueued_at timestamp_ntz, depth int, processed boolean"


def start_requests(spark: SparkSession, urls: list[str], priority: int = 0) -> DataFrame:
    """url, priority (stored negated: smaller is sooner), depth 0 and dont_filter false, in order."""
    rows = [(i, u, -priority, 0, False) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "seq long, url string, priority int, depth int, dont_filter boolean")


def text_response(url: str, text: str, status: int = 200, encoding: str = "utf-8") -> Column:
    """A response struct from a text."""
    return F.struct(F.lit(url).alias("url"), F.lit(status).alias("status"), F.lit(bytearray(text.encode(encoding))).alias("body"), F.lit(encoding).alias("encoding"))


def json_response(url: str, value: object, status: int = 200) -> Column:
    return text_response(url, json.dumps(value, ensure_ascii=False), status)


def queue(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The next n unprocessed rows by priority and time, and the queue with them marked."""
    taken = rows.filter("NOT processed").orderBy("priority", "enqueued_at", "key").limit(n)
    marks = taken.select("key", F.lit(True).alias("_taken"))
    left = rows.join(marks, "key", "left").withColumn("processed", F.col("processed") | F.coalesce("_taken", F.lit(False))).select(*rows.columns)
    return taken, left


def fetch_all(spark: SparkSession, sql: str, args: dict | None = None, limit: int | None = None) -> DataFrame:
    """A query's rows, limited unless its text has a LIMIT."""
    found = spark.sql(sql, args=args or {})
    return found.limit(limit) if limit is not None and "LIMIT" not in sql.upper() else found


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table over JDBC, read in ranges of a column if one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()


def runs(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Statistics of runs from JSON files, with the time of each file, the newest first. A record a line, as the sink writes them, or with whole one record a file."""
    return spark.read.schema(schema).json(path, multiLine=whole).withColumn("modified", F.col("_metadata.file_modification_time")).orderBy(F.desc("modified"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """One fingerprint a line, stripped; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("fp")).filter("fp <> ''").distinct()


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retry_dead(letters: DataFrame, frontier: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n oldest letters back in the frontier, and the letters that are left."""
    again = letters.orderBy("failed_at", "key").limit(n)
    back = again.select(*(F.col(c) if c in letters.columns else F.lit(None).cast(t).alias(c) for c, t in frontier.dtypes)).withColumn("processed", F.lit(False))
    return frontier.unionByName(back.select(*frontier.columns)), letters.join(again.select("key"), "key", "left_anti")


def load_checkpoint(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Requests by priority, fingerprints and statistics of a saved run."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("requests", "fingerprints", "stats")}
    tables["requests"] = tables["requests"].orderBy("priority", "seq")
    return tables


# Curl options that take a value and say nothing about the request's content.
_SKIP = {"-o", "--output", "-m", "--max-time", "--connect-timeout", "-x", "--proxy", "--retry", "-w", "--write-out", "-T", "--cacert", "--cert", "--key"}
CURL = "struct<method:string,url:string,headers:map<string,string>,cookies:map<string,string>,body:string>"


def _curl(command: str) -> dict | None:
    """Method, URL, headers, cookies and body of a curl command; None for what is none."""
    try:
        words = shlex.split(command.replace("\\\n", " "))
    except ValueError:
        return None
    if not words or words[0] != "curl":
        return None
    out = {"method": None, "url": None, "headers": {}, "cookies": {}, "body": None}
    body: list[str] = []
    as_query = False
    it = iter(words[1:])
    for w in it:
        name, _, joined = w.partition("=") if w.startswith("--") else (w, "", "")
        value = lambda: joined or next(it, "")  # noqa: B023, E731
        if name in ("-X", "--request"):
            out["method"] = value().upper()
        elif name in ("-H", "--header"):
            k, _, v = value().partition(":")
            if k.strip().lower() == "cookie":
                out["cookies"] |= dict(p.strip().split("=", 1) for p in v.split(";") if "=" in p)
            else:
                out["headers"][k.strip()] = v.strip()
        elif name in ("-b", "--cookie"):
            out["cookies"] |= dict(p.strip().split("=", 1) for p in value().split(";") if "=" in p)
        elif name in ("-d", "--data", "--data-raw", "--data-binary", "--data-ascii", "--data-urlencode", "--json"):
            body.append(value())
            if name == "--json":
                out["headers"].setdefault("Content-Type", "application/json")
        elif name in ("-A", "--user-agent"):
            out["headers"]["User-Agent"] = value()
        elif name in ("-e", "--referer"):
            out["headers"]["Referer"] = value()
        elif name in ("-I", "--head"):
            out["method"] = "HEAD"
        elif name in ("-G", "--get"):
            as_query = True
        elif name == "--url":
            out["url"] = value()
        elif name in _SKIP:
            value()
        elif not w.startswith("-") and out["url"] is None:
            out["url"] = w
    text = "&".join(body) if body else None
    if text is not None and as_query and out["url"]:
        out["url"] += ("&" if "?" in out["url"] else "?") + text
        text = None
    out["body"] = text
    out["method"] = out["method"] or ("POST" if text is not None else "GET")
    return out


@F.pandas_udf(T.StringType())
def _curl_json(command: pd.Series) -> pd.Series:
    return command.map(lambda c: None if c is None or (found := _curl(c)) is None else json.dumps(found))


def parse_curl(command: Column) -> Column:
    """A curl command as a struct of method, url, headers, cookies and body."""
    return F.from_json(_curl_json(command), CURL)
