"""What records are written to."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.functions.records import document_id, sink_value
from tidemill.functions.text import metric_name, safe_filename
from tidemill.operators.dedup import keep_first
from tidemill.operators.writes import error_action


def for_sql(rows: DataFrame) -> DataFrame:
    """Nested values as JSON text, dates and times as text, the rest as it is."""
    return rows.select(*(sink_value(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema))


def csv(rows: DataFrame, path: str, fields: list[str] | None = None, delimiter: str = ",", quote: str = '"', mode: str = "append") -> None:
    """With a header; null is empty; quotes only where they are needed, doubled inside them, as other readers of CSV expect. Columns are those of fields, or all."""
    flat = for_sql(rows.select(*fields) if fields else rows)
    flat.write.mode(mode).csv(path, header=True, sep=delimiter, quote=quote, escape=quote, nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(rows: DataFrame, path: str, crawl_time: str | None = None, spider: str | None = None, mode: str = "append") -> None:
    extra = {} if crawl_time is None else {"_crawl_time": F.lit(crawl_time)}
    extra |= {} if spider is None else {"_spider_name": F.lit(spider)}
    (rows.withColumns(extra) if extra else rows).write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_array(rows: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """One JSON array in each file: the records of a partition between brackets, joined as the task writes them, none held together. single: one file, which one task writes."""
    text = (rows.coalesce(1) if single else rows).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for part in batches:
            lines = []
            for x in part["value"]:
                lines.append(before + x)
                before = ","
            yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if before == "[" else "]"]})

    text.mapInPandas(run, "value string").write.mode(mode).text(path)


def console(rows: DataFrame, n: int = 20) -> None:
    rows.show(n, truncate=False)


def jdbc(rows: DataFrame, url: str, table: str, batch: int = 100, mode: str = "append", **options: str) -> None:
    for_sql(rows).write.mode(mode).format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def statement(dialect: str, table: str, columns: list[str], key: list[str] = (), update: list[str] = (), mode: str = "insert") -> str:
    """A parameterised write for one row in a dialect: mysql, postgresql, sqlite or clickhouse; mode insert, replace, ignore or upsert."""
    q, mark = {"mysql": ("`", "%s"), "postgresql": ('"', "%s"), "sqlite": ('"', "?"), "clickhouse": ("`", "%s")}[dialect]
    names = [f"{q}{c}{q}" for c in columns]
    body = f"INTO {q}{table}{q} ({', '.join(names)}) VALUES ({', '.join([mark] * len(columns))})"
    changed = update or [c for c in columns if c not in key]
    if mode == "insert" or dialect == "clickhouse":
        return f"INSERT {body}"
    if dialect == "postgresql":
        if mode == "ignore":
            return f"INSERT {body} ON CONFLICT DO NOTHING"
        if not key:
            raise ValueError("a conflict needs columns")
        return f"INSERT {body} ON CONFLICT ({', '.join(q + k + q for k in key)}) DO UPDATE SET " + ", ".join(f"{q}{c}{q} = EXCLUDED.{q}{c}{q}" for c in changed)
    if dialect == "mysql":
        if mode == "upsert":
            return f"INSERT {body} AS `new` ON DUPLICATE KEY UPDATE " + ", ".join(f"`{c}` = `new`.`{c}`" for c in changed)
        return f"REPLACE {body}" if mode == "replace" else f"INSERT IGNORE {body}"
    if mode == "upsert":
        return f"INSERT {body} ON CONFLICT ({', '.join(q + k + q for k in key)}) DO UPDATE SET " + ", ".join(f"{q}{c}{q} = excluded.{q}{c}{q}" for c in changed)
    return f"INSERT OR {'REPLACE' if mode == 'replace' else 'IGNORE'} {body}"


Rows = list[dict[str, object]]


def rows_to(
    rows: DataFrame, connect: Callable[[], object], sql: str, dead_letters: str, batch: int = 100, tries: int = 3, wait: float = 1.0, give_up: int = 10, before: Callable[[Rows], Rows] | None = None,
    after: Callable[[Rows], None] | None = None,
) -> DataFrame:
    """Writes rows by a DB-API statement from the tasks; connect opens a connection in the task, and again when an error that may pass has closed it.

    A batch whose error may pass (error_action) is tried again, after wait seconds more each time; one that fails goes row
    by row. Rows that fail are not lost: they are added to the table at dead_letters with _action (skip, retry or fatal) and
    _error, in a folder of this write, and this write's come back as a DataFrame. After give_up batches in a row of which no row went in, the task fails. before gets
    each batch as dicts and returns what is to be written, after gets what was written. A task that Spark repeats writes
    its rows again, as with any sink of this kind.
    """
    flat = for_sql(rows)
    columns = flat.columns
    schema = T.StructType([*flat.schema, T.StructField("_action", T.StringType()), T.StructField("_error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, empty = Link(connect), 0
        try:
            for part in batches:
                for at in range(0, part.num_rows, batch):
                    held = part.slice(at, batch).to_pylist()
                    held = before(held) if before else held
                    sent, failed = _send(link, sql, columns, held, tries, wait)
                    if after and sent:
                        after(sent)
                    empty = 0 if sent or not held else empty + 1
                    if empty >= give_up:
                        raise RuntimeError(f"{give_up} batches in a row failed: {failed[-1]['_error']}")
                    if failed:
                        yield pa.RecordBatch.from_pylist(failed, to_arrow_schema(schema))
        finally:
            link.drop()

    own = f"{dead_letters.rstrip('/')}/write={uuid.uuid4().hex}"
    flat.mapInArrow(run, schema).write.parquet(own)
    return rows.sparkSession.read.schema(schema).parquet(own)


class Link:
    """A connection that is opened when it is needed, and opened anew after it was dropped."""

    def __init__(self, connect: Callable[[], object]) -> None:
        self.connect, self.open = connect, None

    def cursor(self) -> object:
        if self.open is None:
            self.open = self.connect()
        return self.open.cursor()

    def execute(self, sql: str, values: object, many: bool = False) -> None:
        cursor = self.cursor()
        (cursor.executemany if many else cursor.execute)(sql, values)
        self.open.commit()

    def rollback(self) -> None:
        """Takes back what is not committed; a connection that can't is dropped."""
        try:
            self.open.rollback()
        except Exception:  # noqa: BLE001 - the connection is gone, and with it what was not committed
            self.drop()

    def drop(self) -> None:
        try:
            if self.open is not None:
                self.open.close()
        except Exception:  # noqa: BLE001 - it is gone
            pass
        self.open = None


def action(error: Exception) -> str:
    code = error.args[0] if error.args and isinstance(error.args[0], int) else None
    return error_action(code) if code is not None else "skip"


def _send(link: Link, sql: str, columns: list[str], held: Rows, tries: int, wait: float) -> tuple[Rows, Rows]:
    """What was written, and what was not with _action and _error."""
    if not hasattr(link, "drop"):  # a connection that is open
        given, link = link, Link(lambda: given)
    values = [tuple(r[c] for c in columns) for r in held]

    def tried(sql: str, value: object, many: bool) -> Exception | None:
        """None once it is written, else the last error."""
        for n in range(tries):
            try:
                return link.execute(sql, value, many)
            except Exception as error:  # noqa: BLE001 - drivers have their own classes
                last = error
                link.rollback()
                if action(error) != "retry":
                    break
                link.drop()
                time.sleep(wait * (n + 1))
        return last

    if tried(sql, values, True) is None:
        return held, []
    sent, failed = [], []
    for row, value in zip(held, values, strict=True):
        error = tried(sql, value, False)
        if error is None:
            sent.append(row)
        else:
            failed.append({c: row[c] for c in columns} | {"_action": action(error), "_error": str(error)})
    return sent, failed


def documents(rows: DataFrame, order: list[str] = (), given_id: str | None = None) -> DataFrame:
    """_id and the columns: the id given, or the MD5 of the record; of records with one id the last by order."""
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    named = rows.withColumn("_id", F.col(given_id).cast("string") if given_id else document_id(record))
    return keep_first(named, ["_id"], list(order) or sorted(rows.columns)[:1], last=True).select("_id", *rows.columns)


def cells(rows: DataFrame, family: str = "cf") -> DataFrame:
    """A record as cells: rowkey, column family:name, and the value as text, '' for null."""
    keyed = documents(rows)
    names = [c for c in keyed.columns if c != "_id"]
    return keyed.select(F.col("_id").alias("rowkey"), F.explode(F.array(*(F.struct(F.lit(f"{family}:{c}").alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in names))).alias("cell")).select("rowkey", "cell.*")


def request_log(rows: DataFrame, path: str, rows_a_file: int = 50_000) -> None:
    rows.write.mode("append").option("maxRecordsPerFile", rows_a_file).json(path)


def run_stats(stats: DataFrame, path: str) -> None:
    """One folder a spider."""
    stats.write.mode("append").partitionBy("spider").json(path)


def exposition(stats: DataFrame, prefix: str = "app") -> DataFrame:
    """Lines of a text exposition from stats (key, value, kind counter or gauge): a TYPE line and a sample for each name."""
    named = stats.groupBy(metric_name(F.col("key"), prefix).alias("name"), "kind").agg(F.sum("value").alias("value"))
    return named.select(F.explode(F.array(F.concat_ws(" ", F.lit("# TYPE"), "name", "kind"), F.concat_ws(" ", "name", F.col("value").cast("string")))).alias("line"))


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows, of which the rows and metrics (aggregates) are taken on the way, by whatever action runs first; no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())), seen


def observed_stats(spark: SparkSession, seen: Observation, kinds: dict[str, str] | None = None) -> DataFrame:
    """key, value and kind (of kinds, or gauge; rows are a counter) of what was observed, as exposition() takes them; null values are left out."""
    known = {"rows": "counter"} | (kinds or {})
    found = [(k, float(v), known.get(k, "gauge")) for k, v in seen.get.items() if v is not None]
    return spark.createDataFrame(found, "key string, value double, kind string")


def save_checkpoint(path: str, requests: DataFrame, fingerprints: DataFrame, stats: DataFrame) -> None:
    """Replaces the three tables of a saved run."""
    for name, rows in (("requests", requests), ("fingerprints", fingerprints), ("stats", stats)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def enqueue(frontier: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The frontier with new requests, of one key the last."""
    return frontier.join(new.select(key), key, "left_anti").unionByName(keep_first(new, [key], ["seq"], last=True).select(*frontier.columns))


def blob_names(names: DataFrame) -> DataFrame:
    """names (_name, _print) with final, which differs for each row: of equal names the later ones by _print get a number before the extension, and the print too where a name of that number is there already.

    A hot name's rows are numbered in 256 parts by their print, each after those of the parts before it.
    """
    part = F.substring("_print", 1, 2)
    each = names.select("_name", "_print").distinct().withColumn("_part", part)
    parts = each.groupBy("_name", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_name").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("_name", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(W.partitionBy("_name", "_part").orderBy("_print")) - 1
    placed = each.withColumn("_nth", nth).join(starts, ["_name", "_part"]).withColumn("_nth", F.col("_nth") + F.col("_start"))
    ext = F.regexp_extract("_name", r"(\.[^.]*)$", 1)
    stem = F.substring("_name", F.lit(1), F.length("_name") - F.length(ext))
    given = placed.withColumn("final", F.when(F.col("_nth") > 0, F.concat(stem, F.lit("_"), F.col("_nth").cast("string"), ext)).otherwise(F.col("_name")))
    taken = parts.select(F.col("_name").alias("final")).distinct().withColumn("_taken", F.lit(True))
    clear = F.when(F.col("_taken") & (F.col("_nth") > 0), F.concat(stem, F.lit("_"), F.col("_nth").cast("string"), F.lit("_"), F.col("_print"), ext)).otherwise(F.col("final"))
    return given.join(taken, "final", "left").select("_name", "_print", clear.alias("final"))


def blobs(rows: DataFrame, name: str, body: str, path: str) -> None:
    """Binary values to Parquet with safe, distinct names (blob_names), the safe name that was asked for, and body; equal values of one name are one file. Names are made without the values, which then join them."""
    safe = rows.select(safe_filename(F.col(name)).alias("_name"), F.sha2(F.col(body), 256).alias("_print"), F.col(body).cast(T.BinaryType()).alias("body"))
    named = safe.withColumn("_print", F.coalesce("_print", F.lit(""))).withColumn("_name", F.coalesce("_name", F.lit("")))
    once = named.join(blob_names(named), ["_name", "_print"]).dropDuplicates(["_name", "_print"])
    once.select(F.col("final").alias("name"), F.col("_name").alias("asked"), "body").write.mode("append").parquet(path)
