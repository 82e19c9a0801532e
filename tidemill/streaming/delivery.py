"""Rows of a stream delivered once, the bad ones set aside one by one.

A micro-batch is cut into slices that are the same whenever the batch is repeated. A slice that is refused is halved until single rows are, so that
only those become dead letters. Each slice has a token; a target that remembers the tokens of what it took, in the transaction that
takes it, takes nothing twice, though a batch be repeated after a failure between its write and the stream's commit.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.sources.sinks import Link, action, for_sql

#: send(rows, token) takes all rows or raises
Send = Callable[[list[dict], str], None]


def halved(rows: list[dict], token: str, send: Send) -> list[tuple[dict, str]]:
    """Sends rows; what is refused is sent in halves. The rows refused by themselves, with the error."""
    waiting, refused = [(rows, token)], []
    while waiting:
        part, name = waiting.pop()
        try:
            send(part, name)
        except Exception as error:  # noqa: BLE001 - targets have their own classes
            if len(part) == 1:
                refused.append((part[0], f"{type(error).__name__}: {error}"))
            else:
                middle = len(part) // 2
                waiting += [(part[middle:], f"{name}1"), (part[:middle], f"{name}0")]
    return refused


def delivered(rows: DataFrame, open_send: Callable[[], Send], name: str, size: int = 100) -> DataFrame:
    """rows with _error, null for those that were taken. open_send is called once a task. name begins all tokens.

    Rows are dealt to slices by a hash of their values, which does not depend on partitions; a slice is size rows in the order of that hash.
    """
    n = max(1, rows.count() // size)
    digest = F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    dealt = rows.withColumn("_print", digest).withColumn("_slice", F.pmod("_print", F.lit(n)))
    schema = T.StructType([*rows.schema, T.StructField("_error", T.StringType())])
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = open_send()
        held, at, nth = [], None, 0

        def flush() -> pa.RecordBatch:
            bad = {id(r): error for r, error in halved(held, f"{name}/{at}.{nth}/", send)}
            return pa.RecordBatch.from_pylist([r | {"_error": bad.get(id(r))} for r in held], to_arrow_schema(schema))

        for b in batches:
            places = b.column("_slice").to_pylist()
            for place, row in zip(places, b.select(columns).to_pylist(), strict=True):
                if held and (place != at or len(held) == size):
                    yield flush()
                    nth = nth + 1 if place == at else 0
                    held = []
                elif place != at:
                    nth = 0
                at = place
                held.append(row)
        if held:
            yield flush()

    return dealt.repartition("_slice").sortWithinPartitions("_slice", "_print").mapInArrow(run, schema)


def delivery(open_send: Callable[[], Send], path: str, name: str = "stream", size: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that delivers each batch and keeps at path, in a folder of the batch, its rows with their _error; a repeated batch replaces its folder."""

    def run(batch: DataFrame, number: int) -> None:
        delivered(batch, open_send, f"{name}/{number}", size).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def letters(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches at path that were refused."""
    return spark.read.parquet(path).filter("_error IS NOT NULL")


def redeliver(spark: SparkSession, path: str, into: str, open_send: Callable[[], Send], attempt: int, mend: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sends the dead letters at path again, after mend; what is refused again is at into, and comes back."""
    again = letters(spark, path).drop("_error", "batch")
    delivered(mend(again) if mend else again, open_send, f"again/{attempt}").write.mode("overwrite").parquet(f"{into}/batch={attempt}")
    return letters(spark, into)


def sql_send(connect: Callable[[], object], sql: str, columns: list[str], ledger: str = "deliveries", mark: str = "?", tries: int = 3, wait: float = 1.0) -> Callable[[], Send]:
    """A send by a DB-API statement, for open_send. The token goes into the table ledger (token, unique) in the same transaction, and rows of a token that is there are not sent again.

    An error that may pass is tried again on a new connection.
    """

    def open_send() -> Send:
        link = Link(connect)

        def once(rows: list[dict], token: str) -> None:
            cursor = link.cursor()
            cursor.execute(f"SELECT 1 FROM {ledger} WHERE token = {mark}", (token,))
            if cursor.fetchone() is None:
                cursor.executemany(sql, [tuple(r[c] for c in columns) for r in rows])
                cursor.execute(f"INSERT INTO {ledger} (token) VALUES ({mark})", (token,))
            link.open.commit()

        def send(rows: list[dict], token: str) -> None:
            for n in range(tries):
                try:
                    return once(rows, token)
                except Exception as error:
                    link.rollback()
                    if action(error) != "retry" or n == tries - 1:
                        raise
                    link.drop()
                    time.sleep(wait * (n + 1))

        return send

    return open_send


def upsert_staged(rows: DataFrame, connect: Callable[[], object], table: str, key: list[str], number: int, ledger: str = "deliveries", mark: str = "?", batch: int = 1000) -> bool:
    """Merges rows into a table by key, all or none, and once for a batch number. False if the batch is in already.

    Tasks fill a staging table, each replacing what an earlier try of it left; the rows of a key must not differ. Then one
    transaction merges the staging table and notes the batch. Statements are those that SQLite and PostgreSQL share.
    """
    flat = for_sql(rows)
    columns, token, stage = flat.columns, f"merge/{table}/{number}", f"{table}_stage_{number}"
    link = Link(connect)
    try:
        cursor = link.cursor()
        cursor.execute(f"SELECT 1 FROM {ledger} WHERE token = {mark}", (token,))
        if cursor.fetchone() is not None:
            return False
        cursor.execute(f"DROP TABLE IF EXISTS {stage}")
        cursor.execute(f"CREATE TABLE {stage} AS SELECT {', '.join(columns)}, 0 AS part_ FROM {table} WHERE 1 = 0")
        link.open.commit()
        link.drop()
        numbered = flat.withColumn("part_", F.spark_partition_id())

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, cleared = Link(connect), False
            try:
                for b in batches:
                    for at in range(0, b.num_rows, batch):
                        held = b.slice(at, batch).to_pylist()
                        if not cleared:
                            own.cursor().execute(f"DELETE FROM {stage} WHERE part_ = {mark}", (held[0]["part_"],))
                            cleared = True
                        own.cursor().executemany(f"INSERT INTO {stage} ({', '.join(columns)}, part_) VALUES ({', '.join([mark] * (len(columns) + 1))})", [tuple(r[c] for c in (*columns, "part_")) for r in held])
                if cleared:
                    own.open.commit()  # a task's rows, all at once
            finally:
                own.drop()
            yield pa.RecordBatch.from_pylist([], pa.schema([("n", pa.int64())]))

        numbered.mapInArrow(fill, "n long").write.format("noop").mode("overwrite").save()
        rest = [c for c in columns if c not in key]
        change = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "NOTHING"
        cursor = link.cursor()
        cursor.execute(f"INSERT INTO {table} ({', '.join(columns)}) SELECT DISTINCT {', '.join(columns)} FROM {stage} WHERE 1 = 1 ON CONFLICT ({', '.join(key)}) DO {change}")
        cursor.execute(f"INSERT INTO {ledger} (token) VALUES ({mark})", (token,))
        link.open.commit()
        cursor.execute(f"DROP TABLE {stage}")
        link.open.commit()
        return True
    except Exception:
        link.rollback()
        raise
    finally:
        link.drop()
