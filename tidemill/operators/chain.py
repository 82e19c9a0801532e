"""Chains of transforms by priority, routing of mixed output, and a registry of named parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Transform = Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]
FIRST_OF_LIST = 500


@dataclass
class Chain:
    """Transforms in ascending priority. One may give back (kept, discarded); discarded rows skip the rest and are gathered with its name."""

    steps: list[tuple[int, str, Transform]] = field(default_factory=list)

    @classmethod
    def of(cls, steps: dict[str, tuple[int, Transform]] | list[tuple[str, Transform]], dedup: str | None = None) -> Chain:
        """Steps with priorities, or a list, whose first has 500 and each next one more. The step named dedup comes first."""
        found = [(p, n, f) for n, (p, f) in steps.items()] if isinstance(steps, dict) else [(FIRST_OF_LIST + i, n, f) for i, (n, f) in enumerate(steps)]
        return cls(sorted(((1 if n == dedup else p, n, f) for p, n, f in found), key=lambda s: s[0]))

    def run(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        discarded = None
        for _, name, step in self.steps:
            out = step(rows)
            if out is None:
                raise ValueError(f"{name} gave nothing back")
            rows, gone = out if isinstance(out, tuple) else (out, None)
            if gone is not None:
                gone = gone.withColumn("_discarded_by", F.lit(name))
                discarded = gone if discarded is None else discarded.unionByName(gone, allowMissingColumns=True)
        return rows, discarded

    def reversed(self) -> Chain:
        """For what comes back: the last step first."""
        return Chain(self.steps[::-1])


def route(output: DataFrame, kind: str = "kind") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a tagged union: requests, items, and what is neither."""
    return output.filter(F.col(kind) == "request"), output.filter(F.col(kind) == "item"), output.filter(~F.coalesce(F.col(kind).isin("request", "item"), F.lit(False)))


class Registry:
    """Transforms by kind and name."""

    def __init__(self) -> None:
        self._parts: dict[tuple[str, str], Transform] = {}

    def register(self, kind: str, name: str, part: Transform) -> None:
        if (kind, name) in self._parts:
            raise ValueError(f"{kind} {name} is registered already")
        self._parts[kind, name] = part

    def resolve(self, kind: str, name: str) -> Transform:
        return self._parts[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._parts if k == kind)


def map_or_null(rows: DataFrame, call: Callable[[list[dict]], list], name: str, kind: T.DataType, batch: int = 100) -> DataFrame:
    """rows with name appended: what call makes of each batch of rows (as dicts), one value a row. If call fails for a batch it is called row by row, and a row that fails has null, but stays."""
    schema = T.StructType([*rows.schema, T.StructField(name, kind)])
    arrow = to_arrow_type(kind)

    def one(row: dict) -> object:
        try:
            return call([row])[0]
        except Exception:  # noqa: BLE001 - whatever a caller's function raises
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                held = piece.to_pylist()
                try:
                    made = call(held)
                    if len(made) != len(held):
                        raise ValueError("one value a row")
                except Exception:  # noqa: BLE001
                    made = [one(row) for row in held]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(made, arrow)], [*part.schema.names, name])

    return rows.mapInArrow(run, schema)
