"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by HASHES random lines cut into cells. A query visits cells in the order of the estimated probability
that a near neighbour lies there, given its own place in its cell, until the probabilities add up to a mass; that
mass is fitted so that a bounded sample of the rows is found with enough recall. What the tables' cells hold is ranked by
its exact distance. Every row is indexed, but of equal vectors only those whose ids can be among the nearest. Cells are dealt
to tasks by hash; a cell of many rows is cut into parts and its visits into blocks, so that a hot one loads no task; queries that
find too few rows are compared with all.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import stash, table
from tidemill.llm.vectors import matrices, usable
from tidemill.llm.words import tidy

TABLES, HASHES, CELL, REACH, SEED = 2, 4, 1.0, 3, 31
#: Sampled rows and queries for the fit, and the recall that it asks for on them.
SAMPLE, SAMPLE_QUERIES, RECALL = 5_000, 200, 0.97
#: Rows of a part of a cell, visits of a block of a cell, and distances that are in memory at once.
SHARE, VISITS, AT_ONCE = 8_000, 4_000, 2_000_000
#: So many split cells are broadcast, three numbers each; more are joined by a shuffle.
FEW_CELLS = 50_000

_erf = np.frompyfunc(math.erf, 1, 1)
_STEPS = np.array(list(itertools.product(range(-REACH, REACH + 1), repeat=HASHES)), np.int64)


class Hashing:
    """Tables of p-stable hashes for vectors of typical length scale, and the mass of cells that queries visit."""

    def __init__(self, scale: float = 1.0, near: float = 1.0, mass: float = 0.9, tables: int = TABLES, seed: int = SEED) -> None:
        self.scale, self.near, self.mass, self.tables, self.seed = scale, near, mass, tables, seed
        self.cell = CELL * scale

    def lines(self, t: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, t, size])
        return rng.standard_normal((size, HASHES)), rng.random(HASHES) * self.cell

    @staticmethod
    def code(cells: np.ndarray, t: int, size: int) -> np.ndarray:
        """One long for table, vector length and cells."""
        h = np.full(cells.shape[:-1], t * 1_000_003 + size, np.uint64)
        for k in range(HASHES):
            h = (h ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        a, b = self.lines(t, x.shape[1])
        return self.code(np.floor((x @ a + b) / self.cell).astype(np.int64), t, x.shape[1])

    def probes(self, q: np.ndarray, t: int, mass: float | None = None) -> Iterator[np.ndarray]:
        """For each query the cells to visit, likeliest first, until they hold mass."""
        a, b = self.lines(t, q.shape[1])
        p = q @ a + b
        base = np.floor(p / self.cell).astype(np.int64)
        low = (base[:, :, None] + np.arange(-REACH, REACH + 1)) * self.cell - p[:, :, None]
        spread = self.near * math.sqrt(2)
        chance = np.log(np.maximum((_erf((low + self.cell) / spread) - _erf(low / spread)).astype(np.float64) / 2, 1e-30))
        for i in range(len(q)):
            log = sum(chance[i, k, _STEPS[:, k] + REACH] for k in range(HASHES))
            order = np.argsort(-log, kind="stable")
            take = int(np.searchsorted(np.cumsum(np.exp(log[order])), self.mass if mass is None else mass)) + 1  # past the end: all
            yield self.code(base[i] + _STEPS[order[:take]], t, q.shape[1])

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, recall: float = RECALL) -> Hashing:
        """The least mass with which the sample's first rows find their k nearest among the others with that recall."""
        if len(sample) < 2:
            return cls()
        queries = min(SAMPLE_QUERIES, len(sample) // 2)
        q = sample[:queries]
        scale = max(1e-12, float(np.sqrt((sample**2).sum(1).mean())))
        d = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * q @ sample.T))
        d[np.arange(queries), np.arange(queries)] = np.inf
        k = min(k, len(sample) - 1)
        nearest = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = float(np.median(np.take_along_axis(d, nearest, 1)))
        self = cls(scale, max(near, 0.02 * scale), 1.0)
        # how early each neighbour's cell is visited, in the table that comes to it first
        reached = np.full((queries, k), np.inf)
        for t in range(self.tables):
            own = self.cells(sample, t)
            for i, cells in enumerate(self.probes(q, t, 2.0)):
                place = {c: n for n, c in reversed(list(enumerate(cells.tolist())))}
                share = np.array([place.get(c, -1) for c in own[nearest[i]].tolist()])
                mass = self._masses(q[i : i + 1], t)
                reached[i] = np.minimum(reached[i], np.where(share >= 0, mass[share], np.inf))
        order = np.sort(reached.ravel())
        self.mass = min(1.0, float(order[min(len(order) - 1, math.ceil(recall * len(order)))])) if np.isfinite(order[0]) else 1.0
        return self

    def _masses(self, q: np.ndarray, t: int) -> np.ndarray:
        """Mass of the cells up to each in the order of visits."""
        a, b = self.lines(t, q.shape[1])
        p = q @ a + b
        low = (np.floor(p / self.cell)[:, :, None] + np.arange(-REACH, REACH + 1)) * self.cell - p[:, :, None]
        spread = self.near * math.sqrt(2)
        chance = np.log(np.maximum((_erf((low + self.cell) / spread) - _erf(low / spread)).astype(np.float64) / 2, 1e-30))
        return np.cumsum(np.exp(np.sort(sum(chance[0, k, _STEPS[:, k] + REACH] for k in range(HASHES)))[::-1]))


def _placed(model: Hashing, probing: bool):
    """Rows (vec_id, vector) by the cells that they are in, or, probing, that they visit."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            for rows, x in matrices(vectors):
                for a in range(0, len(rows), 200):
                    for t in range(model.tables):
                        part = x[a : a + 200]
                        cells = list(model.probes(part, t)) if probing else [c.reshape(1) for c in model.cells(part, t)]
                        index = pa.array(np.repeat(rows[a : a + 200], [len(c) for c in cells]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), batch.column("vec_id").take(index), vectors.take(index)], ["cell", "vec_id", "vector"])

    return run


def _nearest(k: int):
    """Of each query of a share, its k nearest among the share's rows of the cells that it visits."""

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(index) and len(queries):
            rows = index.groupby("cell").indices
            for cell, q in queries.groupby("cell").indices.items():
                if cell not in rows:
                    continue
                x = np.array(index["vector"].iloc[rows[cell]].tolist(), np.float64)
                ids, squares = index["vec_id"].to_numpy()[rows[cell]], (x**2).sum(1)
                step = max(1, AT_ONCE // len(ids))
                enough = k + len(ids) - len(np.unique(ids))  # rows that hold k ids at least
                for some in (q[a : a + step] for a in range(0, len(q), step)):
                    y, own = np.array(queries["vector"].iloc[some].tolist(), np.float64), queries["vec_id"].to_numpy()[some]
                    rough = (y**2).sum(1)[:, None] + squares - 2 * y @ x.T
                    rough[own[:, None] == ids] = np.inf
                    if len(ids) > enough:
                        # rounding may misplace what lies closely together
                        limit = np.partition(rough, enough - 1, axis=1)[:, enough - 1 : enough]
                        i, j = np.nonzero(rough <= limit + 1e-9 * (1 + np.abs(limit)))
                    else:
                        i, j = np.nonzero(np.isfinite(rough))
                    keep = np.isfinite(rough[i, j])
                    i, j = i[keep], j[keep]
                    score = np.sqrt(((x[j] - y[i]) ** 2).sum(1))
                    # of any number of ties the first by id
                    order = np.lexsort((ids[j], score, i))
                    i, j, score = i[order], j[order], score[order]
                    first = np.arange(len(i)) - np.searchsorted(i, i) < enough
                    found.append((own[i[first]], ids[j[first]], score[first]))
        if not found:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        out = pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(v) for v in zip(*found, strict=True)), strict=True)))
        return out.drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, tables: int = TABLES) -> DataFrame:
    """The k nearest rows (vec_id, vector) of each of queries (vec_id, vector) by Euclidean distance, the query's own vec_id left out.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. Vectors that are null, zero or hold null
    or non-finite components, and null ids, take no part; only vectors of one length are compared. Rows that repeat a
    vec_id are one candidate, at its nearest. Fewer rows than k: all of them. An empty table gives an empty table.
    """
    rows, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).filter("vec_id IS NOT NULL").filter(usable("vector")) for x in (rows, queries))
    n = rows.count()
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
    picked = rows.filter(h < 1_000_000 * min(1.0, 1.2 * SAMPLE / max(n, 1))).orderBy(h, "vec_id").limit(SAMPLE).toPandas()
    size = picked["vector"].map(len).mode() if len(picked) else []
    sample = np.array([v for v in picked.sort_values("vec_id")["vector"] if len(v) == size[0]], np.float64) if len(picked) else np.empty((0, 1))
    model = Hashing.fit(np.random.default_rng(1).permutation(sample), k, recall)
    model.tables = tables
    # ties go to the smaller ids, so of equal vectors no more than k others and the query's own can be found
    equal = W.partitionBy(F.xxhash64("vector"), F.xxhash64(F.lit(SEED), "vector")).orderBy("vec_id")
    index = rows.withColumn("_nth", F.dense_rank().over(equal)).filter(F.col("_nth") <= k + 1).drop("_nth").mapInArrow(_placed(model, False), "cell long, vec_id long, vector array<double>")
    visits = queries.mapInArrow(_placed(model, True), "cell long, vec_id long, vector array<double>")
    # a cell of more rows than a share is cut into parts, one of more visits than a block into blocks, and each part meets each block
    called = stash(visits.groupBy("cell").agg(F.count("*").alias("n")), "visits")
    shares = max(1, -(-n * tables // SHARE) + (called.agg(F.sum("n")).first()[0] or 0) // (2 * VISITS))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(SHARE)).cast("int").alias("parts")).filter("parts > 1")
    blocks = called.select("cell", F.ceil(F.col("n") / F.lit(VISITS)).cast("int").alias("blocks")).filter("blocks > 1")
    cut = stash(parts.join(blocks, "cell", "full_outer").select("cell", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("blocks", F.lit(1)).alias("blocks")), "cut-cells")
    cut = F.broadcast(cut) if cut.count() <= FEW_CELLS else cut

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        found = df.join(cut, "cell", "left").withColumn(own, F.pmod(F.xxhash64("vec_id"), F.coalesce(own, F.lit(1))).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return found.select(F.pmod(F.xxhash64("cell", "parts", "blocks"), F.lit(shares)).alias("share"), F.xxhash64("cell", "parts", "blocks").alias("cell"), "vec_id", "vector")

    schema = "query_id long, vec_id long, score double"
    met = stash(dealt(index, "parts", "blocks").groupBy("share").cogroup(dealt(visits, "blocks", "parts").groupBy("share")).applyInPandas(_nearest(k), schema), "met")
    # queries that found too few are compared with every row, share by share
    enough = met.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(f"n >= {min(k, n - 1)}")
    short = queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti").select("vec_id", "vector")
    if n > 1 and not short.isEmpty():
        one = F.size("vector").cast("long").alias("cell")  # vectors of one length meet
        whole = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shares)).alias("share"), one, "vec_id", "vector")
        every = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), one, "vec_id", "vector")
        met = met.union(whole.groupBy("share").cogroup(every.groupBy("share")).applyInPandas(_nearest(k), schema))
    best = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(rows, rows.filter("vec_id % 100 = 0"))
