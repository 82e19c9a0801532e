"""Embedding near-dedup by collision-counting projections.

Vectors are projected on many directions, and each direction keeps a sorted list of the projections. A list tells most
at its ends: in its middle a window wide enough for a pair at the least cosine holds about half of all vectors, so a
vector enters only the lists of its STRONGEST directions of each set. Around each place in a sorted list, what lies
within the window collides. Pairs that collide often enough are verified by their cosine; window, number of directions
and least count are calibrated on simulated pairs at the least cosine.

Directions are sums of base lines, one of each of a set's factors, so that a set of k factors of B lines has B^k of them
for k * B dot products a vector, and lists stay short as the vectors grow.

Groups of near copies are not expanded into pairs. Where many vectors share their strongest direction, those within half
the linking angle of one of them are a ball: all its members link with each other, by the triangle inequality. A ball is
one entry of a list, and two balls that meet are settled by the angle between their centres and their radii, or, where
that leaves it open, by their members in blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import components, stash, table
from tidemill.llm.vectors import matrices, usable
from tidemill.llm.words import tidy

COSINE, MISS, SEED = 0.9, 2e-4, 23
SETS, STRONGEST = 4, 12
#: Entries that a list end would hold if directions were evenly met; lines of a factor, beyond which there is a factor more.
LIST, MOST_LINES = 4, 1_500
#: Lines of each factor, at each end, whose sums are looked at for a vector's strongest directions.
ENDS = 16
#: Simulated pairs at the least cosine.
TRIALS = 600
#: Vectors with one strongest direction from which near copies are sought among them; members of a block of a ball.
CROWD, BLOCK = 16, 256


class Directions:
    """Sets of directions for vectors of one length; set SETS gives cells, the others lists."""

    def __init__(self, size: int, lines: int, factors: int, seed: int) -> None:
        self.size, self.lines, self.factors = size, lines, factors
        rng = np.random.default_rng([seed, size, lines, factors])
        self.base, self.gram = [], []
        for _ in range(SETS + 1):
            base = [g / np.maximum(np.linalg.norm(g, axis=0), 1e-12) for g in rng.standard_normal((factors, size, lines))]
            self.base.append([g.astype(np.float32) for g in base])
            self.gram.append({(i, j): (base[i].T @ base[j]).astype(np.float32) for i, j in itertools.combinations(range(factors), 2)})

    def strongest(self, unit: np.ndarray, s: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each unit vector the codes of its strongest directions of set s, and its projections on them."""
        ends = min(ENDS, self.lines)
        values = [unit @ g for g in self.base[s]]
        grid = np.array(list(itertools.product(range(ends), repeat=self.factors)))
        codes, places = [], []
        for sign in (1, -1):
            top = [np.argpartition(-sign * v, ends - 1, axis=1)[:, :ends] for v in values]
            picked = [t[:, grid[:, k]] for k, t in enumerate(top)]
            total = sum(np.take_along_axis(v, p, 1) for v, p in zip(values, picked, strict=True))
            norm = self.factors + 2 * sum(g[picked[i], picked[j]] for (i, j), g in self.gram[s].items())
            code = np.zeros(picked[0].shape, np.int64)
            for p in picked:
                code = code * self.lines + p
            codes.append(code * 2 + (sign < 0))
            places.append(sign * total / np.sqrt(np.maximum(norm, 1e-6)))
        code, place = np.concatenate(codes, 1), np.concatenate(places, 1)
        most = min(most, place.shape[1])
        best = np.argpartition(-place, most - 1, axis=1)[:, :most]
        return np.take_along_axis(code, best, 1) + 2 * s * self.lines**self.factors, np.take_along_axis(place, best, 1)

    def entries(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.strongest(unit, s, STRONGEST) for s in range(SETS)]
        return np.concatenate([c for c, _ in parts], 1), np.concatenate([p for _, p in parts], 1)


def plan(n: int, size: int, cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> tuple[int, int, float, int]:
    """Lines of a factor, factors, window and least count for n vectors of a length.

    The lists that n vectors ask for, or fewer where pairs at the least cosine would be missed: of simulated ones, the
    square roots of their counts are taken as normal, and the least count is that below which a share of miss lies.
    """
    wanted, factors = max(2.0, STRONGEST * n / (2 * LIST)), 2
    while wanted ** (1 / factors) > MOST_LINES:
        factors += 1
    lines = max(2, math.ceil(wanted ** (1 / factors)))
    window = 2 * math.sqrt((2 - 2 * cosine) / size)
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, TRIALS, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if size > 1:
        y -= (y * x).sum(1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y, axis=1, keepdims=True)
    else:
        y = x
    while True:
        made = Directions(size, lines, factors, seed)
        (cx, px), (cy, py) = made.entries(x.astype(np.float32)), made.entries(y.astype(np.float32))
        count = np.array([((a[:, None] == b) & (abs(p[:, None] - q) <= window)).sum() for a, p, b, q in zip(cx, px, cy, py, strict=True)])
        root = np.sqrt(count)
        # the normal deviate of miss, by bisection
        low, high = 0.0, 9.0
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if 0.5 * math.erfc(middle / math.sqrt(2)) > miss else (low, middle)
        edge = root.mean() - low * root.std()
        least = int(edge * edge) if edge > 0 else 0
        if least >= 2 or lines <= 2:
            return lines, factors, window, max(1, min(least, int(count.min()) or 1))
        lines = max(2, lines * 2 // 3)


def _placed(plans: dict[int, tuple[int, int, float, int]], seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Directions] = {}
        for batch in batches:
            for rows, x in matrices(batch.column("vector")):
                size = x.shape[1]
                if size not in made:
                    made[size] = Directions(size, *plans[size][:2], seed)
                unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                for a in range(0, len(rows), 250):
                    lists, places = made[size].entries(unit[a : a + 250])
                    cell, _ = made[size].strongest(unit[a : a + 250], SETS, 1)
                    at = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1])
                    part = batch.take(pa.array(rows[a : a + 250]))
                    own = [part.column(c) for c in ("k1", "k2", "rep", "copies", "vector")]
                    key = np.int64(size) << np.int64(44)
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array((cell[:, 0] + key)), pa.ListArray.from_arrays(at, pa.array((lists + key).ravel())), pa.ListArray.from_arrays(at, pa.array(places.ravel().astype(np.float32)))],
                        ["k1", "k2", "rep", "copies", "vector", "cell", "lists", "places"],
                    )

    return run


def _walked(windows: dict[int, float]):
    """Over entries (list, low, high, ball) in order: pairs of balls within the window of each other."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4000):
                part = batch.slice(a, 4000)
                part = part if kept is None else pa.concat_batches([kept, part])
                old = 0 if kept is None else kept.num_rows
                n = part.num_rows
                lists, low, high, ball = (part.column(c).to_numpy() for c in ("list", "low", "high", "ball"))
                size = (lists >> 44).astype(np.int32)
                window = np.array([windows[s] for s in np.unique(size).tolist()])[np.searchsorted(np.unique(size), size)]
                # places of a list are sorted, so what begins within the window of an entry's end follows it without a gap
                first = np.flatnonzero(np.diff(lists, prepend=-1))
                group = np.searchsorted(first, np.arange(n), "right") - 1
                key = group * 4.0 + low
                end = np.searchsorted(key, group * 4.0 + np.minimum(high + window, 2.9), "right")
                begin = np.maximum(np.arange(n) + 1, old)  # pairs of two kept entries are out already
                count = np.maximum(end - begin, 0)
                for i, j in _runs(begin, count):
                    differ = ball[i] != ball[j]
                    i, j = i[differ], j[differ]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ball[i], ball[j])), pa.array(np.maximum(ball[i], ball[j])), pa.array(size[i])], ["a", "b", "size"])
                # an entry stays while the window of its end may reach what comes
                reach = (lists == lists[-1]) & (high + window >= low[-1])
                kept = part.filter(pa.array(reach))

    return run


def _runs(begin: np.ndarray, count: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, begin[i] + 0 ... begin[i] + count[i] - 1), about most at a time."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        yield i, np.repeat(begin[at:to], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        at = to


def _judged(cosine: float):
    """Pairs of balls with their centres va, vb and radii: 2 where all members link, 1 where members must be compared; others go."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("va")):
                y = next(v for _, v in matrices(batch.column("vb").take(pa.array(rows))))
                cos = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                apart = np.arccos(np.clip(cos, -1, 1))
                radius = sum(batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("ra", "rb"))
                limit = math.acos(cosine)
                whole = np.where(radius > 0, apart + radius <= limit - 1e-6, cos >= cosine)
                some = whole | ((radius > 0) & (apart - radius <= limit + 1e-6))
                out = batch.take(pa.array(rows[some]))
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b"), pa.array(np.where(whole[some], 2, 1).astype(np.int32))], ["a", "b", "verdict"])

    return run


def _members(cosine: float):
    """Of two blocks of members: how many vectors of the other block each links with."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            for r in range(batch.num_rows):
                a, b = batch.column("a")[r].as_py(), batch.column("b")[r].as_py()
                reps, copies, unit = {}, {}, {}
                for s in "xy":
                    m = batch.column(s)[r].values
                    reps[s], copies[s] = m.field("rep").to_numpy(), m.field("copies").to_numpy()
                    v = next(v for _, v in matrices(m.field("vector")))
                    unit[s] = v / np.sqrt((v * v).sum(1, keepdims=True))
                near = unit["x"] @ unit["y"].T >= cosine
                out += [(reps["x"], near @ copies["y"], a, b), (reps["y"], near.T @ copies["x"], a, b)]
            found = [(np.concatenate([v[k][v[1] > 0] for v in out]) if out else np.empty(0, np.int64)) for k in (0, 1)]
            ends = [np.concatenate([np.full((v[1] > 0).sum(), v[k], np.int64) for v in out]) if out else np.empty(0, np.int64) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*found, *ends)], ["rep", "others", "a", "b"])

    return run


def _cosine(x: str, y: str) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def dedup_vectors(rows: DataFrame, vector: str = "embedding", cosine: float = COSINE, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """Links between rows (vec_id, vector; other columns are ignored) with cosine >= cosine (over 0), and their classes.

    Returns one row per row: vec_id, n_links (other vec_ids linked directly), component_id (smallest vec_id reachable,
    itself included), kept (vec_id = component_id). Equal vectors are one node of the search. A vector that is null, zero,
    or holds null or non-finite components links with nothing, nor do vectors of different lengths. Rows that repeat a
    vec_id count once among links, and each comes back. A null vec_id has no links, a null component_id and is kept.
    A pair at the least cosine is missed with probability miss by calibration, nearer pairs more rarely.
    """
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector")).withColumn("ok", usable("vector") & F.col("vec_id").isNotNull())
    slim = slim.withColumn("k1", F.when(F.col("ok"), F.xxhash64("vector"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(seed), "vector")))
    sizes = slim.filter("ok").groupBy(F.size("vector").alias("size")).count().collect()
    plans = {r["size"]: plan(r["count"], r["size"], cosine, miss, seed) for r in sizes}
    classes = slim.filter("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("vector").alias("vector"))
    schema = f"k1 long, k2 long, rep long, copies long, vector {rows.schema[vector].dataType.simpleString()}, cell long, lists array<long>, places array<float>"
    placed = stash(classes.mapInArrow(_placed(plans, seed), schema), "placed")

    # near copies: within half the angle, less a hair, of the smallest of a crowd
    crowds = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("rep").alias("ball")).filter(f"n >= {CROWD}").select("cell", "ball")
    centres = crowds.join(placed.select(F.col("rep").alias("ball"), F.col("vector").alias("centre")), "ball")
    angle = F.acos(F.least(_cosine("vector", "centre"), F.lit(1.0)))
    near = placed.select("rep", "copies", "vector", "cell").join(centres, "cell").select("rep", "copies", "ball", F.when(F.col("rep") == F.col("ball"), 0.0).otherwise(angle).alias("angle"))
    near = stash(near.filter(F.col("angle") <= math.acos(cosine) / 2 - 1e-6), "near")
    balls = near.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("n"))

    entry = F.explode(F.arrays_zip("lists", "places")).alias("e")
    flat = placed.select("rep", entry).select("rep", F.col("e.lists").alias("list"), F.col("e.places").alias("place"))
    in_ball = flat.join(near.select("rep", "ball"), "rep", "left")
    alone = in_ball.filter("ball IS NULL").select("list", F.col("place").alias("low"), F.col("place").alias("high"), F.col("rep").alias("ball"))
    together = in_ball.filter("ball IS NOT NULL").groupBy("list", "ball").agg(F.min("place").alias("low"), F.max("place").alias("high")).select("list", "low", "high", "ball")
    walked = alone.union(together).repartition("list").sortWithinPartitions("list", "low", "ball").mapInArrow(_walked({s: p[2] for s, p in plans.items()}), "a long, b long, size int")
    least = F.create_map(*(F.lit(x) for s, p in plans.items() for x in (s, p[3]))) if plans else F.lit(None)
    met = walked.groupBy("a", "b", "size").agg(F.count("*").alias("met")).filter(F.col("met") >= (F.element_at(least, F.col("size")) if plans else F.lit(0)))

    ends = placed.select("rep", "copies", "vector").join(balls, F.col("rep") == F.col("ball"), "left")
    ends = ends.select("rep", "vector", F.coalesce("radius", F.lit(0.0)).alias("r"), F.coalesce("weight", "copies").alias("w"))
    a, b = (ends.select(F.col("rep").alias(s), F.col("vector").alias(f"v{s}"), F.col("r").alias(f"r{s}")) for s in "ab")
    pairs = stash(met.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "va", "vb", "ra", "rb").mapInArrow(_judged(cosine), "a long, b long, verdict int"), "pairs")

    # where the angle between centres leaves it open, members are compared in blocks
    opened = pairs.filter("verdict = 1").select("a", "b")
    member = placed.select("rep", "copies", "vector").join(near.select("rep", "ball"), "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))
    asked = opened.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    blocks = member.join(asked, "ball").join(balls.select("ball", "n"), "ball", "left")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)))).groupBy("ball", "block").agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("m"))
    x, y = (blocks.select(F.col("ball").alias(s), F.col("m").alias(t)) for s, t in ("ax", "by"))
    counted = stash(opened.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_members(cosine), "rep long, others long, a long, b long"), "members")

    whole = pairs.filter("verdict = 2").select("a", "b")
    comps = components(whole.union(counted.select("a", "b").distinct()))
    side = whole.union(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_ball = side.join(ends.select(F.col("rep").alias("b"), "w"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("w").alias("met"))
    by_rep = counted.groupBy("rep").agg(F.sum("others").alias("others"))
    found = placed.select("k1", "k2", "rep", "copies").join(near.select("rep", "ball"), "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))
    found = found.join(balls.select("ball", "weight"), "ball", "left").join(by_ball, "ball", "left").join(by_rep, "rep", "left").join(comps, F.col("ball") == F.col("node"), "left")
    links = F.coalesce("weight", "copies") - 1 + F.coalesce("met", F.lit(0)) + F.coalesce("others", F.lit(0))
    found = found.select("k1", "k2", links.alias("links"), F.coalesce("component", "ball").alias("head"))
    out = slim.select("vec_id", "ok", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("ok"), F.col("head")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_collide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, for small tables.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), r(node, seen) AS (
  SELECT a, a FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a
), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = a LEFT JOIN c ON vec_id = node
"""
