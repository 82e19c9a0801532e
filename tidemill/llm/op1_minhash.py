"""MinHash near-dedup with an LSH forest.

Every distinct text gets TREES labels of DEPTH minhash values. Each tree sorts the texts by label; candidates of a text
are its neighbours in that order with the longest common prefixes. Where few texts share the least prefix of
MIN_DEPTH values, all of them are neighbours; in a dense region a text's NEAR neighbours share longer prefixes, so
the depth adapts by region. What a dense region leaves out is settled exactly (see _rest). The order is cut into ranges
of even size wherever they fall; what lies at their borders meets in a second, small pass. Candidates are confirmed
on full shingle sets. Work on copies is saved before and after: texts whose sets have one 128-bit digest are taken for
equal and are one node of the graph, and pairs inside a component that is already connected need no confirmation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ROWS_A_FILE, joined, only, roots, stash, table, text_batches
from tidemill.llm.words import chunks, mix, tidy, words

TREES, MIN_DEPTH, DEPTH, NEAR, SKETCH = 28, 6, 8, 6, 128
SEED = 77
#: Texts of a block in which dense regions are settled, and how far texts of small regions move to larger ones to share blocks.
BLOCK, HOPS = 256, 2


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin. A text of fewer words is one shingle; one without words has none."""
    h, at = words(data, offsets)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = at[:-1][doc] + np.arange(to[-1]) - to[:-1][doc]
    value = np.full(len(doc), 0x51ED270B, np.uint64)
    have = np.minimum(n, width)[doc]
    for k in range(width):
        more = have > k
        word = h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else h
        value = np.where(more, mix(value * np.uint64(0x9E3779B97F4A7C15) + word), value)
    parts = [np.unique(value[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]
    size = np.array([len(p) for p in parts])
    return np.concatenate([*parts, np.empty(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)])


def _digest(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set (0 for an empty one)."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x1234567, 0x89ABCDEF0)]
    return tuple((t[at[1:]] - t[at[:-1]]).view(np.int64) for t in total)


def _signed(width: int, trees: int, depth: int, seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = trees * depth
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, k, dtype=np.uint64)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                values, at = shingles(data, offsets, width)
                size = np.diff(at)
                full = np.flatnonzero(size)
                sig = np.zeros((hi - lo, k), ">u4")  # labels take the lower halves: the upper ones of minima are mostly 0
                for i in range(k) if len(full) else ():
                    sig[full, i] = np.minimum.reduceat(((values ^ b[i]) * a[i]) >> np.uint64(32), at[:-1][full])
                bits = (sig[:, np.linspace(0, k - 1, SKETCH).astype(int)] & 1).astype(np.uint8)  # the low bits of values spread over all trees
                fp = _digest(values, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[lo:hi],
                        pa.array(size.astype(np.int64)),
                        pa.array(fp[0]),
                        pa.array(fp[1]),
                        pa.array([x.tobytes() for x in (sig & 0xFFFF).astype(">u2")], pa.binary()),
                        pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sig", "sketch"],
                )

    return run


def _labels(trees: int, depth: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, trees, 2 * depth)
                bits = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.int64).reshape(-1, 2)
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t, np.int32)), pa.array([x.tobytes() for x in sig[:, t]], pa.binary()), part.column("doc_id"), part.column("n_shingles"), pa.array(bits[:, 0]), pa.array(bits[:, 1])],
                        ["tree", "label", "doc_id", "n", "s1", "s2"],
                    )

    return run


MET = ["a", "b", "same", "dense", "tree", "head", "label", "n", "s1", "s2"]


def _neighbours(min_depth: int, near: int, floor: int, percent: int):
    """Over labels in order: pairs of near neighbours that share min_depth values, whose sizes allow percent, and whose sketches agree in floor bits; dense marks the texts (a = b) of a region that reaches beyond its texts' neighbours, some more than once. The first and last rows come as they are, with b null."""

    def border(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = lambda kind: pa.nulls(rows.num_rows, kind)
        cols = [rows.column("doc_id"), none(pa.int64()), none(pa.int32()), pa.array(np.full(rows.num_rows, False)), rows.column("tree"), none(pa.binary()), *(rows.column(c) for c in ("label", "n", "s1", "s2"))]
        return pa.RecordBatch.from_arrays(cols, MET)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, left = None, near + 1
        for batch in batches:
            if left:
                yield border(batch.slice(0, left))
                left -= min(left, batch.num_rows)
            part = batch if kept is None else pa.concat_batches([kept, batch])
            old = 0 if kept is None else kept.num_rows
            n = part.num_rows
            ids, tree = part.column("doc_id").to_numpy(), part.column("tree").to_numpy()
            label = np.frombuffer(b"".join(part.column("label").to_pylist()), np.uint8).reshape(n, -1)
            sketch = np.stack([part.column("s1").to_numpy(), part.column("s2").to_numpy()], 1).view(np.uint64)
            size = part.column("n").to_numpy()
            head = np.ascontiguousarray(label[:, : 2 * min_depth])
            # in order, so texts share the least prefix exactly if no text between them begins another
            new = np.ones(n, bool)
            new[1:] = (head[1:] != head[:-1]).any(1) | (tree[1:] != tree[:-1])
            region = np.cumsum(new)
            out = []
            for step in range(1, near + 1):
                x = np.flatnonzero(region[step:] == region[:-step])
                x = x[x + step >= old]
                same = np.bitwise_count(~(sketch[x] ^ sketch[x + step])).sum(1).astype(np.int32)
                small, large = np.minimum(size[x], size[x + step]), np.maximum(size[x], size[x + step])
                good = (same >= floor) & (100 * small >= percent * large)
                out.append((x[good], x[good] + step, same[good], np.full(good.sum(), False)))
            # near + 2 texts of one region in a row
            x = np.flatnonzero(region[near + 1 :] == region[: -near - 1])
            x = x[x + near + 1 >= old]
            runs = np.zeros(n + 1, np.int64)
            runs[x] += 1
            runs[x + near + 2] -= 1
            x = np.flatnonzero(np.cumsum(runs[:-1]))
            out.append((x, x, np.zeros(len(x), np.int32), np.full(len(x), True)))
            x, y, same, dense = (np.concatenate(v) for v in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.minimum(ids[x], ids[y])),
                    pa.array(np.maximum(ids[x], ids[y])),
                    pa.array(same),
                    pa.array(dense),
                    pa.array(np.where(dense, tree[x], -1)),
                    pa.array([head[i].tobytes() if d else None for i, d in zip(x, dense, strict=True)], pa.binary()),
                    *(pa.nulls(len(x), kind) for kind in (pa.binary(), pa.int64(), pa.int64(), pa.int64())),
                ],
                MET,
            )
            kept = part.slice(max(0, n - near - 1))
        if kept is not None:
            yield border(kept)

    return run


def _sets(width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                values, at = shingles(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], lists], ["doc_id", "grams"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ...) whose full sets have 100 * intersection >= percent * union; where a doc_id has several texts, those of any."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * (F.size("ga") + F.size("gb") - both)).select(*pairs.columns).distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components so far, with these (ca, cb)."""
    left, right = (comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")).hint("merge") for x in "ab")
    placed = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left")
    return placed.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")


def _met(percent: int):
    """Components that link within a pair of blocks (rows: doc_id, c, side, grams)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if (part["side"] < 2).any():
            left, right = part[part["side"] == 0], part[part["side"] == 1]
        else:
            left = right = part  # a block with itself
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        size = np.array([len(g) for g in right["grams"]])
        grams = np.concatenate(right["grams"].to_list())
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], np.repeat(np.arange(len(right)), size)[order]
        comp = right["c"].to_numpy()
        out = set()
        for c, own in zip(left["c"], left["grams"], strict=True):
            low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(right))
            hit = np.flatnonzero((100 * both >= percent * (len(own) + size - both)) & (comp != c))
            out |= {(c, x) for x in np.unique(comp[hit]).tolist()}
        return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64") if out else empty

    return run


def _rest(dense: DataFrame, comps: DataFrame, sets_of, percent: int) -> DataFrame:
    """Exact links (a, b) between the components of regions that are denser than their texts' neighbours reach; dense: their texts (tree, head, a), some more than once.

    Only regions that hold more than one component matter. A text is at home in the largest of its regions, or the largest
    that is HOPS regions from there; the texts at home in one are dealt to blocks, large components by themselves, and every two blocks that a region has in common
    are compared on full sets, but for two of one component: a group of near copies that is linked already is met only
    by what stands apart from it. Only links leave a pair of blocks.
    """
    inside = dense.select("tree", "head", F.col("a").alias("doc_id")).distinct()
    inside = inside.join(comps, inside["doc_id"] == comps["node"], "left").select(F.xxhash64("tree", "head").alias("region"), "doc_id", F.coalesce("component", "doc_id").alias("c"))
    inside = stash(inside, "dense")
    mixed = stash(inside.groupBy("region").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("size")).filter("x < y").select("region", "size"), "mixed")
    texts = inside.join(mixed, "region")
    homes = stash(texts.groupBy("doc_id", "c").agg(F.max(F.struct("size", "region")).alias("home")), "homes")
    for _ in range(HOPS):
        # a small region's texts move to the largest home that its texts have, so that blocks are filled
        up = texts.select("region", "doc_id").join(homes, "doc_id").groupBy(F.col("region").alias("from")).agg(F.max("home").alias("up"))
        homes = stash(homes.join(up, F.col("home.region") == F.col("from")).select("doc_id", "c", F.col("up").alias("home")), "homes")
    homes = homes.select("doc_id", "c", F.col("home.region").alias("home"))
    # components of a block or more have blocks of their own, named by the component; the others share blocks
    sizes = homes.groupBy("home", "c").agg(F.count("*").alias("n"))
    small = sizes.filter(f"n < {BLOCK}").groupBy("home").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).alias("shared"))
    sizes = stash(sizes.join(small, "home", "left"), "sizes")
    own = F.when(F.col("n") >= BLOCK, F.col("c"))
    number = F.when(own.isNotNull(), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / F.lit(BLOCK)))).otherwise(F.pmod(F.xxhash64("c"), F.col("shared")))
    dealt = stash(homes.join(sizes, ["home", "c"]).select("doc_id", "c", F.xxhash64("home", F.coalesce(own, F.lit(-1)), number).alias("block"), F.coalesce(own, F.lit(-1)).alias("own")), "dealt")
    blocks = stash(texts.select("region", "doc_id").join(dealt, "doc_id").select("region", "block", "own").distinct(), "blocks")
    x, y = (blocks.select("region", F.col("block").alias(f"block_{s}"), F.col("own").alias(f"own_{s}")) for s in "xy")
    pairs = x.join(y, "region").filter("block_x <= block_y AND (own_x = -1 OR own_x <> own_y)").select("block_x", "block_y").distinct()
    sides = pairs.select("block_x", "block_y", F.explode(F.when(F.col("block_x") == F.col("block_y"), F.array(F.struct(F.col("block_x").alias("block"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("block_x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("block_y").alias("block"), F.lit(1).alias("side"))))).alias("e"))
    sides = sides.select("block_x", "block_y", "e.block", "e.side")
    sets = sets_of(dealt.select("doc_id"))
    held = dealt.select("doc_id", "c", "block").join(sides, "block").join(sets, "doc_id").select("block_x", "block_y", "doc_id", "c", "side", "grams")
    return held.groupBy("block_x", "block_y").applyInPandas(_met(percent), "a long, b long")


def minhash_dedup(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, min_depth: int = MIN_DEPTH, depth: int = DEPTH, near: int = NEAR, seed: int = SEED) -> DataFrame:
    """Near-duplicate classes of docs (doc_id, text; other columns are ignored).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set is its distinct shingles of
    width words, or the whole sequence if that is shorter. Documents are linked where percent per cent of the union
    of their sets is shared. Returns one row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links), kept (doc_id = component_id). Texts that are null, empty or without words have no shingles
    and link with nothing. Rows that repeat a doc_id are classed by their own texts, and each comes back. A row with null doc_id
    keeps a null component_id, links with nothing and is kept. An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stash(slim.mapInArrow(_signed(width, trees, depth, seed), "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, sketch binary"), "signed")
    parts = 1 + signed.count() // ROWS_A_FILE
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # of equal texts, only that of the smallest doc_id goes on
    classes = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copies = stash(classes.filter("n > 1").select("fp1", "fp2", "rep").coalesce(parts), "copies")
    heads = full.join(copies, ["fp1", "fp2"], "left").filter("rep IS NULL OR doc_id = rep").drop("rep")
    if not full.groupBy("doc_id").count().filter("count > 1").isEmpty():
        heads = heads.dropDuplicates(["doc_id", "fp1", "fp2"])
    labels = heads.select("doc_id", "n_shingles", "sig", "sketch").mapInArrow(_labels(trees, depth), "tree int, label binary, doc_id long, n long, s1 long, s2 long")
    # at the least similarity, sketch bits agree with probability (1 + percent/100) / 2; five deviations below are let through
    p = (1 + percent / 100) / 2
    floor = int(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5)
    schema = "a long, b long, same int, dense boolean, tree int, head binary, label binary, n long, s1 long, s2 long"
    walk = _neighbours(min_depth, near, floor, percent)
    met = stash(labels.repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id").mapInArrow(walk, schema), "met")
    # a few rows of each range, in one order
    borders = met.filter("b IS NULL").select("tree", "label", F.col("a").alias("doc_id"), "n", "s1", "s2").distinct()
    met = met.filter("b IS NOT NULL").union(stash(borders.coalesce(1).sortWithinPartitions("tree", "label", "doc_id").mapInArrow(walk, schema).filter("b IS NOT NULL"), "borders"))
    pairs = met.filter("NOT dense AND a < b").groupBy("a", "b").agg(F.max("same").alias("same"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """Full sets of the texts of ids, which are few of all where copies and near copies are."""
        texts = only(slim, stash(ids.distinct(), "ids"), "doc_id").dropDuplicates(["doc_id", "text"])
        return stash(texts.mapInArrow(_sets(width), "doc_id long, grams array<long>"), "sets")

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    # first each text with its likeliest smaller partner, which makes a forest, then what is still apart
    likely = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    comps = roots(_confirmed(likely.select("a", "b"), sets, percent).select(F.col("b").alias("node"), F.col("a").alias("up")))
    more = stash(_confirmed(_apart(pairs, comps), sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")).repartition(parts), "links")
    if not more.isEmpty():
        comps = joined(comps, more)
    dense = met.filter("dense")
    if not dense.isEmpty():
        more = stash(_rest(dense, comps, sets_of, percent).repartition(parts), "links")
        if not more.isEmpty():
            comps = joined(comps, more)
    heads_of = classes.join(comps.hint("merge"), classes["rep"] == comps["node"], "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("head"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(heads_of, ["fp1", "fp2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 2-word shingles, 80 per cent."""
    return minhash_dedup(table(spark, sf_dir, "documents"), width=2)


#: All pairs that share a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w
), u AS (
  SELECT min(doc_id) AS rep, any_value(len(s)) AS n, s FROM s WHERE len(s) > 0 GROUP BY s
), g AS (
  SELECT rep, n, unnest(s) AS g FROM u
), q AS (
  SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r(node, seen) AS (
  SELECT a, a FROM q UNION SELECT r.node, q.b FROM r JOIN q ON r.seen = q.a
), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component, rep, doc_id) AS component_id, doc_id = coalesce(component, rep, doc_id) AS kept
FROM s LEFT JOIN u ON s.s = u.s LEFT JOIN c ON rep = node
"""
