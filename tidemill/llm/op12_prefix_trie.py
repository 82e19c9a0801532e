"""Conversation prefix tries in level order, built shard by shard.

Every conversation is a path of turns; each turn's label is a digest, and a prefix is the chained digest of its labels, so no
text leaves its row. One conversation of each distinct sequence, with the number of its copies, stands for all. Subtrees that few
rows can fill are dealt out by the prefix of their top; in numpy, many of them at a time form a LOUDS bit vector with an
array of labels, of which parents and degrees are read and in which sums go up level by level. What lies above is heavy: its few levels
are summed over the paths of the conversations that own their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import small, stash, table
from tidemill.llm.words import tidy

WORDS = r"[^\x20\x09-\x0D]+"
#: A subtree is one task's work if no more rows than this lie in it.
SHARD_ROWS = 20_000
#: Each conversation begins with up to SHARED_MOST - 1 turns of the first of its SHARED_EVERY neighbours.
SHARED_EVERY, SHARED_MOST = 20, 4
IDS_A_CHUNK = 1000
ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()


class Louds:
    """A forest in level order: the unary degrees (ones, then a zero) of a super-root and of each node. labels: one for each node."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray) -> None:
        """degrees: of the super-root, then of the nodes in level order."""
        self.bits = np.ones(len(degrees) + int(degrees.sum()), bool)
        self.bits[np.cumsum(degrees) + np.arange(len(degrees))] = False
        self.labels = labels

    @classmethod
    def of(cls, prefix: np.ndarray, parent: np.ndarray) -> tuple[Louds, np.ndarray]:
        """prefix and parent: numbers of the nodes and of what they hang on; a number that is no node's is the super-root. Also the rows in level order, children by their number."""
        n = len(prefix)
        order, up = np.empty(n, np.int64), np.empty(n, np.int64)
        known = np.zeros(int(max(prefix.max(initial=0), parent.max(initial=0))) + 1, bool)
        known[prefix] = True
        tops = np.flatnonzero(~known[parent])
        order[: len(tops)], up[: len(tops)] = tops[np.argsort(prefix[tops], kind="stable")], -1
        by_parent = np.argsort(parent, kind="stable")
        starts, ends = (np.searchsorted(parent[by_parent], prefix, side) for side in ("left", "right"))
        first, done = 0, len(tops)
        while first < done:
            above = order[first:done]
            counts = ends[above] - starts[above]
            after = done + int(counts.sum())
            into = np.repeat(np.arange(first, done), counts)
            rows = by_parent[np.repeat(starts[above] - np.cumsum(counts) + counts, counts) + np.arange(after - done)]
            sort = np.lexsort((prefix[rows], into))
            order[done:after], up[done:after] = rows[sort], into[sort]
            first, done = done, after
        if done < n:
            raise ValueError("some nodes hang on no top")
        return cls(np.bincount(up + 1, minlength=n + 1), prefix[order]), order

    def parents(self) -> np.ndarray:
        """Of each node, the place of its parent; -1 for tops. The i-th one is node i, and the zeros before it are its parent's."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def levels(self) -> list[tuple[int, int]]:
        """First place and the place after the last of each level."""
        degrees, found = self.degrees(), []
        first, after = 0, int(np.flatnonzero(~self.bits)[0])
        while first < after:
            found.append((first, after))
            first, after = after, after + int(degrees[first:after].sum())
        return found

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each node's subtree, from the last level up."""
        total, up = values.astype(np.int64), self.parents()
        for first, after in self.levels()[:0:-1]:
            np.add.at(total, up[first:after], total[first:after])
        return total


def _numbers(*digests: pa.Array) -> list[np.ndarray]:
    whole = pa.concat_arrays([d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d for d in digests]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(whole, np.cumsum([len(d) for d in digests])[:-1])


def chain(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, size, label, words; depth 0 is the root) with prefix, the digest of all labels so far, and parent, that of the row before. A partition is gone through once, remembering one digest."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = ROOT
        for b in batches:
            prefix, parent = [], []
            for depth, label in zip(b.column("depth").to_pylist(), b.column("label").to_pylist(), strict=True):
                parent.append(at if depth else b"")
                at = hashlib.sha256(at + label).digest() if depth else ROOT
                prefix.append(at)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("conv_id", "depth", "size", "words")] + [pa.array(prefix, pa.binary()), pa.array(parent, pa.binary())], ["conv_id", "depth", "size", "words", "prefix", "parent"])

    dealt = rows.select("conv_id", "depth", "size", "words", "label").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(run, "conv_id long, depth long, size long, words long, prefix binary, parent binary")


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), label (binary) and words of each turn. Turns go by turn (null first), those of one turn by role and label; null roles and texts are empty; rows without a conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("label"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "label"))
    return slim.withColumn("place", place.cast("long")).select("conv_id", "place", "label", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations c of turns (as from ordered) that begin with the first h turns of c - c % 20, followed by their own after the first h; h is crc32 of c modulo 4."""
    base = F.col("conv_id") - F.col("conv_id") % SHARED_EVERY
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED_MOST
    counted = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    bases = counted.filter(f"conv_id % {SHARED_EVERY} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = counted.select("conv_id", "n", h.alias("h"), base.alias("base")).join(bases, "base", "left")
    info = info.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = turns.join(info, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "size", "label", "words")
    heads = turns.filter(f"place < {SHARED_MOST} AND conv_id % {SHARED_EVERY} = 0").select(F.col("conv_id").alias("base"), "place", "label", "words")
    shared = info.filter("k > 0").join(heads, "base").filter("place <= k").select("conv_id", F.col("place").alias("depth"), "size", "label", "words")
    return own.union(shared).union(info.select("conv_id", F.lit(0).cast("long"), "size", F.lit(b""), F.lit(0).cast("long")))


def whole(turns: DataFrame) -> DataFrame:
    """Conversations of turns (as from ordered) as they are."""
    sized = turns.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).select("conv_id", F.col("place").alias("depth"), "size", "label", "words")
    return sized.union(sized.filter("depth = 1").select("conv_id", F.lit(0).cast("long"), "size", F.lit(b""), F.lit(0).cast("long")))


def _ends(last: DataFrame) -> DataFrame:
    """prefix and the digest of the ascending ids that end there. Ids are joined in runs, where they lie, before those of one prefix meet."""

    @tidy
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        for b in batches:
            out = []
            for prefix, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (prefix != at or len(ids) == IDS_A_CHUNK):
                    out.append((at, ids[0], ",".join(map(str, ids))))
                    ids = []
                at = prefix
                ids.append(i)
            yield batch(out)
        if ids:
            yield batch([(at, ids[0], ",".join(map(str, ids)))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        prefix, first, text = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["prefix", "first", "ids"])

    @tidy
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            out = []
            for prefix, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if prefix == at:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append((at, sha.hexdigest()))
                at, sha = prefix, hashlib.sha256(ids.encode())
            yield hexes(out)
        if sha:
            yield hexes([(at, sha.hexdigest())])

    def hexes(rows: list[tuple]) -> pa.RecordBatch:
        prefix, digest = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), pa.array(digest, pa.string())], ["prefix", "ends_sha256"])

    joined = last.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id").mapInArrow(runs, "prefix binary, first long, ids string")
    return joined.repartition("prefix").sortWithinPartitions("prefix", "first").mapInArrow(digests, "prefix binary, ends_sha256 string")


def _sharded(nodes: DataFrame, rows: int) -> DataFrame:
    """nodes (prefix, parent, conv_id, depth, n_convs, words, shard) with parent_conv_id (null for the top of a shard), n_children, n_leaves and saved_tokens, of tries that whole shards of about so many rows form."""
    names = ["prefix", "parent", "conv_id", "depth", "n_convs", "top", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]

    def grown(t: pa.Table) -> pa.RecordBatch:
        prefix, parent = _numbers(t.column("prefix"), t.column("parent"))
        n_convs = t.column("n_convs").to_numpy()
        # a top's parent lies in no shard, so it has a number that is no node's
        trie, order = Louds.of(prefix, parent)
        up, degrees = trie.parents(), trie.degrees()
        own = ((n_convs - 1) * t.column("words").to_numpy())[order]
        ids = t.column("conv_id").to_numpy()[order]
        values = {
            "top": up < 0,
            "parent_conv_id": pa.array(np.where(up < 0, 0, ids[up]), mask=up < 0),
            "n_children": degrees,
            "n_leaves": trie.rollup(degrees == 0),
            "saved_tokens": trie.rollup(own),
        }
        t = t.take(pa.array(order))
        return pa.RecordBatch.from_arrays([t.column(n).combine_chunks() if n in t.column_names else values[n] if isinstance(values[n], pa.Array) else pa.array(values[n]) for n in names], names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            # the last shard may go on in the next batch
            shard = _numbers(t.column("shard"))[0]
            cut = int(np.flatnonzero(shard != shard[-1])[-1]) + 1 if (shard != shard[-1]).any() else 0
            if cut:
                yield grown(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
        if size:
            yield grown(pa.Table.from_batches(held).combine_chunks())

    schema = "prefix binary, parent binary, conv_id long, depth long, n_convs long, top boolean, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    return nodes.select("prefix", "parent", "conv_id", "depth", "n_convs", "words", "shard").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def prefix_trie(paths: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of conversations.

    paths: conv_id, depth, size, label, words, as rebuilt() or whole() gives them: one row for each turn of a conversation and one of
    depth 0; size is its number of turns. Conversations of equal turns are one path. A table without conversations has no nodes.

    Returns for each node prefix (digest of its turns), conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (summed over its subtree, (n_convs - 1) * words of the
    last turn) and ends_sha256 (digest of the ascending, comma-joined ids of members that end there).
    """
    steps = stash(chain(paths), "prefixes")
    last = steps.filter("depth = size")
    copies = last.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).select("conv_id", "copies")
    rows = stash(steps.join(copies, "conv_id"), "sequences")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  the same in all rows of a prefix
    nodes = stash(
        rows.groupBy("prefix").agg(first("parent"), F.min("conv_id").alias("conv_id"), first("depth"), first("words"), F.sum("copies").alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("below")),
        "nodes",
    )
    heavy = nodes.filter(F.col("below") > shard_rows)
    n_heavy = heavy.count()
    marks = small(heavy.select("prefix", F.lit(True).alias("heavy")), n_heavy)
    marked = stash(rows.select("conv_id", "depth", "prefix").join(marks, "prefix", "left"), "marked")
    shards = marked.filter("heavy IS NULL").groupBy("conv_id").agg(F.min_by("prefix", "depth").alias("shard"))
    light = stash(_sharded(nodes.filter(F.col("below") <= shard_rows).join(shards, "conv_id"), shard_rows), "tries")

    # the heavy levels: what hangs on them, and sums over the paths of the owners of their nodes and of the shards
    tops = light.filter("top")
    hung = heavy.filter("depth > 0").select("parent").union(tops.filter("depth > 0").select("parent"))
    children = hung.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("parent").alias("prefix"), "n_children")
    upper = stash(heavy.join(children, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "upper")
    none = F.lit(0).cast("long")
    given = upper.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    given = given.union(tops.select("conv_id", "depth", "n_leaves", "saved_tokens")).withColumn("prefix", F.lit(None).cast("binary"))
    on = marked.filter("heavy").select("conv_id", "depth", none.alias("n_leaves"), none.alias("saved_tokens"), "prefix")
    under = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = on.union(given).select("prefix", F.sum("n_leaves").over(under).alias("n_leaves"), F.sum("saved_tokens").over(under).alias("saved_tokens")).filter("prefix IS NOT NULL")
    summed = upper.join(sums.groupBy("prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "prefix")

    columns = ["prefix", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    known = small(heavy.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id")), n_heavy)
    above = tops.drop("parent_conv_id").select("parent", *columns).union(summed.select("parent", *columns)).join(known, "parent", "left")
    every = light.filter("NOT top").select("parent_conv_id", *columns).union(above.select("parent_conv_id", *columns))
    return every.join(_ends(last), "prefix", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stash(ordered(table(spark, sf_dir, "conversations")), "turns")
    longs: list[Column] = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return prefix_trie(rebuilt(turns)).select(*longs, "ends_sha256")


ORACLE_SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS v FROM range(256) r(i))
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list({'role': role, 'text': text} ORDER BY place) AS own,
    xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, b: xor(any_value(tab.t)[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 4 AS h
  FROM turns, tab GROUP BY conv_id
), paths AS (
  SELECT c.conv_id, coalesce(list_slice(b.own, 1, c.h), []) || coalesce(list_slice(c.own, c.h + 1, len(c.own)), []) AS path
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), steps AS (
  SELECT conv_id, d AS depth, list_slice(path, 1, d) AS prefix, d = len(path) AS last FROM paths, unnest(range(0, len(path) + 1)) u(d)
), nodes AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM steps GROUP BY prefix
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved,
    count(c.conv_id) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
    LEFT JOIN nodes c ON c.depth = n.depth + 1 AND list_slice(c.prefix, 1, c.depth - 1) = n.prefix
  GROUP BY ALL
), sums AS (
  SELECT list_slice(prefix, 1, d) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM linked, unnest(range(0, depth + 1)) u(d) GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM linked JOIN sums USING (prefix)
"""
