import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemill.llm import op12_prefix_trie as op

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_paths(rows, mixed=True):
    """The turns of each conversation, rebuilt."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((-(10**18) if turn is None else turn, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    if not mixed:
        return own
    out = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + x[h:]
    return out


def plain_nodes(paths):
    """Nodes by a dictionary of prefixes; subtrees by walking all of them."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        tokens = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += tokens
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


def nodes(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, prefix string, depth int")


def made(rng, n, turns=6, texts=3):
    words = ["hello there", "a b  c", "", None, " \t", "ünï\x0bcode 中 "]
    return [(c, t, "user" if t % 2 else None, words[rng.integers(texts)]) for c in range(n) for t in range(rng.integers(1, turns))]


@pytest.mark.parametrize("shard_rows", [1, 7, 60, 10**6])
def test_nodes(spark, shard_rows):
    """Equal to dictionaries wherever the trie is cut."""
    rng = np.random.default_rng(shard_rows)
    rows = made(rng, 150)
    got = op.prefix_trie(op.rebuilt(op.ordered(frame(spark, rows))), shard_rows)
    assert nodes(got) == plain_nodes(plain_paths(rows))


def test_edges(spark):
    rows = [
        (-7, None, "user", "b"), (-7, None, "user", "a"), (-7, 0, None, None), (-7, 0, None, None), (0, 5, "user", "first"), (0, -5, "", "before"), (None, 1, "user", "no conversation"),
        (1, 0, "a", "b"), (2, 0, "", "ab"), (3, 0, "ab", ""), (19, 1, "x", "only"), (40, 0, "assistant", "y " * 200_000), (45, 0, "assistant", "y " * 200_000), (9_000_000_000, 0, "u", "t"), (10**18, 0, "u", "t"),
    ]
    rows += [(61, t, "user", f"turn {t // 2}") for t in range(3000)] + [(62, t, "user", f"turn {t // 2}") for t in range(2990)]
    for shard_rows in (50, 10**6):
        got = op.prefix_trie(op.rebuilt(op.ordered(frame(spark, rows))), shard_rows)
        assert nodes(got) == [x for x in plain_nodes_quick(plain_paths(rows))]
    assert nodes(op.prefix_trie(op.rebuilt(op.ordered(frame(spark, rows).limit(0))))) == []


def plain_nodes_quick(paths):
    """plain_nodes for long paths: prefixes are numbered instead of copied."""
    numbers, parent, word, depth = {}, [None], [0], [0]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in sorted(paths.items()):
        at = 0
        members[0].append(c)
        for step in path:
            if (at, step) not in numbers:
                numbers[at, step] = len(parent)
                parent.append(at)
                word.append(len(re.findall(r"[^\x20\x09-\x0D]+", step[1])))
                depth.append(depth[at] + 1)
            at = numbers[at, step]
            members[at].append(c)
        ends[at].append(c)
    children = collections.Counter(parent[1:])
    leaves, saved = [int(not children[i]) for i in range(len(parent))], [(len(members[i]) - 1) * word[i] for i in range(len(parent))]
    for i in range(len(parent) - 1, 0, -1):
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    return sorted((members[i][0], depth[i], members[p][0] if p is not None else None, len(members[i]), children[i], leaves[i], saved[i], hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest()) for i, p in enumerate(parent))


def test_hot_copies(spark):
    """Thousands of copies of one conversation, and one first turn of all; ids of one node are hashed in order over many runs."""
    rows = [(c, t, "user", f"t{t}") for c in range(5000) for t in range(2)] + [(c, t, "user", f"t{t * c}") for c in range(5000, 5300) for t in range(4)]
    got = op.prefix_trie(op.whole(op.ordered(frame(spark, rows).repartition(7))), 100)
    assert nodes(got) == plain_nodes_quick(plain_paths(rows, mixed=False))


def test_louds():
    """Bits of a written-out tree; parents, degrees and sums read from them."""
    #   1        9
    #  / \       |
    # 2   3      4
    #     |
    #     5
    trie, order = op.Louds.of(np.array([5, 4, 3, 2, 1, 9]), np.array([3, 9, 1, 1, 0, 7]))
    assert trie.labels.tolist() == [1, 9, 2, 3, 4, 5] and order.tolist() == [4, 5, 3, 2, 1, 0]
    assert "".join("01"[int(b)] for b in trie.bits) == "110" + "110" + "10" + "0" + "10" + "0" + "0"
    assert trie.parents().tolist() == [-1, -1, 0, 0, 1, 3] and trie.degrees().tolist() == [2, 1, 0, 1, 0, 0]
    assert trie.rollup(np.array([1, 10, 100, 1000, 10000, 100000])).tolist() == [101101, 10010, 100, 101000, 10000, 100000]
    empty, _ = op.Louds.of(np.array([], np.int64), np.array([], np.int64))
    assert empty.parents().tolist() == [] and empty.rollup(np.array([], np.int64)).tolist() == []


def test_query(spark, sf_dir):
    out = op.op12_prefix_trie(spark, sf_dir)
    assert out.dtypes == [*((c, "bigint") for c in COLUMNS[:-1]), ("ends_sha256", "string")]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({op.ORACLE_SQL})").fetchall())
    assert nodes(out) == want == plain_nodes(plain_paths([tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
