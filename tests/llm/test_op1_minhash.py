import random
import re

import numpy as np
import pytest

from tidemill.llm.common import components
from tidemill.llm.op1_minhash import minhash_dedup, op1_minhash
from tidemill.llm.words import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent=80):
    """doc_id, set size and component by comparing all pairs; rows with one doc_id each."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("width", [2, 5])
def test_brute_force(spark, docs, width):
    """Groups of near copies of all sizes and distances, one of them larger than the neighbours of a text reach."""
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size, edits in ((2, 1), (3, 3), (5, 6), (40, 4), (60, 2), (1, 0), (1, 0)):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(120)] = rng.choice(vocabulary).upper()
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    df = docs(*((i, t, "en", "s") for i, t in rows))
    assert got(minhash_dedup(df, width=width)) == brute(rows, width)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranges_change_nothing(spark, docs, parts):
    """Regions of near copies and of boilerplate that share most of their words: wherever the ranges are cut, links are those of all pairs."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    frame = [rng.choice(vocabulary) for _ in range(100)]
    rows = []
    for g in range(60):
        own = frame[:90] + [f"g{g}x{i}" for i in range(rng.randint(8, 25))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(own)
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(minhash_dedup(docs(*((i, t, "en", "s") for i, t in rows)), width=2)) == brute(rows, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark, docs):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (8, long + " end"), (9, "é É"), (10, "É É")]
    assert got(minhash_dedup(docs(*((i, t, None, None) for i, t in rows)), width=2)) == brute(rows, 2)
    again = minhash_dedup(docs((3, "a b c", None, None), (3, "a b c", None, None), (2, "a b c", None, None), (None, "a b c", None, None)), width=2)
    assert sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in again.collect()) == [(0, None, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    empty = minhash_dedup(docs((1, "a", None, None)).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components(spark):
    """A long path, a star and a ring; repeated and reversed links, nulls and self links."""
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (202, 201), (202, 200), (200, 200), (None, 5), (5, None), (201, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 130)} | {i: 200 for i in (200, 201, 202)}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words():
    texts = ["a B\tc", "", "  ", "ab c", "c"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, at = words(data, offsets)
    assert np.diff(at).tolist() == [3, 0, 0, 2, 1] and h[2] == h[4] == h[5] and len(set(h.tolist())) == 4


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op1_minhash(spark, sf_dir)) == brute(rows, 2)


def test_word_hash():
    """Words that fool polynomials modulo powers of two (Thue and Morse) have hashes of their own."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} {word}".encode(), np.uint8)
    hashes, _ = words(data, np.array([0, len(data)]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
