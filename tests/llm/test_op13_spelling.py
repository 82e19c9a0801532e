import collections
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import op13_spelling as op

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_counts(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    """Whether one code point was inserted, deleted or replaced, by trying."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in (range(len(b)) if len(b) < 1000 else (0, len(b) - 1)))


def plain(counts):
    out, forms = [], {}
    for w, n in counts.items():
        beside = [x for x in counts if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(beside, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= 10 * n else None
        out.append([w, forms[w], w, n, len(beside), forms[w] and counts[forms[w]]])
    for r in out:
        while forms[r[2]]:
            r[2] = forms[r[2]]
    return sorted(map(tuple, out))


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_words(spark, docs):
    """Runs, dropped letters, nulls, long texts and runs, repeats, forms of forms, ties."""
    words = ["letters", "leters", "lettrs", "élément", "elément", "ÉLÉMENT", "ABCDEFGH", "abcdefgh", "abcdefghi", "aaaaaaaa", "aaaaaaaaa", "naïvetés", "×÷×÷×÷×", "short", "Wörterbuch", "worterbuch"]
    rows = [(i, " ".join(np.random.default_rng(i).choice(words, 60))) for i in range(40)]
    rows += [(1000 + i, "chaining " * 1000) for i in range(2)] + [(2000, "chainin " * 150), (2001, "chainii " * 12), (2002, "chaini\u00adng_x1chainin")]
    rows += [(None, None), (None, "nothing nothing" * 5), (5, ""), (6, " \n\t"), (7, "z" * 300_000 + " " + "z" * 300_000 + " " + "z" * 299_999 + "a"), (8, "z" * 300_000), (9, "z" * 299_999 + "a")]
    rows += [(i, t) for i, t in rows if i == 3]
    got = op.group_spellings(docs(*[(i, t, "en", "s") for i, t in rows]))
    want = plain(plain_counts(rows))
    assert rows_of(got) == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(len(r[0]) > 100_000 and r[4] for r in want)
    assert op.group_spellings(docs((1, "letters letters", None, None)).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé"), min_size=7, max_size=12), min_size=1, max_size=25, unique=True), st.integers(0, 9))
def test_every_near_pair_meets(words, seed):
    """Whatever the order of bigrams is, two near words share a key, one of them as itself."""
    data, at = op._letters(pa.array(words))
    ranks = np.random.default_rng(seed).permutation(65536)
    keys = collections.defaultdict(set)
    for row, key, own in zip(*op.join_keys(data, at, ranks), strict=True):
        keys[key].add((int(row), bool(own)))
    met = {(a, b) for group in keys.values() for a, own in group if own for b, other in group if a != b and (len(words[a]) == len(words[b])) == other}
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            if a != b and len(x) <= len(y) and near(x, y):
                assert (a, b) in met


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abé"), max_size=8), st.text(st.sampled_from("abé"), max_size=8))
def test_one_edit(a, b):
    assert op.one_edit(a, b) == near(a, b) == op.one_edit(b, a)


def test_rarest():
    """Three bigrams by rank, ties by place."""
    data, at = op._letters(pa.array(["abababa", "bbabbbé"]))
    ranks = np.full(65536, 9)
    ranks[ord("b") * 256 + ord("a")], ranks[ord("b") * 256 + ord("é")] = 1, 0
    own, place = op.rarest(data, at, ranks)
    assert own.tolist() == [0, 0, 0, 1, 1, 1] and place.tolist() == [1, 3, 5, 7 + 5, 7 + 1, 7 + 0]


def test_few_words_meet(spark, sf_dir):
    """Candidates are few: not more than ten for each near pair, on top of one for each word."""
    words = op.stash(op.count_words(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "words")
    found = op.near_words(words).count()
    data, at = op._letters(pa.array([r[0] for r in words.select("word").collect()]))
    counts = np.zeros(65536, np.int64)
    for r in op.bigram_counts(words).collect():
        counts[r["gram"]] = r["n"]
    ranks = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
    _, key, own = op.join_keys(data, at, ranks)
    _, place = np.unique(key, return_inverse=True)
    met = (np.bincount(place, own) * np.bincount(place)).sum() - own.sum()
    assert met <= 20 * found + words.count()


def test_query(spark, sf_dir):
    out = op.op13_spelling(spark, sf_dir)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({op.ORACLE_SQL})").fetchall())
    assert rows_of(out) == want == plain(plain_counts([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]))
