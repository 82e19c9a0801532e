import collections
import json
import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import op11_quality_rules as op

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")


def plain_statistics(text):
    """The columns of BASE and the vector, in loops."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    chars, symbols = sum(map(len, words)), len(SYMBOL.findall(text))
    marks = sum(c.isascii() and not c.isalpha() for w in words for c in w)
    n = max(1, len(words))
    vector = (math.log(max(chars, 1) / n), math.sqrt(symbols / n), math.sqrt(marks / max(chars, 1)), again / max(1, len(lines)), len(repeated) / n)
    return [len(words), chars, symbols, again, len(repeated)], [round(x * 1024) for x in vector]


def plain_estimate(vectors):
    """Mean and covariance of one group, with numpy over all of its vectors."""
    x = np.array(sorted(set(vectors)), float)
    floors = np.diag((np.array(op.FLOORS) * 1024) ** 2)
    mid = np.floor(np.median(x, 0))
    spread = np.floor(np.median(abs(x - mid), 0))
    z = (x - mid) / np.maximum(1.4826 * spread, np.array(op.FLOORS) * 1024)
    starts = []
    for u in (None, np.tanh(z), z / np.maximum(np.sqrt((z * z).sum(1)), 1e-9)[:, None]):
        like = np.eye(5)
        if u is not None:
            like = u.T @ u * 2**20
            root = np.sqrt(np.maximum(np.diag(like), 1))
            like = like / np.outer(root, root)
            np.fill_diagonal(like, 1)
        starts.append((mid, like * np.outer(1.4826 * spread, 1.4826 * spread) + floors))

    def distances(mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def concentrated(mean, cov):
        step = np.floor(np.log2(1 + distances(mean, cov)) * 64)
        near = x[step <= np.percentile(step, 50)]
        return near.mean(0), np.cov(near.T, bias=True) * op._consistent(0.5) + floors

    for _ in range(op.FIRST_STEPS):
        starts = [concentrated(*s) for s in starts]
    best = min(starts, key=lambda s: np.linalg.slogdet(s[1])[1])
    for _ in range(op.MOST_STEPS):
        best = concentrated(*best)
    near = x[distances(*best) <= op.chi2_quantile(0.975)]
    return near.mean(0), np.cov(near.T, bias=True) * op._consistent(0.975) + floors


def plain_verdicts(rows):
    """(kept, distance) of each (doc_id, text, lang, source)."""
    found = [plain_statistics(r[1]) for r in rows]
    failed = [b[0] < 10 or 100 * b[4] > 20 * b[0] for b, _ in found]
    cells = collections.defaultdict(set)
    for r, (_, v), bad in zip(rows, found, failed, strict=True):
        if not bad:
            cells[r[2], r[3]].add(tuple(v))
    group, tongues, rest = {}, collections.Counter(), 0
    for (lang, _), v in cells.items():
        tongues[lang] += len(v) if len(v) < op.LEAST_ROWS else 0
    rest = sum(n for n in tongues.values() if n < op.LEAST_ROWS)
    members = collections.defaultdict(set)
    for (lang, source), v in cells.items():
        g = (lang, source) if len(v) >= op.LEAST_ROWS else lang if tongues[lang] >= op.LEAST_ROWS else "rest" if rest >= op.LEAST_ROWS else None
        group[lang, source] = json.dumps(g)
        members[json.dumps(g)] |= v
    fits = {g: plain_estimate(v) for g, v in members.items() if g != "null"}
    out = []
    for r, (b, v), bad in zip(rows, found, failed, strict=True):
        fit = None if bad else fits.get(group[r[2], r[3]])
        if fit is None:
            out.append((not bad, None))
        else:
            d = np.array(v) - fit[0]
            d = d @ np.linalg.inv(fit[1]) @ d / (1 + 50 / b[0])
            out.append((d <= op.chi2_quantile(op.QUANTILE), d))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab# é\n\t\r\x0b\x00😀|,")), st.lists(st.sampled_from(["a b c d e", "x y", "\n", "a b c d e\n", " "])).map(" ".join)), max_size=8))
def test_statistics(texts):
    base, vectors = op.statistics(pa.array(texts, pa.string()))
    assert base.tolist() == [plain_statistics(t)[0] for t in texts]
    assert np.abs(vectors - np.array([plain_statistics(t)[1] for t in texts]).reshape(-1, 5)).max(initial=0) <= 1


def test_chi2():
    assert abs(op.chi2_quantile(0.5) - 4.35146) < 1e-4 and abs(op.chi2_quantile(0.975) - 12.8325) < 1e-3
    assert abs(op.chi2_below(14.0671, 7) - 0.95) < 1e-5


def texts(rng, n, words, least=80, most=200):
    return [" ".join(rng.choice(words, rng.integers(least, most))) + "." for _ in range(n)]


def rows_of(rng):
    plain = ["water", "the", "of", "stone", "letters", "again", "house", "market", "going", "small"]
    junk = ["##", "a|b", "$$$", "x", "%%", "ab"]
    rows = []
    for lang, source, n, bad in (("en", "a", 90, 30), ("en", "b", 20, 2), ("en", "c", 25, 2), ("de", "a", 5, 0), ("fr", None, 30, 1), (None, "a", 20, 1), (None, None, 3, 0)):
        rows += [(t, lang, source) for t in (*texts(rng, n, plain), *texts(rng, bad, junk))]
    rows += [(None, "en", "a"), ("", "en", "a"), (" \n", None, None), ("one two", "en", "b"), ("w " * 400_000, "en", "a"), (" ".join(str(i) for i in range(100_000)), "en", "a")]
    rows += rows[:150]  # copies
    return [(i, *r) for i, r in enumerate(rows)]


def test_estimates(spark, docs):
    rng = np.random.default_rng(1)
    rows = rows_of(rng)
    out = {r["doc_id"]: r for r in op.reject_outliers(docs(*rows)).collect()}
    assert len(out) == len(rows)
    near = 0
    for r, (kept, distance) in zip(rows, plain_verdicts(rows), strict=True):
        got = out[r[0]]
        assert (got["distance"] is None) == (distance is None)
        if distance is not None:
            assert abs(got["distance"] - distance) <= 0.02 * distance + 0.02
            if abs(distance - op.chi2_quantile(op.QUANTILE)) <= 1:
                near += 1
                continue
        assert got["kept"] == kept
    assert near < 5 and not out[90]["kept"] and out[0]["kept"]


def test_masked_outliers(spark, docs):
    """A third of a source that is junk neither moves nor widens what is normal there; results do not depend on partitions."""
    rng = np.random.default_rng(2)
    clean = texts(rng, 120, ["water", "the", "of", "stone", "letters", "again", "house", "market", "going", "small", "and", "where", "to", "often"])
    junk = texts(rng, 60, ["#a", "b|", "c$", "d", "%e", "f<"])
    df = docs(*[(i, t, "en", "s") for i, t in enumerate(clean + junk)])
    results = [sorted((r["doc_id"], r["kept"], r["distance"]) for r in op.reject_outliers(df.repartition(n)).collect()) for n in (1, 7)]
    assert results[0] == results[1]
    assert [k for _, k, _ in results[0]] == [True] * 120 + [False] * 60


def test_one_hot_text(spark, docs):
    """Copies of one text, most of a source, do not make its other texts outliers."""
    rng = np.random.default_rng(3)
    words = ["water", "the", "of", "stone", "letters", "again", "house", "market", "going", "small", "and", "where", "to", "often"]
    one = texts(rng, 1, words)[0]
    near = [one + " " + w for w in words for _ in range(60)]
    out = op.reject_outliers(docs(*[(i, t, "en", "s") for i, t in enumerate(near + texts(rng, 60, words))])).collect()
    assert all(r["kept"] for r in out)


def test_empty(spark, docs):
    assert op.reject_outliers(docs((1, "x", "en", "s")).limit(0)).count() == 0
    few = op.reject_outliers(docs((1, "# " * 20, "en", "s"), (None, "a b c d e f g h i j k l", None, None))).collect()
    assert sorted((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in few) == [(0, False, True), (1, True, False)]


def test_query(spark, sf_dir):
    out = op.op11_quality_rules(spark, sf_dir)
    assert out.dtypes[:8] == [("doc_id", "bigint"), *((c, "bigint") for c in op.BASE), ("base_failed", "boolean"), ("kept", "boolean")]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = {r["doc_id"]: r for r in out.collect()}
    for r, (kept, distance) in zip(rows, plain_verdicts(rows), strict=True):
        assert [got[r[0]][c] for c in op.BASE] == plain_statistics(r[1])[0]
        assert got[r[0]]["kept"] == kept or abs(distance - op.chi2_quantile(op.QUANTILE)) < 0.5
