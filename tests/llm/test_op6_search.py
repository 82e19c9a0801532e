import numpy as np

from tidemill.llm import op6_search as op6
from tidemill.llm.op6_search import Hashing, op6_search, search


def brute(rows, queries, k=10):
    good = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    out = {}
    for q in queries:
        if q in good:
            d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = d[:k]
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in out.items()}


def test_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, vector array<float>, score int, rank int")
    want, found = brute(rows, range(0, 3000, 100)), got(search(df, df.filter("vec_id % 100 = 0 AND vec_id < 3000")))
    hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert found[0] == [(0.0, i) for i in range(3000, 3010)]
    exact = dict(rows)
    for q, v in found.items():
        assert v == sorted(v) and all(abs(s - np.sqrt(((np.array(exact[q]) - np.array(exact[i])) ** 2).sum())) < 1e-12 for s, i in v)


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [2.0, 0.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    assert got(search(df, df)) == {q: v for q, v in brute([r for r in rows if r[0] is not None], [0, 1, 6, 7]).items() if v}
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0


def test_hot_cells_and_repeats(spark, monkeypatch):
    """Cells beyond a share are cut on both sides; repeated rows, ids with several vectors and many equal vectors leave the nearest whole."""
    monkeypatch.setattr(op6, "SHARE", 50)
    monkeypatch.setattr(op6, "VISITS", 20)
    monkeypatch.setattr(op6, "AT_ONCE", 300)
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    near = [[float(x) for x in base + 0.01 * rng.normal(size=8)] for _ in range(300)]
    rows = list(enumerate(near)) + [(1000 + i, [float(x) for x in base]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5)
    asked = df.filter("vec_id % 3 = 0")
    want, found = brute(rows, [i for i, _ in rows if i % 3 == 0]), got(search(df, asked))
    hits = sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want)
    assert set(found) == set(want) and hits >= 0.9 * 10 * len(want)
    repeated = [(1, [1.0, 0.0])] * 50 + [(2, [1.0, 0.1 * i]) for i in range(50)] + [(10 + i, [3.0, float(i)]) for i in range(12)]
    few = got(search(spark.createDataFrame(repeated, "vec_id long, vector array<double>"), spark.createDataFrame([(99, [1.0, 0.0])], "vec_id long, vector array<double>")))
    assert [i for _, i in few[99]] == [1, 2, *range(10, 18)]


def test_probes_begin_at_home():
    """The query's own cells come first, and all cells' masses add up to what the steps cover."""
    q = np.random.default_rng(0).normal(size=(5, 8))
    m = Hashing(1.0, 0.5, 0.9)
    own = m.cells(q, 0)
    for i, cells in enumerate(m.probes(q, 0)):
        assert own[i] in cells[:16].tolist() and len(set(cells.tolist())) == len(cells)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, found = brute(rows, [i for i, _ in rows if i % 100 == 0]), got(op6_search(spark, sf_dir))
    assert sum(len({i for _, i in want[q]} & {i for _, i in found[q]}) for q in want) >= 0.9 * 10 * len(want)
