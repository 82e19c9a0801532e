"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For every language and source the minimum covariance determinant
(Rousseeuw, 1985) is estimated by concentration steps from several deterministic starts, each step two grouped
aggregates over all vectors: the middle of the squared distances, then sums over the rows up to it. A document whose
squared Mahalanobis distance to its group is too large is rejected.

Vectors are whole numbers (1/1024), so all sums are exact: results depend neither on the order of rows nor on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import small, stash, table, text_batches
from tidemill.llm.words import SPACE, bounds, chunks, mix, tidy

WINDOW = 5
LEAST_WORDS = 10
#: A document fails at once when more than this per cent of its words are in repeated windows.
MOST_REPEATED = 20
#: Groups with fewer different vectors are pooled by language, then all together; where even these are too few, nothing is rejected.
LEAST_ROWS = 40
#: Rejected documents are beyond this quantile of the chi-squared distribution.
QUANTILE = 1 - 1e-6
#: Statistics of short texts vary more: squared distances are divided by 1 + SHORT / words.
SHORT = 50
#: Concentration steps of every start, and of the best start of each group after them, unless it stands still before.
FIRST_STEPS, MOST_STEPS = 2, 10

_SCALE = 1024
#: Of each statistic, the deviation that is always allowed for (log of word length; roots of symbols a word and of the share of marks; shares of repeated lines and words).
FLOORS = (0.05, 0.1, 0.1, 0.1, 0.1)
_D = len(FLOORS)
_PAIRS = [(j, k) for j in range(_D) for k in range(j, _D)]
_Z = [f"z{j}" for j in range(_D)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(128) if not chr(b).isalpha() and not SPACE[b]]] = True
_STEP = np.random.default_rng(11).integers(1, 2**63, WINDOW + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chi2_below(x: float, d: int) -> float:
    """Share of a chi-squared distribution of d (odd) degrees of freedom that is at most x."""
    at = math.erf(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, d - 1, 2):
        at -= term
        term *= x / (k + 2)
    return at


def chi2_quantile(share: float, d: int = _D) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, d) < share else (low, middle)
    return high


def _consistent(share: float) -> float:
    """What the covariance of a normal distribution's nearest share is multiplied by."""
    return share / chi2_below(chi2_quantile(share), _D + 2)


def _ids(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of byte strings that lie one after the other; equal strings have equal numbers."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks lie in each text."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(total[offsets])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, lines with a word, and those of them that are equal to an earlier one."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([offsets[1:], breaks])
    order, last = np.lexsort((starts, owner)), np.lexsort((ends, owner))
    owner, starts, ends = owner[order], starts[order], ends[last]
    inked = np.concatenate([[0], np.cumsum(~SPACE[data], dtype=np.int64)])
    full = inked[ends] > inked[starts]
    ids = _ids(data[data != 10], ends - starts)
    distinct = np.unique(owner[full] * len(ids) + ids[full]) // max(1, len(ids))
    lines = np.bincount(owner[full], minlength=n)
    return lines, lines - np.bincount(distinct, minlength=n)


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text, words in windows that come twice or more in it."""
    n, total = len(at) - 1, len(starts)
    if total < WINDOW:
        return np.zeros(n, np.int64)
    ids = _ids(data[~SPACE[data]], ends - starts)
    owner = np.repeat(np.arange(n), np.diff(at))
    first = np.flatnonzero(owner[: total - WINDOW + 1] == owner[WINDOW - 1 :])
    prints = owner[first].astype(np.uint64) * _STEP[WINDOW]
    for k in range(WINDOW):
        prints += ids[first + k].astype(np.uint64) * _STEP[k]
    order = np.argsort(mix(prints), kind="stable")
    a, b = first[order[:-1]], first[order[1:]]
    near = prints[order[:-1]] == prints[order[1:]]
    a, b = a[near], b[near]
    same = owner[a] == owner[b]
    for k in range(WINDOW):
        same &= ids[a + k] == ids[b + k]
    found = np.unique(np.concatenate([a[same], b[same]]))
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return _sums(np.cumsum(cover[:-1]) > 0, at)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text: the columns of BASE; the vector in 1/1024. Null counts as empty."""
    base, vectors = [np.empty((0, len(BASE)), np.int64)], [np.empty((0, _D), np.int64)]
    for _, _, data, offsets in chunks(texts):
        starts, ends, at = bounds(data, offsets)
        words = np.diff(at)
        chars = _sums(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        symbols, marks = _sums(_SYMBOL[data], offsets), _sums(_MARK[data], offsets)
        lines, again = _lines(data, offsets)
        repeats = _repeats(data, starts, ends, at)
        one = np.maximum(words, 1)
        values = (np.log(np.maximum(chars, 1) / one), np.sqrt(symbols / one), np.sqrt(marks / np.maximum(chars, 1)), again / np.maximum(lines, 1), repeats / one)
        base.append(np.stack([words, chars, symbols, again, repeats], 1))
        vectors.append(np.rint(np.stack(values, 1) * _SCALE).astype(np.int64))
    return np.concatenate(base), np.concatenate(vectors)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the columns of BASE, base_failed, and the vector z0 to z4, of every row of docs."""
    kinds = dict(docs.dtypes)
    text_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, vectors = statistics(b.column("text"))
            columns = [b.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(x)) for x in (*base.T, *vectors.T))], ["doc_id", "lang", "source", *BASE, *_Z])

    schema = ", ".join([f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")] + [f"{c} long" for c in (*BASE, *_Z)])
    found = docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _cell() -> Column:
    return F.concat(F.lit("s"), F.to_json(F.struct("lang", "source")))


def _cells(vectors: DataFrame) -> DataFrame:
    """cell (language and source) and the group that its estimate comes from: itself, small cells of its language, small cells of all, or null."""
    counted = vectors.groupBy("cell", "tongue").agg(F.count(F.lit(1)).alias("n"))
    tongues = counted.filter(F.col("n") < LEAST_ROWS).groupBy("tongue").agg(F.sum("n").alias("n_tongue"))
    rest = tongues.filter(F.col("n_tongue") < LEAST_ROWS).agg(F.sum("n_tongue").alias("n_rest"))
    group = (
        F.when(F.col("n") >= LEAST_ROWS, F.col("cell"))
        .when(F.col("n_tongue") >= LEAST_ROWS, F.col("tongue"))
        .when(F.col("n_rest") >= LEAST_ROWS, F.lit("rest"))
    )
    return counted.join(tongues, "tongue", "left").join(F.broadcast(rest)).select("cell", group.alias("group"))


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of a row's vector."""
    off = [F.col(z) - F.get(mean, F.lit(j)) for j, z in enumerate(_Z)]
    terms = [F.get(inverse, F.lit(i)) * off[j] * off[k] * (1 if j == k else 2) for i, (j, k) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _total(rows: DataFrame, *by: str) -> DataFrame:
    """Exact sums of vectors and their products around the group's middle (array mid of whole numbers)."""
    off = [F.col(z) - F.get("mid", F.lit(j)) for j, z in enumerate(_Z)]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("mid").alias("mid"),
        F.array(*(F.sum(x) for x in off)).alias("sums"),
        F.array(*(F.sum(off[j] * off[k]) for j, k in _PAIRS)).alias("products"),
    )


def _solved(totals: DataFrame, factor: float) -> DataFrame:
    """group, start, mid, mean, inverse (of the covariance times factor, with the floors) and logdet of each row of totals: one small row for each group and start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                around = np.array(r.sums, float) / r.n
                cov = np.empty((_D, _D))
                for (j, k), x in zip(_PAIRS, r.products, strict=True):
                    cov[j, k] = cov[k, j] = x / r.n - around[j] * around[k]
                rows.append((r.group, r.start, list(r.mid), *_inverse(np.array(r.mid) + around, cov * factor)))
            yield pd.DataFrame(rows, columns=["group", "start", "mid", "mean", "inverse", "logdet"])

    return totals.mapInPandas(run, "group string, start int, mid array<long>, mean array<double>, inverse array<double>, logdet double")


def _inverse(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    whole = cov + np.diag((np.array(FLOORS) * _SCALE) ** 2)
    inverse = np.linalg.inv(whole)
    return mean.tolist(), [float(inverse[j, k]) for j, k in _PAIRS], float(np.linalg.slogdet(whole)[1])


def _starts(vectors: DataFrame) -> DataFrame:
    """Medians with three scatters: independent deviations, correlations of tanh, and of directions (as in the deterministic MCD of Hubert et al., 2012)."""
    half = lambda c: F.percentile(c, F.lit(0.5)).cast("long")  # noqa: E731  exact; its state is bounded by the values a statistic can take
    mids = stash(vectors.groupBy("group").agg(F.array(*(half(F.col(z)) for z in _Z)).alias("mid")), "middles")
    groups = mids.count()
    placed = vectors.join(small(mids, groups), "group")
    spread = stash(placed.groupBy("group").agg(F.first("mid").alias("mid"), F.array(*(half(F.abs(F.col(z) - F.get("mid", F.lit(j)))) for j, z in enumerate(_Z))).alias("spread")), "spreads")
    scale = [F.greatest(1.4826 * F.get("spread", F.lit(j)), F.lit(f * _SCALE)) for j, f in enumerate(FLOORS)]
    scaled = vectors.join(small(spread, groups), "group").select("group", "mid", "spread", *(((F.col(z) - F.get("mid", F.lit(j))) / scale[j]).alias(z) for j, z in enumerate(_Z)))
    far = F.greatest(F.sqrt(sum(F.col(z) * F.col(z) for z in _Z)), F.lit(1e-9))
    whole = lambda c: F.round(c * 2**20).cast("long")  # noqa: E731  sums of whole numbers are exact
    tanh, way = [F.tanh(F.col(z)) for z in _Z], [F.col(z) / far for z in _Z]
    both = scaled.groupBy("group").agg(F.first("mid").alias("mid"), F.first("spread").alias("spread"), *(F.array(*(F.sum(whole(x[j] * x[k])) for j, k in _PAIRS)).alias(n) for n, x in (("tanh", tanh), ("way", way))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                for start, products in enumerate((None, r.tanh, r.way)):
                    like = np.eye(_D)
                    if products is not None:
                        for (j, k), x in zip(_PAIRS, products, strict=True):
                            like[j, k] = like[k, j] = x
                        root = np.sqrt(np.maximum(np.diag(like), 1.0))
                        like = like / root / root[:, None]
                        np.fill_diagonal(like, 1.0)
                    deviation = 1.4826 * np.array(r.spread, float)
                    rows.append((r.group, start, list(r.mid), *_inverse(np.array(r.mid, float), like * deviation * deviation[:, None])))
            yield pd.DataFrame(rows, columns=["group", "start", "mid", "mean", "inverse", "logdet"])

    return both.mapInPandas(run, "group string, start int, mid array<long>, mean array<double>, inverse array<double>, logdet double")


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """group, mean and inverse covariance of the nearest rows of each group of vectors (group, z0 to z4).

    A concentration step takes the rows up to the middle of the squared distances, in steps of 1/64 of a doubling, all rows of the last step included.
    """
    state = stash(_starts(vectors), "starts")
    rows = state.count()
    step = F.floor(F.log2(1 + _distance()) * 64).cast("int")
    marked = None
    for done in range(FIRST_STEPS + MOST_STEPS):
        near = vectors.join(small(state, rows), "group").withColumn("step", step)
        half = near.groupBy("group", "start").agg(F.percentile("step", F.lit(0.5)).alias("most"))
        inner = near.join(small(half, rows), ["group", "start"]).filter("step <= most")
        state = stash(_solved(_total(inner, "group", "start"), _consistent(0.5)), "concentrated")
        if done + 1 == FIRST_STEPS:
            state = state.groupBy("group").agg(F.min(F.struct("logdet", "start", "mid", "mean", "inverse")).alias("best")).select("group", "best.*")
        mark = state.agg(F.bit_xor(F.xxhash64("group", "start", "logdet"))).first()[0]
        if mark == marked:
            break
        marked = mark
    weighed = vectors.join(small(state, rows), "group").filter(_distance() <= chi2_quantile(0.975))
    return stash(_solved(_total(weighed, "group", "start"), _consistent(0.975)), "estimates").select("group", "mean", "inverse")


def reject_outliers(docs: DataFrame) -> DataFrame:
    """Every row of docs with the statistics of its text and whether it is kept.

    docs: doc_id, text, lang, source; other columns are ignored. Texts are read whole; a null text has no words. Rows are
    judged one by one, so a repeated row or doc_id comes back as often as it is there; equal vectors of a group count once
    in its estimate, so that copies do not make up a group's middle. Null languages and sources are groups like others.
    An empty table gives an empty table.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared
    Mahalanobis distance divided by 1 + 50 / words; null where the base rules fail or no group is large enough).
    """
    found = stash(text_statistics(docs), "statistics").withColumn("cell", _cell())
    passed = found.filter("NOT base_failed").select("cell", F.concat(F.lit("l"), F.to_json(F.struct("lang"))).alias("tongue"), *_Z).distinct()
    distinct = stash(passed, "vectors")
    cells = stash(_cells(distinct), "cells")
    n_cells = cells.count()
    vectors = stash(distinct.join(small(cells, n_cells), "cell").filter("group IS NOT NULL").select("group", *_Z), "grouped")
    fitted = robust_estimates(vectors).withColumnRenamed("group", "_group")
    known = small(cells.join(fitted, cells["group"] == fitted["_group"]).select(F.col("cell").alias("_cell"), "mean", "inverse"), n_cells)
    judged = found.join(known, (F.col("cell") == F.col("_cell")) & ~F.col("base_failed"), "left")
    distance = _distance() / (1 + SHORT / F.greatest("n_words", F.lit(1)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(QUANTILE), F.lit(True))
    return judged.withColumn("distance", distance).select("doc_id", *BASE, "base_failed", kept.alias("kept"), "distance")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_outliers(table(spark, sf_dir, "documents"))
