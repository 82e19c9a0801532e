"""Quality by random-indexing word vectors and a two-layer network in numpy.

Tokens are runs of letters, of digits, of line ends, or of one mark. Every hashed token and every shape (case and length of a
word, a word that is said again, a mark and how often it is repeated) has a sparse random index vector; the vector of a token is the sum of the
index vectors around it in the sample. A document is the mean of its tokens' and of its shapes' vectors, and the
network's logit is divided by a temperature fitted on texts that it was not trained on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table
from tidemill.llm.op2_langid import remainder
from tidemill.llm.op8_toxicity import sampled, score_texts
from tidemill.llm.words import LOWER, Line, release

BUCKETS, SHAPES, DIM, SPARSE, REACH, HIDDEN = 1 << 15, 256, 32, 6, 2, 32
#: A word is said again if it is among so many tokens before.
AGAIN = 4
#: The classifier is fitted on at most this many labelled texts of a language and label, and within the bounds of op8_toxicity.sampled.
SAMPLE, EPOCHS = 500, 60

_KIND = np.full(256, 1, np.int16)  # letters, and bytes of other scripts
_KIND[:128] = np.arange(64, 192)
for _c in [*range(65, 91), *range(97, 123)]:
    _KIND[_c] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 11, 12, 13]] = 0
_KIND[10] = 3


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of each token, and where each text's begin."""
    kind = _KIND[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    there = kind[starts] != 0
    starts, ends = starts[there], ends[there]
    k, size = kind[starts], ends - starts
    bucket = (Line(LOWER[data]).runs(starts, ends) % np.uint64(BUCKETS)).astype(np.int32)
    capital = (data >= 65) & (data <= 90)
    upper = np.concatenate([[0], np.cumsum(capital)])
    upper = upper[ends] - upper[starts]
    head = capital[starts] if len(starts) else np.empty(0, bool)
    case = np.where(upper == 0, 0, np.where((upper == size) & (size > 1), 2, np.where(head & (upper == 1), 1, 3)))
    long = np.searchsorted([3, 6, 10, 20], size)
    shape = np.where(k == 1, case * 5 + long, np.where(k == 2, 20, np.where(k == 3, 21, 22 + ((k - 64) * 3 + np.minimum(size, 3) - 1) % (SHAPES - 23))))
    at = np.searchsorted(starts, offsets)
    again = np.zeros(len(starts), bool)
    text = np.searchsorted(at, np.arange(len(starts)), "right")
    for back in range(1, AGAIN + 1):
        again[back:] |= (bucket[back:] == bucket[:-back]) & (k[back:] == 1) & (text[back:] == text[:-back])
    shape[again] = SHAPES - 1
    return bucket, shape.astype(np.int32), at


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse random vectors: SPARSE places hold 1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    places = rng.random((n, DIM)).argsort(1)[:, :SPARSE]
    out[np.arange(n)[:, None], places] = rng.choice(np.array([-1, 1], np.float32), (n, SPARSE))
    return out


class QualityNet:
    """Random-indexing vectors and a network over their means; see the module."""

    def __init__(self, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.words, self.shapes = np.zeros((BUCKETS, DIM), np.float32), np.zeros((SHAPES, DIM), np.float32)
        wide = 2 * DIM + 2
        self.mean, self.width = np.zeros(wide), np.ones(wide)
        self.first, self.first_bias = rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN)
        self.second, self.second_bias = rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
        self.temperature, self.shift = 1.0, 0.0

    def fit_vectors(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """texts: (buckets, shapes) of each text. What stands within REACH tokens adds its index vectors."""
        word_index, shape_index = index_vectors(BUCKETS, 1), index_vectors(SHAPES, 2)
        at = np.cumsum([len(b) for b, _ in texts])
        doc = np.repeat(np.arange(len(texts)), np.diff(at, prepend=0))
        bucket, shape = (np.concatenate([x[k] for x in texts]) for k in (0, 1))
        for target, own in ((self.words, bucket), (self.shapes, shape)):
            order = np.argsort(own, kind="stable")
            for block in np.array_split(order, max(1, len(order) // 200_000)):
                total = np.zeros((len(block), DIM), np.float32)
                for step in (*range(-REACH, 0), *range(1, REACH + 1)):
                    other = block + step
                    ok = (other >= 0) & (other < len(doc))
                    ok[ok] = doc[other[ok]] == doc[block[ok]]
                    near = other[ok]
                    total[ok] += word_index[bucket[near]] + shape_index[shape[near]]
                heads = np.flatnonzero(np.diff(own[block], prepend=-1))
                target[own[block][heads]] += np.add.reduceat(total, heads, axis=0)
            target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-6)

    def pooled(self, bucket: np.ndarray, shape: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean word vector, mean shape vector, and two measures of length, for each text."""
        n = np.diff(at)
        out = np.zeros((len(n), 2 * DIM + 2))
        doc = np.repeat(np.arange(len(n)), n)
        step = 200_000
        for a in range(0, len(bucket), step):
            heads = np.flatnonzero(np.diff(doc[a : a + step], prepend=-1))
            out[doc[a + heads], :DIM] += np.add.reduceat(self.words[bucket[a : a + step]], heads, axis=0)
        count = np.bincount(doc * SHAPES + shape, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
        out[:, DIM : 2 * DIM] = count @ self.shapes
        out[:, : 2 * DIM] /= np.maximum(n, 1)[:, None]
        out[:, 2 * DIM] = np.log1p(n)
        out[:, 2 * DIM + 1] = (count > 0).sum(1) / np.sqrt(np.maximum(n, 1))
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.width @ self.first + self.first_bias, 0) @ self.second + self.second_bias

    def fit_net(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.width = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = (x - self.mean) / self.width
        parts = [self.first, self.first_bias, self.second]
        m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        step = 0
        epochs = max(epochs, 2000 * 64 // max(len(x), 1)) if len(x) < 2000 else epochs
        for _ in range(min(epochs, 400)):
            order = rng.permutation(len(x))
            for batch in (order[i : i + 64] for i in range(0, len(order), 64)):
                step += 1
                hidden = np.maximum(x[batch] @ self.first + self.first_bias, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.second + self.second_bias, -30, 30)))
                d = (p - y[batch]) / len(batch)
                back = d[:, None] * self.second * (hidden > 0)
                grads = [x[batch].T @ back + 1e-3 * self.first, back.sum(0), hidden.T @ d + 1e-3 * self.second]
                self.second_bias -= 0.05 * d.sum()
                for p_, g, a, b in zip(parts, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p_ -= 0.003 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> None:
        """Temperature with the least weighted log loss; shift makes up for the sample's share of the labels (log odds prior)."""
        self.shift = prior
        z = self.logits(x)

        def loss(t: float) -> float:
            s = z / t + self.shift
            return float((weight * (np.logaddexp(0, s) - y * s)).sum() / weight.sum())

        self.temperature = min(np.exp(np.linspace(np.log(0.3), np.log(8), 60)), key=loss)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(self.pooled(*tokens(data, offsets))) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS) -> QualityNet:
    """docs: doc_id, text, lang (for an even sample only); labels: doc_id and the label. Every fourth sampled text calibrates."""
    model = QualityNet()
    rows = sampled(docs, labels, label, sample)
    if not rows:
        return model
    made = []
    for text, _, _, _ in rows:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        made.append(tokens(data, np.array([0, len(data)]))[:2])
    y, weight = np.array([r[1] for r in rows], float), np.array([r[3] for r in rows])
    held = np.arange(len(rows)) % 4 == 0
    model.fit_vectors([t for t, h in zip(made, held, strict=True) if not h] or made)
    at = np.concatenate([[0], np.cumsum([len(b) for b, _ in made])])
    x = model.pooled(*(np.concatenate([t[k] for t in made]) for k in (0, 1)), at)
    learn = ~held if (~held).any() else held
    model.fit_net(x[learn], y[learn], epochs)

    def odds(w: np.ndarray) -> float:
        return float(np.log(((w * y).sum() + 0.5) / ((w * (1 - y)).sum() + 0.5)))

    model.calibrate(x[held], y[held], weight[held], odds(weight) - odds(np.ones(len(y))))
    del made, rows
    release()
    return model


def trained(spark: SparkSession, sf_dir: str) -> QualityNet:
    return fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    return score_texts(docs, trained(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
