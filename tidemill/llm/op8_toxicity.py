"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the mean of hashed vectors of the word and of its first bytes, so that unseen forms of a known
stem are known too. Filters of several widths run over the embeddings, the strongest answer of each in a document is
kept, and a linear layer makes the logit. Only that answer's place has a gradient, so training is cheap. Thresholds are
calibrated by language, and since none is given when a text is scored, a naive Bayes model over the same hashed words
guesses it.

Every labelled text is used. A bounded, even sample is gone through several times in the driver and gives the start; where there
are more texts, tasks go on from it, each over shards of all of them, and the changes are averaged. One text in four is
kept from learning and calibrates.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import distinct_texts, maybe, pick_distinct, stash, table, text_batches
from tidemill.llm.op2_langid import remainder
from tidemill.llm.words import LOWER, Line, bounds, chunks, release, tidy

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 17, 16, 16, (1, 2, 3), (3, 4, 5, 6)
#: The classifier begins with at most SAMPLE labelled texts of a language and label, each of at most MAX_CHARS characters; fewer of each, but of every
#: language and label, where they would pass MOST texts or CHARS characters in all. It then goes on over all labelled texts.
SAMPLE, MAX_CHARS, MOST, CHARS, EPOCHS = 500, 100_000, 32_000, 16_000_000, 6
#: Buckets of words for guessing languages, and calibrating texts of each label that a language needs for a threshold of its own.
LANG_BUCKETS, ENOUGH = 1 << 15, 20
THRESHOLD = 0.3
#: Small samples are gone through more often, to so many steps.
LEAST_STEPS = 800
BLOCK_WORDS = 100_000
#: Texts and characters of a shard of all labelled texts, about; the rate of its steps; changes are summed in units of 1 / UNIT, logits that calibrate in steps of 1 / GRID.
SHARD, SHARD_CHARS, LATE_RATE, UNIT, GRID = 2000, 8_000_000, 0.2, 1 << 20, 256
#: Values in a row of sums.
WIDE = 16


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets [word, feature] of whole words without marks at their ends, and of their first bytes; where each text's words begin."""
    starts, ends, at = bounds(data, offsets)
    low = LOWER[data]
    mark = (low < 128) & ~((low >= 97) & (low <= 122)) & ~((low >= 48) & (low <= 57))
    # leave out marks around the word, if anything is left
    letter = np.concatenate([[0], np.cumsum(~mark)])
    has = letter[ends] > letter[starts]
    places = np.append(np.flatnonzero(~mark), 0)
    inner_start = np.where(has, places[np.minimum(letter[starts], len(places) - 1)], starts)
    inner_end = np.where(has, places[np.maximum(letter[ends] - 1, 0)] + 1, ends)
    line = Line(low)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = line.runs(inner_start, inner_end) % np.uint64(BUCKETS)
    for k, n in enumerate(PREFIXES, 1):
        out[:, k] = (line.runs(inner_start, np.minimum(inner_start + n, inner_end)) + np.uint64(n * 7919)) % np.uint64(BUCKETS)
    return out, at


class TextCnn:
    """Convolution over hashed word embeddings; see the module."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        # near zero: a word that was never learned from gives no answer that would be the strongest
        self.embed = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
        # per offset in the window: filters of all widths that reach it
        self.conv = [rng.normal(0, (DIM * 2) ** -0.5, (DIM, FILTERS * sum(w > k for w in WIDTHS))).astype(np.float32) for k in range(max(WIDTHS))]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(-1.0)
        self.langs: list[str] = []  # the first stands for all that have no threshold of their own
        self.lang_logs = np.zeros((LANG_BUCKETS, 0), np.float32)
        self.cut, self.slope = np.zeros(1), 1.0

    def answers(self, feats: np.ndarray, at: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Strongest answer [text, filter], and the word where it begins if places; windows reach past a text's end into zeros."""
        n, reach = len(at) - 1, max(WIDTHS) - 1
        best = np.full((n, len(self.bias)), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64) if places else None
        doc = np.repeat(np.arange(n), np.diff(at))
        for a in range(0, len(feats), BLOCK_WORDS):
            b = min(a + BLOCK_WORDS, len(feats))
            to = min(b + reach, len(feats))
            e = self.embed[feats[a:to, 0]]
            for k in range(1, feats.shape[1]):
                e += self.embed[feats[a:to, k]]
            got = e[: b - a] @ self.conv[0]
            for k in range(1, reach + 1):
                last = min(b, len(feats) - k)
                if last > a:
                    next_ = e[k : last - a + k] * (doc[a + k : last + k] == doc[a:last])[:, None]
                    got[: last - a, -self.conv[k].shape[1] :] += next_ @ self.conv[k]
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            top = np.maximum.reduceat(got, first, axis=0)
            ids = doc[a + first]
            if places:
                for i, (x, y) in enumerate(zip(first, np.append(first[1:], b - a), strict=True)):
                    better = top[i] > best[ids[i]]
                    where[ids[i]] = np.where(better, a + x + got[x:y].argmax(0), where[ids[i]])
            best[ids] = np.maximum(best[ids], top)
        return best, where

    def logits(self, feats: np.ndarray, at: np.ndarray) -> np.ndarray:
        best, _ = self.answers(feats, at)
        return (np.maximum(best + self.bias, 0) @ self.out + self.base).astype(np.float64)

    def fit(self, texts: list[tuple[np.ndarray, int]], epochs: int, seed: int = 3) -> None:
        """texts: (features of the words, label). Adam on the dense part, Adagrad on the embeddings."""
        rng = np.random.default_rng(seed)
        self.first, self.second = [np.zeros_like(x) for x in self.dense()], [np.zeros_like(x) for x in self.dense()]
        self.seen, self.steps = np.full(BUCKETS, 0.1, np.float32), 0
        texts = [x for x in texts if len(x[0])]
        scale = np.float32(1)
        if texts:
            epochs = max(epochs, LEAST_STEPS * 32 // len(texts))
        for _ in range(epochs):
            self._epoch(texts, rng, scale)
            scale *= np.float32(0.2 ** (1 / epochs))

    def dense(self) -> list[np.ndarray]:
        return [self.bias, self.out, *self.conv]

    def flat(self) -> np.ndarray:
        """The dense part in one line."""
        return np.concatenate([*(x.reshape(-1) for x in self.dense()), [self.base]]).astype(np.float64)

    def take(self, flat: np.ndarray) -> None:
        """Sets the dense part from one line."""
        at = 0
        for x in self.dense():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.base = np.float32(flat[at])

    def copy(self) -> TextCnn:
        return copy.deepcopy(self)

    def go_on(self, texts: list[tuple[np.ndarray, int]], weight: np.ndarray, seed: int) -> np.ndarray:
        """Goes through texts (features, label) once more, each with its weight, from where fit ended. Which buckets it changed."""
        there = [i for i, x in enumerate(texts) if len(x[0])]
        changed = np.zeros(BUCKETS, bool)
        self._epoch([texts[i] for i in there], np.random.default_rng([3, seed]), np.float32(LATE_RATE), weight[there].astype(np.float32), changed)
        return changed

    def _epoch(self, texts: list[tuple[np.ndarray, int]], rng: np.random.Generator, scale: np.float32, weight: np.ndarray | None = None, changed: np.ndarray | None = None) -> None:
        dense, first, second, seen = self.dense(), self.first, self.second, self.seen
        order = rng.permutation(len(texts))
        for batch in (order[i : i + 32] for i in range(0, len(order), 32)):
            self.steps += 1
            # words are left out at random, so that no filter leans on one
            parts = [texts[i][0][rng.random(len(texts[i][0])) > 0.4] for i in batch]
            labels = np.array([texts[i][1] for i in batch], np.float32)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            feats = np.concatenate(parts)
            if not len(feats):
                continue
            best, where = self.answers(feats, at, places=True)
            pooled = np.maximum(best + self.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))
            d = ((p - labels) / len(batch)).astype(np.float32)
            if weight is not None:
                d *= weight[batch]
            d_pool = d[:, None] * self.out * (pooled > 0)
            d_pool[~np.isfinite(best)] = 0
            grads = [d_pool.sum(0), pooled.T @ d + 1e-4 * self.out]
            d_embed: list[tuple[np.ndarray, np.ndarray]] = []
            end = at[1:][:, None]
            for k in range(len(self.conv)):
                skip = len(self.bias) - self.conv[k].shape[1]
                there = where[:, skip:] + k
                ok = (there < end) & (d_pool[:, skip:] != 0)
                rows, cols = np.nonzero(ok)
                words = there[rows, cols]
                f = feats[words]
                e = self.embed[f].sum(1)
                g = d_pool[rows, skip + cols]
                grad = np.zeros_like(self.conv[k].T)
                np.add.at(grad, cols, g[:, None] * e)
                grads.append(grad.T + 1e-4 * self.conv[k])
                d_embed.append((f, g[:, None] * self.conv[k].T[cols]))
            self.base -= np.float32(0.01) * d.sum()
            for x, g, m, v in zip(dense, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= scale * 0.01 * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-7)
            f = np.concatenate([np.repeat(g[None], x.shape[1], 0).transpose(1, 0, 2).reshape(-1, DIM) for x, g in d_embed])
            ids, inverse = np.unique(np.concatenate([x.reshape(-1) for x, _ in d_embed]), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, f)
            seen[ids] += (total * total).mean(1)
            self.embed[ids] -= 0.3 * total / np.sqrt(seen[ids])[:, None]
            if changed is not None:
                changed[ids] = True

    def fit_languages(self, texts: list[tuple[np.ndarray, int]], langs: list[str]) -> None:
        """texts: (features, place in langs); smoothed counts of hashed words."""
        counts = np.zeros((LANG_BUCKETS, max(1, len(langs))), np.float32)
        for f, k in texts:
            counts[:, k] += np.bincount(f[:, 0] % LANG_BUCKETS, minlength=LANG_BUCKETS)
        self.count_languages(counts, langs)

    def count_languages(self, counts: np.ndarray, langs: list[str]) -> None:
        """counts: [bucket, place in langs]."""
        self.langs = langs
        counts = np.float32(0.1) + counts.astype(np.float32)
        self.lang_logs = np.log(counts / counts.sum(0)).astype(np.float32)

    def languages(self, feats: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        out = np.zeros(len(n), np.int64)
        full = np.flatnonzero(n)
        if len(full) and self.langs:
            total = np.zeros((len(n), self.lang_logs.shape[1]))
            doc = np.repeat(np.arange(len(n)), n)
            for a in range(0, len(feats), BLOCK_WORDS):
                first = np.flatnonzero(np.diff(doc[a : a + BLOCK_WORDS], prepend=-1))
                total[doc[a + first]] += np.add.reduceat(self.lang_logs[feats[a : a + BLOCK_WORDS, 0] % LANG_BUCKETS], first, axis=0)
            out[full] = total[full].argmax(1)
        return out

    def calibrate(self, texts: list[tuple[np.ndarray, int, float]]) -> None:
        """texts: (features, label, weight). For each guessed language the logit that divides the labels best (F1 of the weighted texts; amid the widest such gap) becomes the score THRESHOLD."""
        at = np.concatenate([[0], np.cumsum([len(f) for f, _, _ in texts])]).astype(np.int64)
        feats = np.concatenate([f for f, _, _ in texts])
        logit, lang = self.logits(feats, at), self.languages(feats, at)
        label, weight = np.array([y for _, y, _ in texts]), np.array([w for _, _, w in texts])
        self.calibrate_logits(logit, lang, label, weight, np.ones(len(label), np.int64))

    def calibrate_logits(self, logit: np.ndarray, lang: np.ndarray, label: np.ndarray, weight: np.ndarray, texts: np.ndarray) -> None:
        """As calibrate; texts: how many stand in each place."""
        self.cut = np.full(max(1, len(self.langs)), divide(logit, label, weight))
        for k in range(len(self.langs)):
            own = lang == k
            if k and min(texts[own & (label == y)].sum() for y in (0, 1)) >= ENOUGH:
                self.cut[k] = divide(logit[own], label[own], weight[own])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        feats, at = features(data, offsets)
        z = self.slope * (self.logits(feats, at) - self.cut[self.languages(feats, at)]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def divide(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The logit above which the weighted F1 is best, amid the widest gap where it is."""
    order = np.argsort(-logit, kind="stable")
    z, y, w = logit[order], label[order], weight[order]
    hits = np.cumsum(w * y)
    f1 = 2 * hits / np.maximum(np.cumsum(w) + (w * y).sum(), 1e-12)
    ends = np.append(z[1:] < z[:-1], True)
    best = f1[ends].max() - 1e-9
    below = np.append(z[1:], z[-1] - 2.0)
    good = np.flatnonzero(ends & (f1 >= best))
    k = good[np.argmax((z - below)[good])]
    return float((z[k] + below[k]) / 2)


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, max_chars: int = MAX_CHARS, most: int = MOST, chars: int = CHARS) -> list[tuple[str, int, str, float]]:
    """A bounded sample of docs (doc_id, text, lang) that labels (doc_id, and the label 0 or 1) marks: (text, label, language, rows that it stands for).

    Of every language and label at most sample different texts of at most max_chars characters, by a hash of the text; where that
    passes most texts or chars characters, a smaller share of each, one at least. Ids may repeat on both sides: each text of an id is
    marked by the largest label of that id, and copies count once. Only ids, languages and hashes are shuffled, until the texts picked are found by their ids.
    """
    return [x[:4] for x in _drawn(docs, _distinct(docs, labels, label).filter(F.col("size") <= max_chars), sample, most, chars)]


def _distinct(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The different texts that labels marks, by language and label y; see distinct_texts."""
    slim = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.length("text").alias("size"), F.xxhash64("text").alias("print"))
    one = labels.filter(f"{label} IN (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    return distinct_texts(slim.join(one, "id"), ["lang", "y"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("print"), "text")


def _drawn(docs: DataFrame, distinct: DataFrame, sample: int, most: int, chars: int) -> list[tuple[str, int, str, float, int]]:
    """The sample that sampled describes, from distinct texts, in its order: text, label, language, rows that it stands for, hash of the text."""
    picked, counts = pick_distinct(distinct, ["lang", "y"], sample, most, chars)
    if picked is None:
        return []
    found = _texts(docs).join(F.broadcast(picked), ["id", "lang", "print"]).groupBy("lang", "y", "nth").agg(F.min("text").alias("text"), F.min("print").alias("print")).collect()
    drawn = Counter((r["lang"], r["y"]) for r in found)
    return [(r["text"], r["y"], r["lang"], counts[r["lang"], r["y"]] / drawn[r["lang"], r["y"]], r["print"]) for r in sorted(found, key=lambda r: (r["lang"], r["y"], r["nth"]))]


def own_threshold(held: dict[tuple[str, int], int]) -> list[str]:
    """Languages with a threshold of their own, by calibrating texts of each language and label; the first, "", stands for all others."""
    return ["", *sorted(x for x, y in held if y == 1 and x and min(held[x, 1], held.get((x, 0), 0)) >= ENOUGH)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, epochs: int = EPOCHS, shard: int = SHARD) -> TextCnn:
    """docs: doc_id, text, lang (for an even start and the calibration by language only); labels: doc_id and the label.

    Learns from, or calibrates with, every different text that labels marks, of any length: every fourth calibrates. The sample of
    at most sample texts a language and label is gone through epochs times; if there are more texts, all are then gone through
    in shards of about shard texts.
    """
    model = TextCnn()
    distinct = _distinct(docs, labels, label)
    rows = _drawn(docs, distinct.filter(F.col("size") <= MAX_CHARS), sample, MOST, CHARS)
    langs = own_threshold(Counter((lang, y) for _, y, lang, _, _ in rows[::4]))
    place = {x: k for k, x in enumerate(langs)}
    made = []
    for text, y, lang, weight, _ in rows:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        made.append((features(data, np.array([0, len(data)]))[0], y, place.get(lang, 0), weight))
    learn = [x for i, x in enumerate(made) if i % 4] or made
    held = [x for i, x in enumerate(made) if i % 4 == 0]
    model.fit([(f, y) for f, y, _, _ in learn], epochs)
    cells = {(r["lang"], r["y"]): r["n"] for r in distinct.groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(cells.values()) > len(rows):
        roles = {(lang, y, print_): i % 4 == 0 and len(rows) > 1 for i, (_, y, lang, _, print_) in enumerate(rows)}
        del made, learn, held, rows
        release()
        _go_on(model, docs, distinct, roles, cells, shard)
    elif held:
        model.fit_languages([(f, k) for f, _, k, _ in learn], langs)
        model.calibrate([(f, y, w) for f, y, _, w in held])
        del made, learn, held, rows
    release()
    return model


def _go_on(model: TextCnn, docs: DataFrame, distinct: DataFrame, roles: dict[tuple[str, int, int], bool], cells: dict[tuple[str, int], int], shard: int) -> None:
    """Goes on from a model fitted on a sample (roles: language, label and hash of its texts, whether they calibrate) over all distinct texts.

    A shard holds texts by their hash. It is gone through from the same start, with weights by which each language and label counts as much as in
    the sample; an embedding changes by the mean of the shards that changed it, what is dense by the mean of all. Sums are of whole numbers, so the
    result depends on no order. Then languages and thresholds are made, from the words of all texts learned from and the logits of all that calibrate.
    """
    spark = docs.sparkSession
    text_batches(spark)
    drawn = Counter((lang, y) for lang, y, _ in roles)
    chars = distinct.agg(F.sum("size")).first()[0]
    shards = max(1, -(-sum(cells.values()) // shard), -(-chars // SHARD_CHARS))
    even = {k: max(1, drawn[k]) / n for k, n in cells.items()}
    mean = sum(even[k] * n for k, n in cells.items()) / sum(cells.values())
    weights = {k: v / mean for k, v in even.items()}
    known = spark.createDataFrame([(*k, v) for k, v in roles.items()], "lang string, y int, print long, known boolean")
    by_hash = F.pmod(F.xxhash64("print", F.lit(13)), F.lit(4)) == 0
    parts = stash(distinct.join(F.broadcast(known), ["lang", "y", "print"], "left").withColumn("held", F.coalesce("known", by_hash)).drop("known"), "roles")
    learned, held = parts.filter("NOT held").select("id", "lang", "print", "y"), parts.filter("held").select("id", "lang", "print", "y", "rows")
    langs = own_threshold({(r["lang"], r["y"]): r["n"] for r in held.groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n")).collect()})

    # a text comes behind the rows that mark it, so texts are shuffled once and not joined
    number = F.pmod(F.xxhash64("print", F.lit(17)), F.lit(shards)).cast("int").alias("shard")
    near = maybe(_texts(docs).filter("id IS NOT NULL"), stash(learned.select("id").distinct(), "ids"), "id").select(number, "lang", "print", "id", F.lit(None).cast("int").alias("y"), "text")
    marks = learned.select(number, "lang", "print", "id", "y", F.lit(None).cast("string").alias("text"))
    dealt = marks.union(near).repartitionById(shards, "shard").sortWithinPartitions("shard", "lang", "print", "id", F.col("y").asc_nulls_last())
    sums = dealt.mapInArrow(_changes(spark.sparkContext.broadcast(model), langs, weights), "key long, times long, " + ", ".join(f"v{i} long" for i in range(WIDE)))
    total = sums.groupBy("key").agg(F.sum("times").alias("times"), *(F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDE))).toArrow()
    key, times = (total.column(x).to_numpy() for x in ("key", "times"))
    values = np.stack([total.column(f"v{i}").to_numpy() for i in range(WIDE)], 1) if len(key) else np.zeros((0, WIDE), np.int64)
    _add_changes(model, langs, key, times, values)

    near = maybe(_texts(docs).filter("id IS NOT NULL"), stash(held.select("id").distinct(), "ids"), "id").withColumnRenamed("lang", "of")
    fields = [x for x in near.schema if x.name != "text"]
    places = near.mapInArrow(_logits(spark.sparkContext.broadcast(model)), T.StructType([*fields, T.StructField("lang", T.IntegerType()), T.StructField("step", T.LongType())]))
    marked = places.join(held.withColumnRenamed("lang", "of"), ["id", "of", "print"]).dropDuplicates(["of", "y", "print"])
    found = marked.groupBy("lang", "step", "y").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts")).toArrow().sort_by([("step", "ascending"), ("lang", "ascending"), ("y", "ascending")])
    if len(found):
        step, lang, y, rows, texts = (found.column(x).to_numpy() for x in ("step", "lang", "y", "rows", "texts"))
        model.calibrate_logits(step / GRID, lang, y, rows.astype(float), texts)


def _featured(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Features of each text of a batch."""
    for _, _, data, offsets in chunks(batch.column("text")):
        feats, at = features(data, offsets)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield feats[a:b].copy()


def _changes(shared: Broadcast, langs: list[str], weights: dict[tuple[str, int], float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows in the order of their shards: sums of the changes that each shard makes to the model, as rows of WIDE values, and of its words by language. A text's row (y null) comes behind those that mark it; texts that none marks are left out."""
    place = {x: k for k, x in enumerate(langs)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        embed, times = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
        dense, went = np.zeros(-(-(sum(x.size for x in start.dense()) + 1) // WIDE) * WIDE, np.int64), 0
        words = np.zeros((LANG_BUCKETS, len(langs)), np.int64)

        def learn(number: int, texts: list[tuple[np.ndarray, int]], weight: list[float]) -> None:
            nonlocal went
            model = start.copy()
            changed = np.flatnonzero(model.go_on(texts, np.array(weight), number))
            embed[changed] += np.rint((model.embed[changed].astype(np.float64) - start.embed[changed]) * UNIT).astype(np.int64)
            times[changed] += 1
            flat = model.flat() - start.flat()
            dense[: len(flat)] += np.rint(flat * UNIT).astype(np.int64)
            went += 1

        now, key, ys, texts, weight = None, None, [], [], []
        for batch in batches:
            about = zip(*(batch.column(x).to_pylist() for x in ("shard", "lang", "print", "id", "y")), strict=True)
            for (number, lang, print_, id_, y), f in zip(about, _featured(batch), strict=True):
                if number != now:
                    if texts:
                        learn(now, texts, weight)
                    now, texts, weight = number, [], []
                if (lang, print_, id_) != key:
                    key, ys = (lang, print_, id_), []
                if y is not None:
                    ys.append(y)
                    continue
                for label in ys:
                    texts.append((f, label))
                    weight.append(weights[lang, label])
                    words[:, place.get(lang, 0)] += np.bincount(f[:, 0] % LANG_BUCKETS, minlength=LANG_BUCKETS)
                ys = []  # the same row once more is left out
        if texts:
            learn(now, texts, weight)
        if not went:
            return
        own = np.flatnonzero(times)
        counted = words.reshape(-1, WIDE)
        some = np.flatnonzero(counted.any(1))
        tail = dense.reshape(-1, WIDE)
        keys = np.concatenate([own, BUCKETS + np.arange(len(tail)), BUCKETS + len(tail) + some])
        often = np.concatenate([times[own], np.full(len(tail), went), np.ones(len(some), np.int64)])
        rows = np.concatenate([embed[own], tail, counted[some]])
        for a in range(0, len(keys), 10_000):
            b = a + 10_000
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(often[a:b]), *(pa.array(rows[a:b, i]) for i in range(WIDE))], ["key", "times", *(f"v{i}" for i in range(WIDE))])

    return run


def _add_changes(model: TextCnn, langs: list[str], key: np.ndarray, times: np.ndarray, values: np.ndarray) -> None:
    """Adds to the model what _changes summed up, divided by how often it was changed, and takes over the words by language."""
    flat = model.flat()
    tail = -(-len(flat) // WIDE)
    own = key < BUCKETS
    model.embed[key[own]] += (values[own] / UNIT / times[own][:, None]).astype(np.float32)
    middle = (key >= BUCKETS) & (key < BUCKETS + tail)
    change = np.zeros((tail, WIDE))
    change[key[middle] - BUCKETS] = values[middle] / UNIT / times[middle][:, None]
    model.take(flat + change.reshape(-1)[: len(flat)])
    words = np.zeros((LANG_BUCKETS * len(langs) // WIDE, WIDE))
    words[key[key >= BUCKETS + tail] - BUCKETS - tail] = values[key >= BUCKETS + tail]
    model.count_languages(words.reshape(LANG_BUCKETS, len(langs)), langs)


def _logits(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with guessed language and logit, in steps of 1 / GRID, for their text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                feats, at = features(data, offsets)
                step = np.rint(model.logits(feats, at) * GRID).astype(np.int64)
                names = [x for x in batch.schema.names if x != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(x)[lo:hi] for x in names), pa.array(model.languages(feats, at).astype(np.int32)), pa.array(step)], [*names, "lang", "step"])

    return run


def score_texts(docs: DataFrame, model) -> DataFrame:
    """docs with score and predicted (score >= THRESHOLD) appended (columns of these names are replaced).

    model.scores(bytes, offsets) is called in tasks. Only text is read. A null or empty text is scored as a text
    without words; rows that repeat and nulls elsewhere are carried along; an empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(at)):
                score = np.round(shared.value.scores(data, offsets), 9)  # the same for a text whatever it is scored with
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def trained(spark: SparkSession, sf_dir: str) -> TextCnn:
    return fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    return score_texts(docs, trained(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
