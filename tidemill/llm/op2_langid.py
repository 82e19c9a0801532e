"""Language ID by interpolated Kneser-Ney character language models, one per language.

Texts become letters (lower case) with one mark for everything between words. All models share one table for each
order: the n-grams seen in any language as sorted 64-bit hashes, and beside them the interpolated log probability in every
language, so a character costs one search, and only n-grams that no language has seen back off. More than GROUP
languages have a table for each GROUP of them, so that tables grow with the languages and not with their square. The language with
the lowest cross-entropy per character wins, unless that is above what its own texts reach (see LanguageModels.fit).
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import pick_texts, table, text_batches
from tidemill.llm.words import chunks, release, tidy

#: Every language is fitted, on at most SAMPLE labelled texts, of which the first MAX_CHARS characters are read; fewer of each where they would pass MANY * SAMPLE texts or CHARS characters in all.
SAMPLE, MAX_CHARS, MANY, CHARS, GROUP, ORDER = 500, 50_000, 64, 24_000_000, 16, 5
#: Letters of a language that are symbols of their own; the others are one symbol for each script. A symbol has BITS bits, and SCRIPTS symbols are left to scripts.
ALPHABET, BITS, SCRIPTS = 250, 12, 256
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def script(point: int) -> str:
    """First word of the letter's Unicode name, which names its script."""
    return unicodedata.name(chr(point), "").split(" ")[0]


def alphabets(counts: list[tuple[np.ndarray, np.ndarray]], most: int) -> np.ndarray:
    """Letters that are symbols: of each language (letters, counts) the commonest, at most most, or as many of each as all symbols allow."""
    ranked = [p[np.argsort(-n, kind="stable")] for p, n in counts]
    for bound in range(most, -1, -1):
        top = np.unique(np.concatenate([r[:bound] for r in ranked]))
        if len(top) <= (1 << BITS) - 2 - SCRIPTS:
            break
    return top


class HashTable:
    """Sorted hashes of n-gram codes, found through an index of their leading bits."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray) -> None:
        """codes: distinct; self.order puts values in the order of codes into that of the table."""
        h = codes.astype(np.uint64) * self.FACTOR
        self.order = np.argsort(h)
        bits = max(8, int(len(codes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.hashes = np.append(h[self.order], np.uint64(2**64 - 1))
        self.start = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each code, and whether it is there."""
        h = codes * self.FACTOR
        at = self.start[h >> self.shift]
        low = np.flatnonzero(self.hashes[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.hashes[at[low]] < h[low]]
        return at, self.hashes[at] == h


class LanguageModels:
    """Character models of several languages, fitted on labelled texts."""

    def __init__(self, langs: list[str], alphabet: np.ndarray, order: int, scripts: list[str] | None = None) -> None:
        self.langs, self.alphabet, self.order, self.scripts = langs, alphabet, order, scripts or []
        self.parts: list[LanguageModels] = []  # the tables of more than GROUP languages
        self.grams: list[tuple[HashTable, np.ndarray]] = []  # by order from 1: log probability [n-gram, language]
        self.contexts: list[tuple[HashTable, np.ndarray]] = []  # log weight of the next lower order [context, language]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "symbol"}

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """0 for what is no letter, 1 for letters outside the alphabet and of no known script; letters, then scripts, have the others."""
        if "symbol" not in self.__dict__:
            self.symbol = _letters().astype(np.uint16)
            if self.scripts:
                of = {x: k for k, x in enumerate(self.scripts, len(self.alphabet) + 2)}
                for c in np.flatnonzero(_letters()).tolist():
                    self.symbol[c] = of.get(script(c), 1)
            self.symbol[self.alphabet] = np.arange(2, len(self.alphabet) + 2)
        return self.symbol[points]

    @property
    def size(self) -> int:
        return len(self.alphabet) + len(self.scripts) + 2

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-gram codes of the highest order at each scored character, where each text's begin, and its letters."""
        low = pc.utf8_lower(texts)
        size = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le", "replace"), np.uint32)
        sym = self.symbols(points)
        at = np.concatenate([[0], np.cumsum(size)])
        keep = sym != 0
        letters = np.concatenate([[0], np.cumsum(keep)])
        letters = letters[at[1:]] - letters[at[:-1]]
        keep[1:] |= sym[:-1] != 0
        first = at[:-1][size > 0]
        keep[first] = sym[first] != 0  # whatever text came before
        before = np.concatenate([[0], np.cumsum(keep)])[at]
        n, pad = np.diff(before), self.order - 1
        place = np.arange(before[-1]) + np.repeat(np.arange(1, len(n) + 1) * pad, n)
        line = np.zeros(before[-1] + pad * len(n), np.uint16)
        line[place] = sym[keep]
        codes = np.zeros(len(place), np.uint64)
        for k in range(self.order):
            codes |= line[place - k].astype(np.uint64) << np.uint64(BITS * k)
        return codes, before, letters

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], order: int = ORDER, alphabet: int = ALPHABET) -> LanguageModels:
        """rows: (language, text). Every tenth text of a language calibrates instead of counting, where there are ten.

        Calibration: on those texts, the cross-entropy of the true language has a mean and a deviation that shrinks
        with length; a text is rejected if it lies further above the mean than 1.5 times the furthest of them, and is also
        nearer to what letters drawn at random would have. The
        scale that makes the winner's share of likelihood the best probability is chosen on them too.
        """
        texts: dict[str, list[str]] = defaultdict(list)
        for x, t in rows:
            texts[x].append(t)
        langs = sorted(texts)
        letters = []
        for x in langs:
            points, count = np.unique(np.frombuffer("".join(t.lower() for t in texts[x]).encode("utf-32-le", "replace"), np.uint32), return_counts=True)
            letter = _letters()[points]
            letters.append((points[letter], count[letter]))
        top = alphabets(letters, alphabet)
        rest = np.setdiff1d(np.concatenate([p for p, _ in letters]), top)
        self = cls(langs, top, order, sorted({script(c) for c in rest.tolist()})[:SCRIPTS])
        held = {x: t[::10] if len(t) >= 10 else t for x, t in texts.items()}
        if len(langs) > GROUP:
            self.parts = [cls(langs[i : i + GROUP], top, order, self.scripts) for i in range(0, len(langs), GROUP)]
        for part in self.parts or [self]:
            seen = []
            for x in part.langs:
                t = [y for i, y in enumerate(texts[x]) if i % 10] if len(texts[x]) >= 10 else texts[x]
                parts = [np.unique(self.sequences(pa.array(t[i : i + 50], pa.large_string()))[0], return_counts=True) for i in range(0, len(t), 50)]
                codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                seen.append((codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)))
            part._count(seen)
        self._calibrate(held)
        return self

    def _count(self, seen: list[tuple[np.ndarray, np.ndarray]]) -> None:
        levels = [seen]
        for n in range(self.order - 1, 0, -1):
            # counts of a lower order: how many different characters come before
            levels.append([np.unique(c & np.uint64((1 << BITS * n) - 1), return_counts=True) for c, _ in levels[-1]])
        size = self.size
        lower = lower_codes = None
        for n, level in enumerate(reversed(levels), 1):
            codes = np.unique(np.concatenate([c for c, _ in level] + ([np.arange(size, dtype=np.uint64)] if n == 1 else [])))
            contexts, context_of = np.unique(codes >> np.uint64(BITS), return_inverse=True)
            p = np.empty((len(codes), len(level)))
            weight = np.ones((len(contexts), len(level)))
            under = np.full((len(codes), len(level)), 1 / size) if n == 1 else lower[np.searchsorted(lower_codes, codes & np.uint64((1 << BITS * (n - 1)) - 1))]
            for k, (own, count) in enumerate(level):
                c = np.zeros(len(codes))
                c[np.searchsorted(codes, own)] = count
                once, twice = (count == 1).sum(), (count == 2).sum()
                discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
                total, kinds = np.bincount(context_of, c, len(contexts)), np.bincount(context_of, c > 0, len(contexts))
                there = total > 0
                weight[there, k] = discount * kinds[there] / total[there]
                p[:, k] = np.maximum(c - discount, 0) / np.maximum(total, 1)[context_of] + weight[context_of, k] * under[:, k]
            grams, ctx = HashTable(codes), HashTable(contexts)
            self.grams.append((grams, np.log(p[grams.order]).astype(np.float32)))
            self.contexts.append((ctx, np.log(weight[ctx.order]).astype(np.float32)))
            lower, lower_codes = p, codes

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per scored character [text, language], scored characters, letters."""
        codes, at, letters = self.sequences(texts)
        return np.concatenate([p._entropies(codes, at) for p in self.parts or [self]], 1), np.diff(at), letters

    def _entropies(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        out = np.zeros((len(n), len(self.langs)))
        if not len(codes):
            return out
        score = np.empty((len(codes), len(self.langs)), np.float32)
        left, sofar = None, None
        for k in range(self.order, 0, -1):
            part = codes if left is None else codes[left]
            here = part & np.uint64((1 << BITS * k) - 1)
            grams, logs = self.grams[k - 1]
            place, found = grams.find(here)
            if left is None and found.all():
                score = logs[place]
                break
            rows = np.flatnonzero(found)
            own = logs[place[rows]]
            score[rows if left is None else left[rows]] = own if sofar is None else own + sofar[rows]
            miss = np.flatnonzero(~found)
            if not len(miss):
                break
            contexts, weights = self.contexts[k - 1]
            place, found = contexts.find(here[miss] >> np.uint64(BITS))
            more = np.where(found[:, None], weights[np.minimum(place, len(weights) - 1)], np.float32(0))
            sofar = more if sofar is None else sofar[miss] + more
            left = miss if left is None else left[miss]
        full = np.flatnonzero(n)
        out[full] = -np.add.reduceat(score, at[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        return out

    def _calibrate(self, held: dict[str, list[str]]) -> None:
        self.mean, self.deviation, self.limit = (np.zeros(len(self.langs)) for _ in range(3))
        entropies, truth = [], []
        for k, x in enumerate(self.langs):
            h, n, letters = (np.concatenate(v) for v in zip(*(self.cross_entropy(pa.array(held[x][i : i + 50], pa.large_string())) for i in range(0, len(held[x]), 50)), strict=True))
            h, n = h[letters > 0], n[letters > 0]
            entropies.append(h)
            truth.append(np.full(len(h), k))
            if len(h):
                self.mean[k] = np.median(h[:, k])
                self.deviation[k] = max(0.02, np.std(h[:, k]))
                self.limit[k] = 1.5 * max(4.0, self._above(h[:, k], n, np.full(len(h), k)).max())
        h, truth = np.concatenate(entropies), np.concatenate(truth)
        losses = {}
        for scale in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            z = -scale * (h - h.min(1, keepdims=True))
            losses[scale] = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth])) if len(truth) else 0.0
        self.scale = min(losses, key=losses.get)

    def _above(self, h: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (h - self.mean[k]) / (self.deviation[k] * (1 + np.sqrt(60 / np.maximum(n, 1))))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the winner's calibrated share of likelihood, 0 for und."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        h, n, letters = self.cross_entropy(texts)
        k = h.argmin(1)
        share = 1 / np.exp(-self.scale * (h - h.min(1, keepdims=True))).sum(1)
        halfway = (self.mean[k] + np.log(min(self.size, ALPHABET + 2))) / 2  # letters of one language, however many there are in all
        known = (letters > 0) & ((self._above(h.min(1), n, k) <= self.limit[k]) | (h.min(1) <= halfway))
        return [self.langs[x] if y else UNKNOWN for x, y in zip(k, known, strict=True)], np.where(known, share, 0.0)


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by))


def fit_languages(labelled: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> LanguageModels:
    """Models from labelled (lang, text): of every language at most sample different texts (fewer beyond MANY languages or CHARS characters), chosen by a hash of the text, each as far as MAX_CHARS; null langs and texts are left out."""
    usable = labelled.select("lang", F.substring("text", 1, MAX_CHARS).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("print", F.xxhash64("text"))
    picked, _ = pick_texts(usable.select("lang", "print", F.length("text").alias("size"), F.lit(0).alias("id")), ["lang"], sample, MANY * sample, CHARS)
    rows = []
    if picked is not None:
        # copies of a picked text become one where they lie
        found = usable.join(F.broadcast(picked.select("lang", "print", "nth")), ["lang", "print"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
        rows = [(r["lang"], r["text"]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["nth"]))]
    models = LanguageModels.fit(rows, order) if rows else LanguageModels([], np.empty(0, np.uint32), order)
    release()
    return models


def identify_languages(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """docs with lang_pred and score appended (columns of these names are replaced).

    A text that is null, empty or without letters, or that no model accepts, is und with score 0. Only text is read;
    ties go to the first language by name; repeated rows and nulls elsewhere are carried along.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            for lo, hi, _, _ in chunks(text):
                lang, score = shared.value.predict(text[lo:hi].cast(pa.large_string()).fill_null(""))
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def trained(spark: SparkSession, sf_dir: str) -> LanguageModels:
    return fit_languages(table(spark, sf_dir, "documents").filter(remainder("doc_id", 5) != 0))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    return identify_languages(ids, trained(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")
