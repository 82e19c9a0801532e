"""Spelling variants by a rare-first q-gram prefix filter.

One edit changes at most two bigrams of a word. So of the bigrams that two near words keep, the first in a global order, rare before
common and left before right, is among the first three of both: words are joined on these three only. The edit lies on one
side of that bigram. What is on the other side is the same in both words, so it is part of the join key, as is what is left of
the edited side when the two letters around the edit are taken out; positions then agree by themselves, and a common
bigram joins few words. Pairs are verified by their edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import stash, table, text_batches
from tidemill.llm.words import Line, mix, tidy

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 7, 2
DROP_EVERY = 31
#: A form comes so many times as often as its variant at least.
RATIO = 10
GRAMS = 3
#: The edited side is cut into pieces of two letters; of a long word, into so many longer pieces.
PIECE, MOST_PIECES = 2, 8
#: Longer words are compared by halving, as Spark's edit distance takes time with the square of a word.
LONG = 500
_BATCH_BYTES = 8_000_000


def runs(text: Column) -> Column:
    """Maximal runs of letters (A to Z, a to z, U+00C0 to U+00FF), with A to Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(RUN), F.lit(0))


def dropped(doc_id: Column, run: Column) -> Column:
    """run, without one of its letters where the checksum of document and run says so. A null doc_id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame) -> DataFrame:
    """word and n, how often it comes, of all whole texts; counted where they lie before they meet."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).select(dropped(F.col("doc_id"), F.col("run")).alias("word"))
    return each.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) of all words, and where each word's begin."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def bigram_counts(words: DataFrame) -> DataFrame:
    """gram (256 times the first code point plus the second) and how often words hold it: 8,100 rows at most, as there are 90 letters."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for b in batches:
            data, at = _letters(b.column(0))
            pairs = data[:-1].astype(np.int64) * 256 + data[1:]
            inside = np.ones(max(0, len(pairs)), bool)
            inside[at[1:-1] - 1] = False
            total += np.bincount(pairs[inside], minlength=65536)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["gram", "n"])

    return words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def rarest(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The GRAMS first bigrams of each word by rank and place: their words and places in data."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.flatnonzero(owner[:-1] == owner[1:])
    rank = ranks[data[place].astype(np.int64) * 256 + data[place + 1]]
    order = np.lexsort((place, rank, owner[place]))
    own = owner[place][order]
    nth = np.arange(len(own)) - np.searchsorted(own, own)
    return own[nth < GRAMS], place[order][nth < GRAMS]


def join_keys(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys under which words meet: word, key, and whether the word stands for itself (else it is the longer of two).

    A key holds the side and place of a rare bigram, the length of the shorter word, and its letters but for a piece (of two letters, if it is not long) beyond the bigram.
    """
    owner, place = rarest(data, at, ranks)
    line = Line(data)
    start, end = at[:-1][owner], at[1:][owner]
    out = []
    for right in (True, False):  # the side that is edited
        beyond = end - place - 2 if right else place - start
        for longer in (0, 1):
            rest = beyond - longer  # of the shorter word
            piece = np.maximum(PIECE, -(-rest // MOST_PIECES))
            pieces = np.where(rest < 0, 0, np.maximum(1, -(-rest // piece)))
            row = np.repeat(np.arange(len(owner)), pieces)
            kept = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece[row]
            last = np.maximum(rest[row] - kept - piece[row], 0)
            s, e, p = start[row], end[row], place[row]
            near, far = ((s, p + 2 + kept), (e - last, e)) if right else ((p - kept, e), (s, s + last))
            shape = ((p - s if right else e - p) * 2 + right).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (e - s - longer).astype(np.uint64)
            key = mix(mix(line.runs(*near) + shape) * np.uint64(3) + line.runs(*far) + kept.astype(np.uint64))
            out.append((owner[row], key, np.full(len(row), not longer)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by one inserted, deleted or replaced letter."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # the length of what both begin with
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


@F.pandas_udf(T.BooleanType())
def _one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words (word, n) that differ by one inserted, deleted or replaced code point, once. Words are of seven or more letters below U+0100."""
    counts = bigram_counts(words)
    ranks = np.zeros(65536, np.int64)
    for rank, r in enumerate(sorted((r["n"], r["gram"]) for r in counts.collect())):  # 8,100 rows at most
        ranks[r[1]] = rank
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    text_batches(words.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data, at = _letters(b.column(0))
                row, key, own = join_keys(data, at, shared.value)
                size = np.cumsum(np.diff(at)[row]) // _BATCH_BYTES
                for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(size)) + 1):
                    picked = pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(own[cut]), b.column(0).take(picked), b.column(1).take(picked)], ["key", "own", "word", "n"])

    # made once for each side of the join, which takes less than writing them
    keys = words.select("word", "n").mapInArrow(run, "key long, own boolean, word string, n long")
    left = keys.filter("own").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = keys.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "own")
    long = lambda c: F.length(c) > LONG  # noqa: E731  of two near words the second is as long or longer
    short = left.filter(~long("a")).join(right, "key").filter("(NOT own OR a < b) AND levenshtein(a, b, 1) = 1")
    rest = left.filter(long("a")).join(right.filter(long("b")), "key").filter("NOT own OR a < b").filter(_one_edit("a", "b"))
    return short.union(rest).select("a", "n_a", "b", "n_b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """word and root, where its chain of forms ends, of words with a form (word, form). A form is ten times as frequent, so chains are short; each round follows twice as many."""
    found = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        found = stash(found.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.drop("moved")


def spelling_variants(words: DataFrame) -> DataFrame:
    """Groups words (word, n; each word once) with their commoner spellings.

    Returns word, form (the near word of largest n, ties to the smallest in code-point order, if that n is ten times the word's or more;
    else null), root (the end of the chain of forms; the word itself without one), n, n_near (near words) and form_n. An empty table gives an empty table.
    """
    pairs = stash(near_words(words), "near")
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best"))
    known = stash(words.join(best, "word", "left").withColumn("fits", -F.col("best.less") >= RATIO * F.col("n")), "forms")
    when = lambda c: F.when(F.col("fits"), c)
    known = known.select("word", when(F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), when(-F.col("best.less")).alias("form_n"))
    roots = last_forms(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame) -> DataFrame:
    """spelling_variants() of the words of docs (doc_id, text; other columns are ignored).

    Words are runs of letters of whole texts, one letter of which count_words() takes out where a checksum says so; those of
    at least seven code points that come at least twice count. Null and empty texts have none, repeated rows count again.
    """
    return spelling_variants(stash(count_words(docs), "words"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS v FROM range(256) r(i))
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)),
    lambda s, b: xor(tab.t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h FROM runs, tab
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM words, unnest(range(1, length(word) + 1)) u(i)
), near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM (SELECT DISTINCT word, n, l || r AS less FROM cut) a JOIN words b ON a.less = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM (SELECT DISTINCT word, n, l || r AS less FROM cut) a JOIN words b ON a.less = b.word)
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS root FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""
