import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm.op5_pack import WordTokens, best_fit, default_tokenizer, local_search, op5_pack, pack, pack_documents

import pyarrow as pa  # isort: skip


def check(rows, out, capacity=4096):
    """Pieces are those of the tokenizer run on whole texts, and lie in sequences without gaps."""
    t = Tokenizer.from_file(default_tokenizer())
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [((i or -1), p, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for p, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"] or -1), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "Hello, world! It's 5 o'clock... <|endoftext|> x<|endoftext|>, don't!? ÀÉ中文１２"), (5, "word " * 9000), (6, "é É. A b c ‍ 'S, i̇ İx"), (2, ""), (None, "again (and) again... 12.5% [x]_y'")]
    out = pack_documents(docs(*((i, t, None, None) for i, t in rows))).collect()
    assert check(rows, out) == 3
    ids = pack_documents(docs((1, "Hello, world", None, None)), with_ids=True).first()
    assert zlib.crc32(np.array(ids["ids"], "<u4").tobytes()) == ids["ids_crc32"]
    empty = pack_documents(docs((1, "x", None, None)).limit(0))
    assert empty.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30), max_size=6))
def test_words_are_tokens(texts):
    t = Tokenizer.from_file(default_tokenizer())
    made = list(WordTokens.of(default_tokenizer())(pa.array(texts, pa.string())))
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_are_learned_once(monkeypatch):
    """A memory that runs over keeps what the words at hand need, and only words that normalisation may change go through the whole tokenizer."""
    monkeypatch.setattr("tidemill.llm.op5_pack.MEMORY", 8)
    tokens, learned, whole = WordTokens(default_tokenizer()), [], []
    inner, full = tokens._learn, tokens.tokenizer

    class Counted:
        def encode_batch_fast(self, part, **how):
            whole.extend(part)
            return full.encode_batch_fast(part, **how)

    tokens.tokenizer = Counted()
    tokens._learn = lambda words: (learned.append(sorted(words)), inner(words))[1]
    for text in ("alpha Beta gamma, été. delta straße", "Alpha beta. gamma ÉTÉ zeta, eta theta Straße"):
        made = list(tokens(pa.array([text])))
        assert np.frombuffer(made[0], "<u4").tolist() == full.encode(text, add_special_tokens=False).ids
    assert learned[1] == ["eta", "theta", "zeta", "ÉtÉ"]
    assert sorted(whole) == ["", ",", ".", "ÉtÉ"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_bins(lengths):
    length = np.array(lengths, np.int64)
    first = best_fit(length, 60)
    bins = local_search(length, first, 60)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(length[b].sum() <= 60 for b in bins) and len(bins) <= len(first)


def test_search_empties_bins():
    """No item fits elsewhere at first; an exchange makes room, then a move empties the bin."""
    length = np.array([6, 2, 5, 3, 4], np.int64)
    assert sorted(sorted(length[b].tolist()) for b in local_search(length, [[0, 1], [2, 3], [4]], 10)) == [[2, 3, 5], [4, 6]]


def test_search_looks_at_all_items():
    """The exchange that fits is of an item, or of two, that are not among the longest of their bin."""
    for give, other in (([3] * 25 + [2] * 5, [1, 198]), ([30] * 25 + [2, 3], [4, 795])):
        length = np.array(give + other, np.int64)
        n, capacity = len(give), sum(other) + 1
        found = local_search(length, [list(range(n)), [n, n + 1]], capacity)
        assert sorted(i for b in found for i in b) == list(range(n + 2))
        assert max(length[b].sum() for b in found) == capacity and all(length[b].sum() <= capacity for b in found)


def test_sequences_keep_to_the_order(spark):
    """The pieces of a sequence come from one group of consecutive rows, but for what the second round joins."""
    n, group = 5_000, 500
    pieces = spark.range(0, n, 1, 7).select(F.monotonically_increasing_id().alias("key"), F.col("id").alias("row"), (F.col("id") * 37 % 97 + 1).alias("length"))
    out = pack(pieces.select("key", "length"), 128, group).join(pieces, "key").collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r["row"] // group)
    assert len(out) == n and sum(len(set(v)) == 1 for v in by.values()) > 0.9 * len(by)


def test_other_tokenizers(spark, docs):
    """A tokenizer that is not known to work word by word is given whole texts."""
    path = default_tokenizer().replace("word_bpe_49k", "byte_bpe_50k")
    text = "Hello  World, it's  Ünï 5 o'clock...\n\nx"
    out = pack_documents(docs((1, text, None, None), (2, None, None, None)), path, with_ids=True).collect()
    ids = {r["doc_id"]: r["ids"] for r in out}
    assert ids == {1: [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1], 2: [1]}


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op5_pack(spark, sf_dir).collect()
    assert check([(i or None, t) for i, t in rows], out) <= -(-sum(r["length"] for r in out) // 4096) + 1
