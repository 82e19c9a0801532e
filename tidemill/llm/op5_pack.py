"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Tokens are made word by word: the default tokenizer drops white space and no token or normalisation crosses it, so each
task tokenises every distinct word once; any other is given whole texts. Only longer documents are cut. Pieces of a full sequence stay alone; the others
make groups of GROUP pieces as they come (whatever their source), so that sequences keep to the order of a mixture; each
group is packed best fit decreasing and then improved; all bins that are still open meet those of other groups in a second round.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import stash, table, text_batches
from tidemill.llm.words import chunks, tidy

CAPACITY, GROUP, END_ID = 4096, 4096, 1
#: Words whose tokens a task remembers; the memory is emptied when it is full, which changes no result.
MEMORY = 500_000


#: The default tokenizer, which is known to drop white space and to cut where WordTokens.distinct does.
BY_WORD = "word_bpe_49k.json"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(BY_WORD)


#: ASCII marks that are tokens apart from a letter or digit before them (an apostrophe may join what follows).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of small letters of Latin-1, which lower-casing and composition (NFC) leave alone.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


class TextTokens:
    """Token ids of whole texts as little-endian bytes, by any tokenizer."""

    made: dict[str, TextTokens] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    @classmethod
    def of(cls, path: str) -> TextTokens:
        """One for each Python worker, so that tasks share what they know. Only the default tokenizer is known to work word by word."""
        if path not in cls.made:
            cls.made[path] = WordTokens(path) if os.path.basename(path) == BY_WORD else TextTokens(path)
        return cls.made[path]

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, four bytes an id; null counts as empty."""
        for text in texts:
            ids = self.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids
            yield pack_ids(len(ids), ids)


class WordTokens(TextTokens):
    """Token ids of texts as little-endian bytes, each distinct word tokenised once."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(path)
        self.memory: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def _learn(self, words: list[str]) -> None:
        """Words of PLAIN letters are one piece that normalisation leaves as it is: the model alone makes their tokens."""
        tokenize, letters, memory, rest = self.model.tokenize, self.letters, self.memory, []
        for w in words:
            if PLAIN(w):
                ids = [t.id for t in tokenize(w if w.isascii() else w.translate(letters))]
                memory[w] = pack_ids(len(ids), ids)
            else:
                rest.append(w)
        for a in range(0, len(rest), 5000):
            part = rest[a : a + 5000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            memory.update(zip(part, (pack_ids(len(e), e.ids) for e in found), strict=True))

    def _ids(self, words: list[str]) -> pa.Array:
        """Ids of distinct words. A memory that would be over-full keeps what these words need."""
        found = list(map(self.memory.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            if len(self.memory) + len(new) > MEMORY:
                self.memory = {w: x for w, x in zip(words, found, strict=True) if x is not None}
            self._learn([words[i] for i in new])
            for i in new:
                found[i] = self.memory[words[i]]
        return pa.array(found, pa.large_binary())

    def distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words. A word that ends in marks after a letter or digit is that word and those marks; ASCII case makes no difference, but in a special token."""
        core = pc.ascii_rtrim(words, characters=MARKS)
        apart = pc.and_(pc.match_substring_regex(core, r"[\p{L}0-9]$"), pc.invert(pc.match_substring(words, "<|")))
        low = pc.if_else(apart, pc.ascii_lower(core), words).dictionary_encode()
        more = np.flatnonzero(pc.and_(apart, pc.not_equal(core, words)).to_numpy(zero_copy_only=False))
        size = pc.utf8_length(core.take(pa.array(more))).to_numpy().tolist()
        tails = pa.array([w[n:] for w, n in zip(_strings(words.take(pa.array(more))), size, strict=True)], pa.large_string()).dictionary_encode()
        ids = self._ids([*_strings(low.dictionary), *_strings(tails.dictionary), ""])
        at = np.full(len(words), len(ids) - 1)  # most words have no marks: the ids of ""
        at[more] = len(low.dictionary) + tails.indices.to_numpy()
        return pc.binary_join_element_wise(ids.take(low.indices), ids.take(pa.array(at)), pa.scalar(b"", pa.large_binary()))

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, four bytes an id; null counts as empty."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        ids = self.distinct(words.dictionary).take(words.indices)
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1][at] if len(ids) else np.zeros(len(at), np.int64)
        data = memoryview(data or b"")
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield bytes(data[lo:hi])


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes several times as long


def pack_ids(n: int, ids: list[int]) -> bytes:
    return struct.pack(f"<{n}I", *ids)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TextTokens.of(path)
        end, width = pack_ids(1, [end_id]), 4 * capacity
        for batch in batches:
            text = batch.column("text")
            for lo, hi, _, _ in chunks(text, 8_000_000):
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(tokens(text[lo:hi]), lo):
                    own = ids + end
                    for p, a in enumerate(range(0, len(own), width)):
                        x = own[a : a + width]
                        doc.append(i)
                        piece.append(p)
                        start.append(a // 4)
                        length.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        if with_ids:
                            kept.append(np.frombuffer(x, "<i4"))
                cols = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def best_fit(length: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: each item goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        at = bisect_left(open_rooms, size)
        if at < len(open_rooms):
            left = open_rooms[at]
            b = room[left].pop()
            if not room[left]:
                del open_rooms[at]
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left -= size
        if left:
            if not room[left]:
                insort(open_rooms, left)
            room[left].append(b)
    return bins


def local_search(length: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties bins by moving one item, or exchanging one or two for one, between underfull bins.

    The emptiest bin gives; of all moves and exchanges that fit, the one is made that most increases the sum of
    squared fills. A bin for which there is none is settled. Each step increases that sum, so the search ends.
    """
    fill = np.array([length[b].sum() for b in bins], np.int64) if bins else np.empty(0, np.int64)
    bins = [list(b) for b in bins]
    of = np.zeros(len(length), np.int64)
    for k, b in enumerate(bins):
        of[b] = k
    settled = fill >= capacity
    while not settled.all():
        giver = int(np.argmin(np.where(settled, capacity + 1, fill)))
        own = bins[giver]
        if not own:
            settled[giver] = True
            continue
        room = capacity - fill
        room[giver] = 0
        takes = np.flatnonzero(room)
        if not len(takes):
            settled[giver] = True
            continue
        singles = list(dict.fromkeys(length[own].tolist()))
        best = (0, None)
        if (room.max() >= min(singles)):
            for size in singles:
                fits = np.where(room >= size, fill, -1)
                b = int(np.argmax(fits))
                rise = 2 * size * (int(fill[b]) - int(fill[giver])) + 2 * size * size
                if fits[b] >= 0 and rise > best[0]:
                    best = (rise, ([own[int(np.flatnonzero(length[own] == size)[0])]], b, None))
        items = np.flatnonzero(room[of] > 0)
        there, space = length[items], room[of[items]]
        # all lengths and sums of two that the bin can give: their number is bounded by the capacity
        held = np.array(own)
        u, count = np.unique(length[held], return_counts=True)
        x, y = np.triu_indices(len(u))
        x, y = x[(x < y) | (count[x] > 1)], y[(x < y) | (count[x] > 1)]
        sizes, pick = np.unique(np.concatenate([u, u[x] + u[y]]), return_index=True)
        # for an item given back, the largest that fits rises most
        k = np.searchsorted(sizes, there + space, "right") - 1
        gain = sizes[np.maximum(k, 0)] - there
        rise = np.where((k >= 0) & (gain > 0), 2 * gain * (fill[of[items]] - fill[giver]) + 2 * gain * gain, 0)
        j = int(np.argmax(rise)) if len(items) else 0
        if len(items) and rise[j] > best[0]:
            g = int(pick[k[j]]) - len(u)
            if g < 0:
                out = [int(held[length[held] == u[g + len(u)]][0])]
            else:
                out = [int(held[length[held] == u[x[g]]][0]), int(held[length[held] == u[y[g]]][-1])]
            best = (int(rise[j]), (out, int(of[items[j]]), int(items[j])))
        if best[1] is None:
            settled[giver] = True
            continue
        out, taker, back = best[1]
        for i in out:
            bins[giver].remove(i)
            bins[taker].append(i)
            of[i] = taker
        if back is not None:
            bins[taker].remove(back)
            bins[giver].append(back)
            of[back] = giver
        for b in (giver, taker):
            fill[b] = length[bins[b]].sum()
        if fill[taker] >= capacity:
            settled[taker] = True
    return [b for b in bins if b]


PACKED = "key long, length long, bin long, offset long, fill long"


def _packed(capacity: int, round_: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key").reset_index(drop=True)
        length = part["length"].to_numpy(np.int64)
        bins = best_fit(length, capacity)
        if round_:
            # the bins as they come, unless packing them anew already needs fewer
            old = [list(x) for x in part.groupby("bin").indices.values()]
            bins = min(old, bins, key=len)
        bins = local_search(length, bins, capacity)
        out = part.loc[[i for b in bins for i in b], ["key", "length"]].reset_index(drop=True)
        first = np.concatenate([[0], np.cumsum([len(b) for b in bins])])
        ends = np.cumsum(out["length"].to_numpy())
        before = np.concatenate([[0], ends])[first]
        out["bin"] = (int(part["grp"].iloc[0]) * 2 + round_) * (1 << 24) + np.repeat(np.arange(len(bins)), np.diff(first))
        out["offset"] = ends - out["length"] - np.repeat(before[:-1], np.diff(first))
        out["fill"] = np.repeat(np.diff(before), np.diff(first))
        return out

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Bins for pieces (key long, unique; length long, 1 to capacity): key, sequence_id, offset.

    Pieces are grouped in the order of their keys, which are of monotonically_increasing_id: a task's number, then the
    row's in it.
    """
    full = pieces.filter(F.col("length") >= capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = pieces.filter(F.col("length") < capacity).select("key", "length")
    task, row = F.shiftright("key", 33), F.col("key").bitwiseAND((1 << 33) - 1)
    # what the tasks before have; one row for each task, so that it can be broadcast
    before = pieces.groupBy(task.alias("task")).agg((F.max(row) + 1).alias("n"))
    before = before.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = small.withColumn("task", task).join(F.broadcast(before), "task").select("key", "length", F.floor((F.col("before") + row) / group).cast("long").alias("grp"))
    first = stash(placed.groupBy("grp").applyInPandas(_packed(capacity, 0), PACKED), "packed")
    is_open = F.col("fill") < capacity
    left = first.filter(is_open)
    regroups = max(1, -(-left.count() // group))
    second = left.select("key", "length", "bin", F.pmod(F.xxhash64("bin"), F.lit(regroups)).alias("grp")).groupBy("grp").applyInPandas(_packed(capacity, 1), PACKED)
    return full.union(first.filter(~is_open).union(second).select("key", F.col("bin").alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id, text; other columns are ignored) into sequences of at most capacity tokens.

    tokenizer is the path of a tokenizers file on every executor, by default word_bpe_49k.json. A document is its ids
    without special tokens, then end_id; a null or empty text is end_id alone. Documents longer than capacity are cut
    into pieces of capacity tokens, the last may be shorter. Returns per piece doc_id, piece, start, length,
    ids_crc32, sequence_id, offset and, if with_ids, ids. A repeated row or doc_id is packed each time it comes, a
    null doc_id is carried along; an empty table gives an empty table.
    """
    text_batches(docs.sparkSession, 2000)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = slim.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, end_id, with_ids), schema)
    pieces = stash(made.withColumn("key", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity, group), "key").drop("key")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
