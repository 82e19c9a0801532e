"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's token share is raised to an exponent between 0 (all sources alike) and 1 (as they come) and normalised.
The exponent is bisected to meet a target entropy or a limit on repetition. Each source then becomes a stream of
epochs, every epoch a new permutation of its documents by hash, cut where its token budget ends; blocks of a fixed token
budget take from every stream its weight, and are permuted inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import Kept, small, stash, table

BLOCK_TOKENS, BUCKET_ROWS, SEED = 1 << 20, 4_000, 17
#: So many sources are broadcast, five numbers each; more are joined by a shuffle.
FEW_SOURCES = 20_000
#: So many beginnings of blocks, a hash and a number each, are broadcast.
FEW_STARTS = 500_000


def token_count() -> Column:
    """A document's tokens, taken as a quarter of its UTF-8 bytes, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4)).cast("long")


def _bisect(shares: DataFrame, meets, steps: int = 42) -> float:
    """The largest exponent in [0, 1] that meets, where all smaller ones do, or the smallest where all larger ones do; shares: ln_share.

    Three bisection steps are made in each pass over the sources: it sums at the seven exponents that they may ask for.
    """
    low, high = 0.0, 1.0
    for _ in range(steps // 3):
        grid = [low + (high - low) * k / 8 for k in range(9)]
        sums = shares.agg(*(x for k in range(1, 8) for x in (F.sum(F.exp(grid[k] * F.col("ln_share"))).alias(f"z{k}"), F.sum(F.exp(grid[k] * F.col("ln_share")) * F.col("ln_share")).alias(f"e{k}")))).first()
        a, b = 0, 8
        while b - a > 1:
            k = (a + b) // 2
            a, b = (k, b) if meets(grid[k], sums[f"z{k}"], sums[f"e{k}"]) else (a, k)
        low, high = grid[a], grid[b]
    return (low + high) / 2


def temperature(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None = None) -> tuple[float, float, float]:
    """Exponent, token budget and total of tokens for totals (source, tokens).

    target_entropy (0 to 1, of the logarithm of the number of sources): the largest exponent that reaches it.
    max_repeats: the smallest exponent at which no document comes more often than that. Without a budget, the budget is
    the least one at which every document comes at least once. A budget that no exponent meets with max_repeats raises
    ValueError.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    s = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if not s["n"]:
        return 1.0, 0.0, 0.0
    total, low, high = float(s["t"]), s["lo"] / s["t"], s["hi"] / s["t"]
    shares = totals.select(F.ln(F.col("tokens") / total).alias("ln_share"))

    def least(a: float, z: float) -> float:
        """The budget at which the source that is repeated least comes once."""
        return total * z * max(low ** (1 - a), high ** (1 - a))

    if max_repeats is not None and budget is not None and budget > max_repeats * total * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens takes {budget / total:.3g} epochs of all sources, over max_repeats={max_repeats}")
    if s["n"] == 1:
        exponent = 1.0
    elif target_entropy is not None:
        exponent = _bisect(shares, lambda a, z, e: math.log(z) - a * e / z >= target_entropy * math.log(s["n"]))
    elif budget is None:
        exponent = 0.0 if high / low <= max_repeats else _bisect(shares, lambda a, z, e: (high / low) ** (1 - a) > max_repeats)
    else:
        exponent = _bisect(shares, lambda a, z, e: budget / total * max(low ** (a - 1), high ** (a - 1)) / z > max_repeats)
    z = shares.agg(F.sum(F.exp(exponent * F.col("ln_share")))).first()[0]
    return exponent, budget if budget is not None else least(exponent, z), total


def mix_sources(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, tokens: Column | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
    text_hash: Column | None = None,
) -> DataFrame:
    """docs (doc_id, text, source, ...), each row as often as its source's weight asks, with epoch, block and position appended (columns of these names are replaced).

    Give target_entropy or max_repeats (see temperature), and, where docs has no text, tokens and text_hash. A null source is a source of its own, a null or empty text
    counts one token; rows that repeat are documents of their own. The order is by a hash of doc_id and text, so that rows
    without a doc_id, or with one doc_id, are spread as well; ties go by doc_id, then tokens. An empty table gives an empty table.
    """
    docs = docs.drop("epoch", "block", "position")
    names = docs.columns
    sized = _sized(docs, tokens, text_hash)
    plan, few = _plan(sized, target_entropy, max_repeats, budget)
    blocks = _placed(_drawn(sized, plan, few, seed), block_tokens).filter("block IS NOT NULL")
    order = W.partitionBy("block").orderBy(*PLACES)
    return blocks.withColumn("_slot", _slot(seed)).withColumn("position", F.row_number().over(order).cast("long")).select(*names, "epoch", "block", "position")


#: What orders the rows of a block.
PLACES = ["_slot", "doc_id", "epoch", "_tokens"]


def _slot(seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed + 1), "epoch", "_own"))


def _sized(docs: DataFrame, tokens: Column | None, text_hash: Column | None) -> DataFrame:
    """docs with _tokens and _own, from which orders are hashed."""
    own = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text") if text_hash is None else text_hash)
    return docs.withColumn("_tokens", token_count() if tokens is None else tokens).withColumn("_own", own)


def _plan(sized: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None) -> tuple[DataFrame, bool]:
    """Each source's weight, token budget, epochs and buckets, and whether sources are few."""
    kept = Kept()
    totals = kept(sized.groupBy("source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("_rows")))
    exponent, room, total = temperature(totals, target_entropy, max_repeats, budget)
    raised = F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(exponent))
    found = totals.agg(F.sum(raised).alias("norm"), F.count("*").alias("n")).first()
    norm, few = found["norm"] or 1.0, found["n"] <= FEW_SOURCES
    kept.drop()
    share = totals.withColumn("_weight", raised / F.lit(norm)).withColumn("_room", F.round(F.col("_weight") * F.lit(room)))
    plan = share.select(
        F.col("source").alias("_of"), "_weight", "_room",
        F.greatest(F.ceil(F.col("_room") / F.col("tokens")), F.lit(1)).cast("int").alias("_epochs"),
        F.ceil(F.col("_rows") / BUCKET_ROWS).cast("int").alias("_buckets"),
    )
    return plan, few


def _drawn(sized: DataFrame, plan: DataFrame, few: bool, seed: int) -> DataFrame:
    """Rows once for each epoch, with their source's _key, and _h and _bucket, which order them in it."""
    drawn = sized.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_of"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
    # a key that is never null, so that the window's partitioning serves the join with what comes before as well
    drawn = drawn.withColumn("_key", F.coalesce(F.concat(F.lit("of "), "_of"), F.lit("none"))).drop("_of")
    drawn = drawn.withColumn("_h", F.md5(F.concat_ws("-", F.lit(seed), "epoch", "_own")))
    return drawn.withColumn("_bucket", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2**32 * F.col("_buckets")).cast("int"))


def _placed(drawn: DataFrame, block_tokens: int) -> DataFrame:
    """drawn with each row's block, null where its source's budget has ended."""
    # the place of a document in its source's stream: what the buckets before hold, and what comes before in its own
    heads = drawn.groupBy("_key", "epoch", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    before = heads.withColumn("_base", F.sum("_sum").over(W.partitionBy("_key").orderBy("epoch", "_bucket").rowsBetween(W.unboundedPreceding, -1)))
    inner = W.partitionBy("_key", "epoch", "_bucket").orderBy("_h", "doc_id", "_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = drawn.withColumn("_inner", F.coalesce(F.sum("_tokens").over(inner), F.lit(0)))
    placed = placed.join(before.select("_key", "epoch", "_bucket", "_base"), ["_key", "epoch", "_bucket"])
    placed = placed.withColumn("_at", F.coalesce("_base", F.lit(0)) + F.col("_inner"))
    return placed.withColumn("block", F.when(F.col("_at") < F.col("_room"), F.floor(F.col("_at") / (F.col("_weight") * block_tokens)).cast("long")))


def lay_out(docs: DataFrame, max_repeats: float, text_hash: Column | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...), each row as often as mix_sources gives it, block by block in the order of the places there; whole rows are shuffled once.

    Places are worked out on ids, sizes and hashes. As a bucket is in the order of a hash, the hashes at which its blocks begin say where
    a row belongs, so rows go from where they lie to their block. Rows that are equal in id and text, and lie where blocks begin, are dealt to these.
    """
    names = docs.columns
    sized = _sized(docs.drop("epoch", "block", "position"), None, text_hash)
    slim = stash(sized.select("doc_id", "source", "_tokens", "_own"), "sizes")
    plan, few = _plan(slim, None, max_repeats, None)
    plan = stash(plan, "plan")
    lean = _drawn(slim, plan, few, seed).select("_key", "epoch", "_bucket", "_h", "doc_id", "_tokens", "_weight", "_room")
    firsts = _placed(lean, block_tokens).groupBy("_key", "epoch", "_bucket", "block").agg(F.min("_h").alias("from"))
    starts = stash(firsts.groupBy("_key", "epoch", "_bucket").agg(F.sort_array(F.collect_list(F.struct("from", "block"))).alias("_starts")), "starts")
    entries = starts.agg(F.sum(F.size("_starts"))).first()[0] or 0
    rows = _drawn(sized, plan, few, seed).join(small(starts, entries, FEW_STARTS), ["_key", "epoch", "_bucket"])
    here = F.filter("_starts", lambda x: x["from"] == F.col("_h"))
    any_of = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.size("_here")).cast("int")
    last = F.element_at(F.filter("_starts", lambda x: x["from"] <= F.col("_h")), -1)
    rows = rows.withColumn("_here", here).withColumn("block", F.when(F.size("_here") > 1, F.get("_here", any_of)).otherwise(last)["block"])
    rows = rows.filter("block IS NOT NULL").withColumn("_slot", _slot(seed)).select(*dict.fromkeys([*names, "block", *PLACES]))
    return rows.repartition("block").sortWithinPartitions("block", *PLACES).select(*names)


MAX_REPEATS = 2.0


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("tokens", token_count())
    return mix_sources(docs, max_repeats=MAX_REPEATS).select("doc_id", "source", "tokens", "epoch", "block", "position")


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, greatest(1, ceil(coalesce(strlen(text), 0) / 4.0))::BIGINT AS tokens,
    concat_ws('-', coalesce(doc_id::VARCHAR, ''), md5(text)) AS own FROM documents
), t AS (
  SELECT source, sum(tokens)::DOUBLE AS st FROM d GROUP BY source
), m AS (
  SELECT sum(st) AS total, min(st) AS lo, max(st) AS hi,
    CASE WHEN max(st) / min(st) <= {MAX_REPEATS} THEN 0.0 ELSE 1 - ln({MAX_REPEATS}) / ln(max(st) / min(st)) END AS a FROM t
), z AS (
  SELECT any_value(a) AS a, any_value(total) AS total, sum(pow(st / total, a)) AS z, max(st / pow(st / total, a)) AS r FROM t, m
), p AS (
  SELECT source, st, pow(st / total, a) / z AS w, round(pow(st / total, a) * r) AS room FROM t, z
), e AS (
  SELECT d.*, w, room, unnest(range(0, greatest(1, ceil(room / st))::INT)) AS epoch FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), s AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY epoch, md5('{SEED}-' || epoch || '-' || own), doc_id, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e
), b AS (
  SELECT *, floor(pos / (w * {BLOCK_TOKENS}))::BIGINT AS block FROM s WHERE pos < room
)
SELECT doc_id, source, tokens, epoch::INT AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('{SEED + 1}-' || epoch || '-' || own), doc_id, epoch, tokens) AS position
FROM b
"""
