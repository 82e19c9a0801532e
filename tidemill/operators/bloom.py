"""Bloom filters as tables of bitmaps, merged by or, for keys that were seen.

A key has one bucket of 32,768 bits and sets a few bits in it, so that a filter is a row for each bucket, made by grouped bitmap
aggregates and probed by one join. What a filter does not hold was never seen; what it may hold is looked up exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 32_768
#: Filters of fewer buckets (4 KB each) are broadcast; larger ones meet their rows by a shuffle.
BROADCAST_BUCKETS = 2_000


def sizes(keys: int, rate: float) -> tuple[int, int]:
    """Buckets and bits of a key, for so many different keys at that rate of false positives. A tenth is added for buckets that get more keys than others."""
    bits = -math.log(rate) / math.log(2) ** 2
    return max(1, math.ceil(1.1 * bits * max(1, keys) / BUCKET_BITS)), max(1, round(bits * math.log(2)))


@dataclass
class Bloom:
    """bits: bucket, bitmap; n buckets, and how many bits a key sets."""

    bits: DataFrame
    n: int
    each: int
    key: list[str]

    @classmethod
    def of(cls, seen: DataFrame, key: list[str], keys: int | None = None, rate: float = 0.001) -> Bloom:
        """A filter of the keys of seen. keys: how many different ones it is made for; unknown, they are counted approximately."""
        if keys is None:
            keys = seen.agg(F.approx_count_distinct(F.xxhash64(*key), 0.02)).first()[0]
        n, each = sizes(math.ceil(keys * 1.05), rate)
        made = cls(seen, n, each, list(key))
        placed = seen.select(made.bucket().alias("bucket"), F.explode(F.array(*made.places())).alias("bit"))
        # Spark's bitmaps hold each bit once, so rows are combined before the shuffle
        made.bits = placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        return made

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(self.n))

    def places(self) -> list[Column]:
        """Bits of a key in its bucket: a start and odd steps."""
        start, step = F.xxhash64(*self.key, F.lit(2)), F.xxhash64(*self.key, F.lit(3)).bitwiseOR(F.lit(1))
        return [F.pmod(F.shiftright(start, 20) + i * F.shiftright(step, 20).bitwiseOR(F.lit(1)), F.lit(BUCKET_BITS)) for i in range(self.each)]

    def merge(self, other: Bloom) -> Bloom:
        """A filter of both's keys; both must be of one size."""
        if (self.n, self.each, self.key) != (other.n, other.each, other.key):
            raise ValueError("filters of different sizes can't be merged")
        return Bloom(self.bits.union(other.bits).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")), self.n, self.each, self.key)

    def probe(self, rows: DataFrame, name: str = "maybe") -> DataFrame:
        """rows with a flag: false for keys that were never added."""
        bits = self.bits.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
        bits = F.broadcast(bits) if self.n <= BROADCAST_BUCKETS else bits
        met = rows.withColumn("_bucket", self.bucket()).join(bits, "_bucket", "left")

        def is_set(place: Column) -> Column:
            byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (place % 8).cast("int")) == 1

        all_set = F.col("_bitmap").isNotNull()
        for place in self.places():
            all_set = all_set & F.coalesce(is_set(place), F.lit(False))
        return met.withColumn(name, all_set).drop("_bucket", "_bitmap")


def unseen(rows: DataFrame, seen: DataFrame, key: list[str], keys: int | None = None, rate: float = 0.001, bloom: Bloom | None = None) -> DataFrame:
    """Rows whose key seen does not have, as an anti-join gives them; null keys have no match.

    Only rows that the filter may hold meet seen, so where most rows are new few are shuffled. bloom: a filter of seen that is there already.
    """
    probed = (bloom or Bloom.of(seen, key, keys, rate)).probe(rows, "_maybe")
    # an anti-join would be moved below the filter by Spark's optimizer, and meet all rows
    checked = probed.filter("_maybe").join(seen.select(*key).distinct().withColumn("_seen", F.lit(True)), key, "left").filter("_seen IS NULL")
    return probed.filter("NOT _maybe").select(*rows.columns).unionByName(checked.select(*rows.columns))
