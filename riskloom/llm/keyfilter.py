"""A broadcast Bloom filter over key hashes, as a table.

Rows (slice, bits): a key's hash names its slice and three bits in it.  The
table has ``BITS_PER_KEY`` bits a key (0.5 % false hits), and at most
``MAX_SLICES`` slices, 32 MB, whatever the number of keys; with more keys than
that has room for, more rows pass that need not.  A row is tested by an
equi-join with its slice, inside the JVM, so rows that can't match are never
shuffled; whoever asks still has to compare the rows that pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BITS = 1 << 16
MAX_SLICES = 1 << 12
BITS_PER_KEY = 16


def _bits(group: pa.Table) -> pa.Table:
    k = group.column("k").combine_chunks().to_numpy().view(np.uint64)
    flags = np.zeros(SLICE_BITS, bool)
    for shift in (16, 32, 48):
        flags[((k >> np.uint64(shift)) & np.uint64(SLICE_BITS - 1)).astype(np.int64)] = True
    words = np.packbits(flags, bitorder="little").view(np.int64)
    return pa.table({"_slice": group.column("_slice")[:1], "_bits": pa.array([words], pa.list_(pa.int64()))})


class KeyFilter:
    """Made from ``keys``, a table of distinct key hashes (column k, long)."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.slices = 1
        while self.slices < MAX_SLICES and self.slices * SLICE_BITS < n * BITS_PER_KEY:
            self.slices *= 2
        rows = keys.select("k", self._slice(F.col("k")).alias("_slice"))
        self.table = rows.groupBy("_slice").applyInArrow(_bits, "_slice int, _bits array<long>")

    def _slice(self, k: Column) -> Column:
        return F.pmod(k, F.lit(self.slices)).cast("int")

    def flagged(self, df: DataFrame, key: Column, flag: str) -> DataFrame:
        """``df`` with ``flag``: false if ``key`` is surely not among the keys."""
        cols = df.columns
        rows = df.withColumn("_fk", key).withColumn("_fs", self._slice(F.col("_fk")))
        rows = rows.join(F.broadcast(self.table), F.col("_fs") == F.col("_slice"), "left")
        hit = F.lit(True)
        for shift in (16, 32, 48):
            place = F.shiftrightunsigned("_fk", shift).bitwiseAND(F.lit(SLICE_BITS - 1)).cast("int")
            hit = hit & (F.getbit(F.get("_bits", F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1)
        return rows.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(hit, F.lit(False)).alias(flag))
