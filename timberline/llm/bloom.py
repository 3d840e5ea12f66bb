"""A Bloom filter of bounded size over a column of 64-bit keys; four bits in one word per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.core import BROADCAST_ROWS

FILTER_WORDS = 1 << 21  # 16 MB
KEYS_PER_WORD = 4


def filter_bits(keys: DataFrame, most: int = FILTER_WORDS) -> np.ndarray:
    """The filter of the column ``key``: a power of two of words, at most ``most``."""
    words = 1 << max(10, min(most.bit_length() - 1, (keys.count() // KEYS_PER_WORD).bit_length()))
    mask = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(key, {6 * j}) & 63 AS INT))" for j in range(4))
    found = keys.select(F.expr(f"shiftrightunsigned(key, {65 - words.bit_length()})").alias("at"), F.expr(mask).alias("mask")).groupBy("at").agg(
        F.bit_or("mask").alias("mask")).toArrow()  # at most ``words`` rows
    bits = np.zeros(words, np.uint64)
    bits[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return bits


def passes(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys (unsigned) may be in the filter; all that are in it are."""
    mask = np.zeros(len(key), np.uint64)
    for j in range(4):
        mask |= np.uint64(1) << ((key >> np.uint64(6 * j)) & np.uint64(63))
    return bits[(key >> np.uint64(65 - len(bits).bit_length())).astype(np.int64)] & mask == mask


def rows_of(docs: DataFrame, ids: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """At least the rows of ``docs`` whose ``doc_id`` is in ``ids`` (distinct), picked in the scan, without an exchange.

    Up to ``few`` ids are broadcast and the rows are exact; beyond, a filter of bounded size lets some others pass.
    """
    if ids.count() <= few:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    bits = filter_bits(ids.select(F.xxhash64("doc_id").alias("key")))

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(passes(key.to_numpy().view(np.uint64), bits))
    return docs.where(may(F.xxhash64("doc_id")))
