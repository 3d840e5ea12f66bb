"""Pack documents into sequences of fixed length by exact complements, then best fit.

The plan needs only the number of pieces of each length (at most ``capacity``
numbers). From the longest length down, gaps are filled exactly by one, two or
three available lengths, as many times as the counts allow; lengths without a
complement are then packed best fit, longest first. Each plan row takes a run
of ranks of one length, so a piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.llm.common import boxed, saved, table, tidied, unboxed
from timberline.llm.tokens import encoder

TEXTS_AT_ONCE = 256

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


# --- the plan on length counts -------------------------------------------

def _pair(left: np.ndarray, total: int, top: int) -> tuple[int, int] | None:
    """Available lengths a >= b with a + b = total and a <= top; the largest such a."""
    low, high = -(-total // 2), min(top, total - 1)
    if low > high:
        return None
    ok = (left[low:high + 1] > 0) & (left[total - high:total - low + 1][::-1] > 0)
    if 2 * low == total and left[low] < 2:
        ok[0] = False
    hits = np.flatnonzero(ok)
    return (low + int(hits[-1]), total - low - int(hits[-1])) if len(hits) else None


def _pair_sums(left: np.ndarray, capacity: int) -> np.ndarray:
    """Sums of two available lengths; an over-estimate once counts have gone down."""
    have = np.flatnonzero(left > 0)
    bits, sums = 0, 0
    for a in have:
        bits |= 1 << int(a)
    for a in have:
        sums |= bits << int(a)
    sums &= (1 << (capacity + 1)) - 1
    raw = np.frombuffer(sums.to_bytes(capacity // 8 + 1, "little"), np.uint8)
    return np.unpackbits(raw, bitorder="little")[:capacity + 1].astype(bool)


def _complement(left: np.ndarray, gap: int, sums: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill the gap exactly, longest first."""
    if left[gap] > 0:
        return (gap,)
    two = _pair(left, gap, gap)
    if two:
        return two
    at = np.arange(1, gap - 1)
    firsts = at[(left[at] > 0) & sums[gap - at]] if gap > 2 else at[:0]
    for a in firsts[::-1]:
        left[a] -= 1
        two = _pair(left, gap - int(a), int(a))
        left[a] += 1
        if two:
            return (int(a), *two)
    return None


def plan(counts: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``counts[L]`` pieces of each length up to the capacity -> ``[(((length, times), ...), sequences), ...]``."""
    capacity = len(counts) - 1
    left = np.array(counts, np.int64)
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    if left[capacity]:
        out.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    sums, stale = _pair_sums(left, capacity), 0
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            fill = _complement(left, capacity - length, sums)
            left[length] += 1
            if fill is None:
                break
            need: dict[int, int] = {}
            for x in (length, *fill):
                need[x] = need.get(x, 0) + 1
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= k * times
            out.append((tuple(need.items()), times))
        stale += 1
        if stale % 32 == 0:
            sums = _pair_sums(left, capacity)
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, on counts: sequences in the same state are one group."""
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, items: tuple, n: int) -> None:
        if gap not in groups:
            bisect.insort(gaps, gap)
            groups[gap] = []
        groups[gap].append((items, n))

    for length in np.flatnonzero(left > 0)[::-1].tolist():
        c = int(left[length])
        while c > 0:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                gap, items, n = capacity, (), c
            else:
                gap = gaps[at]
                items, n = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            each = gap // length
            full = min(n, c // each)
            if full:
                put(gap - each * length, (*items, (length, each)), full)
                c -= full * each
            rest = n - full
            if rest and 0 < c < each:
                put(gap - c * length, (*items, (length, c)), 1)
                rest, c = rest - 1, 0
            if rest and items:
                put(gap, items, rest)
    return [g for gap in gaps for g in groups[gap]]


@dataclass(frozen=True)
class Places:
    """The plan as runs of ranks; ``find`` is a binary search for a batch of pieces."""

    key: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(groups: list[tuple[tuple[tuple[int, int], ...], int]], capacity: int) -> Places:
        used = np.zeros(capacity + 1, np.int64)
        rows, sequence = [], 0
        for items, n in groups:
            offset = 0
            for length, each in items:
                rows.append((length, used[length], each, sequence, offset))
                used[length] += each * n
                offset += length * each
            sequence += n
        rows.sort()
        length, rank, each, first, offset = np.array(rows, np.int64).reshape(-1, 5).T
        return Places((length << 45) + rank, rank, each, first, offset)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 45) + rank, "right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


# --- the Spark job -------------------------------------------------------

def _cutter(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(i, TEXTS_AT_ONCE).to_pydict()
                docs, piece, start, length, ids = [], [], [], [], []
                for doc, raw in zip(some["doc_id"], enc.encode(some["text"])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        docs.append(doc)
                        piece.append(k)
                        start.append(at // 4)
                        ids.append(raw[at:at + 4 * capacity])
                        length.append(len(ids[-1]) // 4)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                                  pa.array(length, pa.int64()), pa.array(ids, pa.binary())], schema=PIECES)
    return run


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode ``doc_id, text`` (NULL: empty) with the end id and cut longer ones: ``doc_id, piece, start, length, ids``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidied(_cutter(tokenizer, end_id, capacity), words=True), "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every row of ``pieces`` (with ``length`` from 1 to capacity) its ``sequence_id`` and ``offset``.

    Only the number of pieces per length (at most ``capacity`` numbers) reaches the driver. Ranks within a length
    come from salted parts of it, so a frequent length is spread over many tasks. Equal rows share nothing but
    their length; an empty table gives an empty result. Input columns named like a result column are replaced. ``pieces`` is read twice: give a written table.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    hist = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in hist:
        counts[r["length"]] = r["count"]
    places = Places.of(plan(counts), capacity)
    salts = local_table(spark, [{"length": r["length"], "salts": max(256, r["count"] // 65_536)} for r in hist],
                        pa.schema([("length", pa.int64()), ("salts", pa.int64())]))
    key = F.xxhash64(*[F.col(f"`{c}`") for c in names if c != "ids"])
    dealt = boxed(pieces, F.col("length"), key.alias("_key")).join(F.broadcast(salts), "length").withColumn(  # at most ``capacity`` rows
        "_salt", F.pmod("_key", "salts"))
    per = dealt.groupBy("length", "_salt").count()
    base = per.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_key"))
    ranked = dealt.withColumn("_nth", nth).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_nth") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def found(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_p", found("length", "_rank")).select("row", "_p.sequence_id", "_p.offset")
    return unboxed(placed, names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``(pieces with ids, placements)``; join on ``doc_id, piece`` gives the filled sequences."""
    pieces = saved(cut_pieces(docs, tokenizer, end_id, capacity), "pieces")
    small = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces, place(small, capacity)


def packed(docs: DataFrame) -> DataFrame:
    """Placement of every piece of ``docs`` in sequences of 4096 word-BPE ids, end id 1."""
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))[1]


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 ids."""
    return packed(table(spark, sf, "documents"))
