"""Substring dedup by hashing units of text: the earliest occurrence stays, later ones go.

Texts are compared by the digest of their normalised words (ASCII letters
lower-cased, white space as one blank). Occurrences rank by document, then
place; offsets are code points of the original text.

``repeated_units`` tells the single lines of at least ``min_words`` words.
``repeated_runs`` and ``without_repeats`` hash every line and every paragraph
(lines up to a blank one) and hold the floor against runs of repeated lines.

A passage pasted into the middle of a line has no line or paragraph of its
own. ``repeated_passages`` therefore takes every run of ``min_words`` words as
a unit: it finds each passage of that length that an earlier document has.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.bloom import filter_bits, passes
from timberline.llm.common import columns, saved, table, unused

MIN_WORDS = 50

UNITS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary())])


def text_units(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Start, end, words and digest of each unit."""
    at = 0
    for line in text.split("\n"):
        if len(line) >= 2 * min_words - 1:
            words = line.encode().lower().split()
            if len(words) >= min_words:
                yield at, at + len(line), len(words), hashlib.md5(b" ".join(words)).digest()
        at += len(line) + 1


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            rows = [(d, *u) for d, t in zip(docs, batch.column(1).to_pylist()) if t for u in text_units(t, min_words)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, UNITS)], schema=UNITS)
    return run


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, start, end, n_words, kept_doc_id, kept_start``: every unit that is not the first of its digest.

    NULL and empty texts have no units; NULL ids rank last; repeated rows (one id, one text) are one occurrence, so
    neither is removed for the other. Digests are grouped by partial aggregation, a frequent one is not gathered.
    """
    units = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _units(min_words), "doc_id long, start long, end long, n_words long, digest binary"), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("start"))
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = units.join(first, "digest").where(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


LINES = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("line", pa.int64()), ("lines", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                   ("n_words", pa.int64()), ("digest", pa.binary())])
LINES_DDL = "doc_id long, text_id long, line long, lines long, start long, end long, n_words long, digest binary"
HEAVY_SHARE = 1000  # digests with more than this part of all units number fewer, and are broadcast


def text_id(text: str) -> int:
    """Tells texts of one id, or without an id, apart."""
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def line_units(text: str) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Number, count of lines, start, end, words and digest of each line with words and each paragraph of several lines.

    Lines without words end a paragraph and are not numbered.
    """
    at = number = 0
    held: list[tuple[int, int, list[bytes]]] = []
    for line in [*text.split("\n"), ""]:
        words = line.encode().lower().split()
        if words:
            yield number, 1, at, at + len(line), len(words), hashlib.md5(b" ".join(words)).digest()
            held.append((at, at + len(line), words))
            number += 1
        else:
            if len(held) > 1:
                every = [w for _, _, x in held for w in x]
                yield number - len(held), len(held), held[0][0], held[-1][1], len(every), hashlib.md5(b" ".join(every)).digest()
            held = []
        at += len(line) + 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column(0).to_pylist()
        rows = [(d, i, *u) for d, t in zip(docs, batch.column(1).to_pylist()) if t for i in [text_id(t)] for u in line_units(t)]
        cols = list(zip(*rows)) if rows else [[]] * len(LINES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, LINES)], schema=LINES)


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` with a table of distinct keys and ``n``, their numbers of rows; a frequent key is not gathered."""
    heavy = F.col("n") * HEAVY_SHARE > rows.count()
    hot = table.where(heavy).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(~heavy).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def _later(units: DataFrame, place: Column, several: Column) -> DataFrame:
    """The units that are not at the first ``place`` of their digest, with that place as ``first``.

    ``several``, an aggregate, picks the digests worth joining.
    """
    first = saved(units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n"), several.alias("several")).where("several").drop("several"), "firsts")
    return _joined(units, first, "digest").where(~place.eqNullSafe(F.col("first")))


def _again(units: DataFrame) -> DataFrame:
    """The units that are not the first of their digest, with the place ``first``."""
    return _later(units, F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_id"), F.col("start")), F.count("*") > 1)


PART = "start long, end long, n_words long, kept_doc_id long, kept_start long"


def _runs_of(found: list[dict], min_words: int) -> list[dict]:
    """Runs of consecutive repeated lines of ``min_words`` words in all; a line of a repeated paragraph is repeated."""
    runs, last, words = [], -1, 0

    def end() -> None:
        if runs and words < min_words:
            runs.pop()

    for u in sorted(found, key=lambda u: (u["line"], -u["lines"])):
        if u["line"] + u["lines"] - 1 <= last:  # inside a repeated paragraph
            continue
        if not runs or u["line"] > last + 1:
            end()
            runs.append({"start": u["start"], "end": u["end"], "parts": []})
            words = 0
        words += u["n_words"]
        last = u["line"] + u["lines"] - 1
        runs[-1]["end"], runs[-1]["n_words"] = u["end"], words
        runs[-1]["parts"].append({c: u[c] for c in ("start", "end", "n_words", "kept_doc_id", "kept_start")})
    end()
    return runs


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_id, start, end, n_words, parts`` of every run of repeated lines with ``min_words`` words or more.

    A line is repeated if it or its paragraph is not the first of its digest; lines without words do not break a run.
    ``parts`` are the run's lines and paragraphs, each with the occurrence that stays. NULL ids rank last; repeated rows
    (one id, one text) are one occurrence. What is gathered is a document's repeated lines, by id and text.
    """
    units = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_lines, LINES_DDL), "lines")
    found = F.struct("line", "lines", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))
    of_doc = _again(units).groupBy("doc_id", "text_id").agg(F.collect_set(found).alias("found"))

    @F.pandas_udf(f"array<struct<start:long,end:long,n_words:long,parts:array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>>>")
    def runs(found: pd.Series) -> pd.Series:
        return pd.Series([_runs_of(list(x), min_words) for x in found], dtype=object)

    return of_doc.select("doc_id", "text_id", F.explode(runs("found")).alias("run")).select("doc_id", "text_id", "run.start", "run.end", "run.n_words", "run.parts")


# --- passages: every run of words is a unit --------------------------------

PASSAGE_WORDS = 51  # over 50 words
# Two odd factors of the rolling hashes; any would do.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

WINDOWS = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("own", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("start", pa.int64()),
                     ("end", pa.int64()), ("key", pa.int64()), ("digest", pa.binary())])
WINDOWS_DDL = "doc_id long, text_id long, own long, at int, n int, start long, end long, key long, digest binary"
KEPT_POWERS = 1 << 16
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, data.lower().split()), np.uint64)


@functools.lru_cache(maxsize=None)
def _kept_powers(factor: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(KEPT_POWERS, factor, np.uint64)]))


def powers(factor: int, n: int) -> np.ndarray:
    """``factor`` to the powers 0 to ``n``, modulo 2^64; those of texts of usual length are kept."""
    if n <= KEPT_POWERS:
        return _kept_powers(factor)[:n + 1]
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]))


class Rolling:
    """Polynomial hashes modulo 2^64 of any runs ``first`` to ``last`` (exclusive) of ``h``; odd factors have inverses."""

    def __init__(self, h: np.ndarray, factor: int):
        n = len(h)
        self.inverse = powers(pow(factor, -1, 1 << 64), n)
        self.before = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(factor, n)[:n], out=self.before[1:])

    def every(self, width: int) -> np.ndarray:
        """Of all runs of ``width``, in order."""
        n = len(self.before) - width
        return (self.before[width:] - self.before[:n]) * self.inverse[:n]

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.before[last] - self.before[first]) * self.inverse[first]


def lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by runs of one, two, four …"""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:len(h) - (width - step)], h[width - step:]) if width > step else h


def anchors(roll: Rolling, n: int, min_words: int) -> np.ndarray:
    """For each passage of ``min_words`` of ``n`` words, the lowest hash of the half passages in it; equal passages have equal ones."""
    half = (min_words + 1) // 2
    if n < min_words:
        return np.zeros(0, np.uint64)
    return lowest(roll.every(half), min_words - half + 1)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one code point of every word."""
    raw = np.frombuffer(data, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = IS_SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])  # of words, first and last in turn
    if not data.isascii():
        edges = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[edges]  # code points before each byte
    return edges[::2], edges[1::2]


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                h = word_hashes((text or "").encode())
                found.append(np.unique(anchors(Rolling(h, FACTORS[0]), len(h), min_words)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])
    return run


def _spans(min_words: int, bits: np.ndarray, singly: bool):
    """Runs of passages with one anchor whose key is in the filter; ``singly``: the passages of the runs whose ``own`` is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (text or "").encode()
                h = word_hashes(data)
                if len(h) < min_words:
                    continue
                rolls = [Rolling(h, FACTORS[0])]
                key = anchors(rolls[0], len(h), min_words)
                at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])[:len(key)].astype(np.int64)
                last = np.concatenate([at[1:], [len(key)]])[:len(at)]  # exclusive
                if not singly:
                    some = passes(key[at], bits)
                    at, last = at[some], last[some]
                if not len(at):
                    continue
                rolls.append(Rolling(h, FACTORS[1]))
                name = text_id(text)
                place = ((doc or 0) * FACTORS[1] + name) % (1 << 64)
                own = (rolls[1].of(at, last + min_words - 1) ^ np.uint64(place)) * np.uint64(FACTORS[0])
                if singly:
                    some = passes(own, bits)
                    n = (last - at)[some]
                    own = np.repeat(own[some], n)
                    at = np.repeat(at[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    last = at + 1
                    if not len(at):
                        continue
                start, end = word_spans(data)
                stop = last + min_words - 1
                digest = np.stack([r.of(at, stop) for r in rolls], 1).astype("<u8").tobytes()
                ends = np.arange(len(at) + 1, dtype=np.int32) * 16
                n = len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * n, pa.int64()), pa.array(np.full(n, name, np.int64)), pa.array(own.view(np.int64)), pa.array(at.astype(np.int32)),
                    pa.array((last - at).astype(np.int32)), pa.array(start[at]), pa.array(end[stop - 1]), pa.array(key[at].view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(digest)])], schema=WINDOWS)
    return run


def repeated_passages(docs: DataFrame, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, text_id, start, end, n_words, kept_doc_id``: longest stretches of ``docs`` in which every word lies in a
    passage of ``min_words`` words that an earlier document has, too; ``kept_doc_id`` is the earliest such document.

    Two passages are equal if their words are. Each passage has an anchor, the lowest of the hashes of its half passages,
    so that equal passages have equal anchors; neighbouring passages with one anchor are a run, about four in the length
    of a passage. Anchors are counted over all texts. Runs of anchors found twice are digested whole (128 bits): later
    occurrences of a run are repeated whole. Only where an anchor has different runs, their first occurrences are taken
    apart into passages, which are digested and grouped. Anchors and runs are picked in the scan by filters of bounded
    size: a full filter costs rows, never a passage.

    Rank: NULL ids last, then ``doc_id``, then the text's hash. NULL and empty texts have no passages; repeated rows (one
    id, one text) are one document, and what a document repeats within itself stays.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = saved(texts.select("text").mapInArrow(_anchors(min_words), "key long").groupBy("key").count().where("count > 1").select("key"), "anchors")
    runs = saved(texts.mapInArrow(_spans(min_words, filter_bits(keys), False), WINDOWS_DDL), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_id"))
    rep = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_id"), F.col("own"))
    kinds = saved(runs.groupBy("digest").agg(F.min(rep).alias("rep"), F.first("key").alias("key"), F.count("*").alias("n"),
                                             (F.min(place) != F.max(place)).alias("several")), "kinds")
    mixed = saved(kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    apart = saved(_joined(kinds.select("key", F.col("rep.own").alias("own")), mixed, "key").select(F.col("own").alias("key")), "apart")
    single = saved(texts.mapInArrow(_spans(min_words, filter_bits(apart), True), WINDOWS_DDL), "windows")

    columns_ = ["doc_id", "text_id", "at", "n", "start", "end", F.struct("first.last", "first.doc_id").alias("first")]
    windows = saved(_later(single, place, F.min(place) != F.max(place)).select("own", *columns_), "later")
    earlier = windows.groupBy(rep.alias("rep")).agg(F.min("first").alias("earlier"))
    several = kinds.where("several").select("digest", "rep", "n").join(earlier, "rep", "left").select(
        "digest", "n", F.struct("rep.last", "rep.doc_id", "rep.text_id").alias("holder"), F.coalesce("earlier", F.struct("rep.last", "rep.doc_id")).alias("first"))
    whole = _joined(runs.withColumnRenamed("n", "size"), saved(several, "several"), "digest").where(~place.eqNullSafe(F.col("holder"))).withColumnRenamed("size", "n")
    later = whole.select(*columns_).unionByName(windows.drop("own")).groupBy("doc_id", "text_id", "at", "n").agg(
        F.first("start").alias("start"), F.first("end").alias("end"), F.min("first").alias("first")).withColumn("to", F.col("at") + F.col("n"))

    of_doc = Window.partitionBy("doc_id", "text_id").orderBy("at", "n")
    opens = F.coalesce(F.col("at") - F.max("to").over(of_doc.rowsBetween(Window.unboundedPreceding, -1)) >= min_words, F.lit(True))
    found = later.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(of_doc))
    return found.groupBy("doc_id", "text_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("to") - F.min("at") + (min_words - 1)).cast("long").alias("n_words"),
        F.min("first").alias("first")).select("doc_id", "text_id", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, find: Callable[[DataFrame, int], DataFrame] = repeated_runs) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text`` (with their line break) and ``removed``, their original spans.

    ``find`` tells the spans: ``repeated_runs`` those of lines and paragraphs, ``repeated_passages`` those of passages.

    Spans of a document are gathered by its id and text; documents without repeats keep their text as it is.
    An input column ``removed`` is replaced.
    """
    cuts, key, of = unused(docs, "_cut"), unused(docs, "_id"), unused(docs, "_text")
    cut = find(docs, min_words).groupBy(F.col("doc_id").alias(key), F.col("text_id").alias(of)).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias(cuts))
    none = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")

    @F.pandas_udf("long")
    def name(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else text_id(t) for t in text], dtype="Int64")

    mine = unused(docs, "_mine")
    joined = docs.withColumn(mine, name("text")).join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(of)), "left")

    @F.pandas_udf("string")
    def rest(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, spans):
            if t is None or spans is None or not len(spans):
                return t
            out, at = [], 0
            for s in spans:
                out.append(t[at:s["start"]])
                at = min(len(t), s["end"] + 1)
            return "".join(out) + t[at:]
        return pd.Series([one(t, c) for t, c in zip(text, cuts)], dtype=object)

    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(rest("text", cuts))
    kept = [text.alias("text") if c == "text" else col for c, col in zip(docs.columns, columns(docs)) if c != "removed"]
    return joined.select(*kept, F.coalesce(cuts, none).alias("removed"))


def op6_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage of over 50 words in ``documents`` that an earlier document has, within lines or across them."""
    return repeated_passages(table(spark, sf, "documents")).drop("text_id")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS spaced,
           regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(spaced) AS spaced, unnest(words) AS word FROM d),
o AS (SELECT doc_id, i, (sum(length(spaced)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS "end", length(word) AS size FROM u),
p AS (SELECT doc_id, unnest(range(1, len(words) - {PASSAGE_WORDS} + 2)) AS i, words FROM d),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {PASSAGE_WORDS} - 1], ' ')) AS digest FROM p),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY digest) AS kept FROM w),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {PASSAGE_WORDS} THEN 0 ELSE 1 END AS opens FROM r WHERE kept < doc_id),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
e AS (SELECT doc_id, run, min(i) AS a, max(i) + {PASSAGE_WORDS} - 1 AS z, min(kept) AS kept_doc_id FROM g GROUP BY doc_id, run)
SELECT e.doc_id, x."end" - x.size AS "start", y."end" AS "end", z - a + 1 AS n_words, kept_doc_id
FROM e JOIN o x ON x.doc_id = e.doc_id AND x.i = a JOIN o y ON y.doc_id = e.doc_id AND y.i = z
"""
