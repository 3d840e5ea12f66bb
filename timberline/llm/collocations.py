"""Phrase collocations by SON partitioning.

Rows are dealt by the hash of their id to a few shards. A shard is mined
completely: all its phrases are counted under hashed keys, and those that reach
the support lowered by the shard's share of the language's words stay. A phrase
that is frequent in all reaches that support in at least one shard, whatever
the shares are, so the union of the shards' keys holds every frequent phrase. A
second pass counts the phrases behind these keys exactly, as text; two phrases
with one key cost a count, not the result.

Keys travel by range: a chunk of texts sorts its keys and sends each range's
part as four bytes a key, where a key comes as often as it was found, but not
more often than the lowered support asks for. Ranges are so many that a range's
keys are few, so each is counted by sorting.

The support is a number of occurrences, so a shard with less than that part of
the words would prune nothing: there are few shards, and each is counted by all
tasks. The union is told to the second pass as a Bloom filter of at most
``bloom.FILTER_WORDS`` words; beyond what it can tell apart, more phrases are counted
that fall short in the end.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.core import BROADCAST_ROWS
from timberline.llm.bloom import filter_bits, passes
from timberline.llm.common import empty_if_null, saved, table
from timberline.operators.ordering import lookup, small

# Characters that end a piece, characters between words.
ENDS = ".,;:!?\n\x0b\x0c\r"
JAVA_WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]")

SHARDS = 4
CHUNK_TOKENS = 1 << 20
SALTS = 64
RANGE_KEYS = 1 << 22  # keys of a range, about


# --- one chunk of texts ---------------------------------------------------

class _Numbers(dict):
    """Numbers words as they come; the piece ends are the first."""

    def __init__(self) -> None:
        super().__init__((e.encode(), i) for i, e in enumerate(ENDS))

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Chunk:
    """Word numbers of texts, one piece end between them; ``group`` gives the place of a word's text in ``groups``."""

    ids: np.ndarray
    group: np.ndarray
    words: list[bytes]
    groups: list[tuple[str, int]]

    def starts(self, k: int) -> np.ndarray:
        """Where phrases of ``k`` words begin."""
        n = len(self.ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        word = self.ids >= len(ENDS)
        whole = word[:n].copy()
        for j in range(1, k):
            whole &= word[j:n + j]
        return np.flatnonzero(whole)

    @functools.cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64),
                np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang, _ in self.groups], np.uint64))

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """A key of language and phrase for each place."""
        word, lang = self.hashes
        out = lang[self.group[at]] + np.uint64(k)
        for j in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word[self.ids[at + j]])
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(33))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows ``lang, slot, text`` as chunks of whole texts with some ``CHUNK_TOKENS`` tokens."""
    numbers, ids, lengths, place, groups, held = _Numbers(), [], [], [], {}, 0

    def flush() -> Chunk:
        return Chunk(np.concatenate(ids), np.repeat(np.array(place, np.int32), lengths), list(numbers), list(groups))

    for batch in batches:
        for lang, slot, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2).cast(pa.binary())):
            tokens = TOKEN.findall(text.as_py().lower())  # bytes: ASCII letters only
            tokens.append(b"\n")
            ids.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
            lengths.append(len(tokens))
            place.append(groups.setdefault((lang, slot), len(groups)))
            held += len(tokens)
            if held >= CHUNK_TOKENS:
                yield flush()
                numbers, ids, lengths, place, groups, held = _Numbers(), [], [], [], {}, 0
    if held:
        yield flush()


def counts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and how often each comes."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_)), bool), sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.diff(np.append(first, len(sorted_)))


def short(key: np.ndarray, range_bits: int) -> np.ndarray:
    """The bits of a key that travel: its range, then 32 more."""
    return key >> np.uint64(32 - range_bits)


def _mined(longest: int, range_bits: int):
    """``part, slot, keys``: the phrases of a chunk by key range and shard; a key is repeated up to the support asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(32)
        for c in chunks(batches):
            slots, slot_of = np.unique([s for _, s in c.groups], return_inverse=True)
            found = []
            for k in range(1, longest + 1):
                at = c.starts(k)
                found.append((short(c.keys(at, k), range_bits), slot_of[c.group[at]]))
            key, of = (np.concatenate(x) for x in zip(*found))
            del found
            for i, slot in enumerate(slots.tolist()):
                some, n = counts(np.sort(key[of == i]))
                some = np.repeat(some, np.minimum(n, slot % (1 << 32)))
                ends = np.concatenate([[0], np.searchsorted(some, borders), [len(some)]]).astype(np.int32)
                parts = np.flatnonzero(np.diff(ends))
                keys = pa.Array.from_buffers(pa.binary(), 1 << range_bits, [None, pa.py_buffer(ends * 4), pa.py_buffer(some.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), slot)), keys.take(pa.array(parts))], ["part", "slot", "keys"])
    return run


def _frequent(range_bits: int):
    def run(group: pa.Table) -> pa.Table:
        """``key`` of every phrase of a key range that reaches a shard's lowered support."""
        part, slots = group.column("part")[0].as_py(), group.column("slot").to_numpy()
        blocks = [np.frombuffer(b.as_buffer(), "<u4") for chunk in group.column("keys").chunks for b in chunk]
        found = [np.zeros(0, np.uint32)]
        for slot in np.unique(slots).tolist():
            some, n = counts(np.sort(np.concatenate([blocks[i] for i in np.flatnonzero(slots == slot)])))
            found.append(some[n >= slot % (1 << 32)])
        keys = np.unique(np.concatenate(found)).astype(np.uint64) | np.uint64(part) << np.uint64(32)
        return pa.table({"key": mixed(keys).view(np.int64)})
    return run


def _counted(longest: int, bits: np.ndarray, range_bits: int):
    """``lang, k, phrase, n``: the phrases of a chunk that the filter lets pass, told apart by their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            langs = sorted({lang for lang, _ in c.groups})
            lang_of = np.array([langs.index(lang) for lang, _ in c.groups], np.int64)
            wide = max(1, (len(c.words) - 1).bit_length())
            for k in range(1, longest + 1):
                at = c.starts(k)
                at = at[passes(mixed(short(c.keys(at, k), range_bits)), bits)]
                code, ids = lang_of[c.group[at]], [c.ids[at + j] for j in range(k)]
                if len(langs).bit_length() + k * wide < 64:  # language and words in one number
                    for x in ids:
                        code = code << wide | x
                    code, n = counts(np.sort(code))
                    ids = [code >> wide * (k - 1 - j) & ((1 << wide) - 1) for j in range(k)]
                    lang = code >> wide * k
                else:
                    lang = code
                    for x in ids:
                        _, code = np.unique(code << 32 | x, return_inverse=True)
                    _, first, n = np.unique(code, return_index=True, return_counts=True)
                    ids, lang = [x[first] for x in ids], lang[first]
                lists = [[c.words[i] for i in x] for x in ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array([langs[i] for i in lang], pa.string()), pa.array(np.full(len(n), k, np.int32)),
                    pa.array(list(map(b" ".join, zip(*lists))), pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "k", "phrase", "n"])
    return run


# --- the Spark job -------------------------------------------------------

def with_language(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), empty_if_null(F.col(f"`{text}`")).alias("text"))


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, k, phrase, f)`` of every phrase of 1 to ``longest`` words with ``f >= support``, and ``(lang, n)`` words.

    ``docs`` has ``doc_id, lang, text``; NULL languages are ``und``, NULL and empty texts have no words. Repeated rows
    and rows without an id count each. Texts are read three times and never shuffled. Exact for every ``shards``.
    """
    docs = with_language(docs).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    sizes = saved(docs.select("lang", "shard", F.regexp_count("text", F.lit(JAVA_WORD)).cast("long").alias("w")).groupBy("lang", "shard").agg(
        F.sum("w").alias("w")), "shard-words")
    words = sizes.groupBy("lang").agg(F.sum("w").alias("n"))
    least = sizes.join(words, "lang").where("w > 0").select(
        "lang", "shard", F.expr(f"shard * 4294967296 + ({support}L * w + n - 1) div n").alias("slot"))
    least = F.broadcast(least) if small(least, BROADCAST_ROWS // 10) else least
    rows = docs.join(least, ["lang", "shard"]).select("lang", "slot", "text")
    total = sizes.agg(F.sum("w")).first()[0] or 0
    range_bits = min(16, max(4, (longest * total // RANGE_KEYS).bit_length()))
    mined = rows.mapInArrow(_mined(longest, range_bits), "part int, slot long, keys binary")
    keys = saved(mined.groupBy("part").applyInArrow(_frequent(range_bits), "key long"), "phrase-keys")
    counted = rows.mapInArrow(_counted(longest, filter_bits(keys), range_bits), "lang string, k int, phrase string, n long")
    found = saved(counted.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= support), "phrases")
    return found, words


def _part(start: int | Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice("w", start, length))


def scored_phrases(found: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of phrases of two and more words, by the lowest-scoring cut.

    ``found`` holds every part of its phrases, as ``frequent_phrases`` does. Scores are exact: decimals of 38 digits.
    """
    whole = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    key = lambda part: F.struct(F.col("lang").alias("lang"), part.alias("phrase"))
    cuts = saved(whole.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "k", "a", "cut", key(_part(1, F.col("cut"))).alias("left"),
        key(_part(F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("right")), "cuts")
    parts, total = found.select(key(F.col("phrase")).alias("key"), "f"), cuts.count()
    for side, name in (("left", "l"), ("right", "r")):
        weight = cuts.groupBy(F.col(side).alias("key")).count()
        known = parts.join(weight, "key").select(F.col("key").alias(side), F.col("f").alias(name), "count")
        cuts = lookup(cuts, known, side, "count", total)
    exact = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", F.col("b.score").cast("long").alias("score"))


def maximal_phrases(scored: DataFrame, share: int = 50) -> DataFrame:
    """Without the phrases inside a longer one of the table that has at least ``share`` percent of their occurrences."""
    w, k = F.split("phrase", " "), F.col("k")
    inner = F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.concat_ws(" ", F.slice("w", i, n))))
    longer = (scored.where("k > 2").withColumn("w", w).select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    return scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("f") < share * F.col("a"), F.lit(True))).drop("f")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, top: int = 2000, share: int = 50, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each language.

    Words are what stands between blanks, tabs and piece ends, with A-Z lower-cased. Equal scores rank by occurrences,
    then by the phrase's bytes. An empty table gives an empty result; other input columns are ignored. A language's
    phrases are cut to ``top`` in ``SALTS`` parts first, so no task ranks them all.
    """
    found, words = frequent_phrases(docs, support, longest, shards)
    kept = saved(maximal_phrases(saved(scored_phrases(found), "scored")), "collocations")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2000 phrases of two and three words of each language of ``documents``."""
    return collocations(table(spark, sf, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, 1 AS k, unnest(w) AS p FROM s
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM s
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM s),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT lang, k, p, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, k, p, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
v AS (SELECT u.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.p = u.x JOIN f r ON r.lang = u.lang AND r.p = u.y),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
i AS (SELECT lang, q, max(a) AS f FROM (SELECT lang, w[1] || ' ' || w[2] AS q, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY 1, 2),
m AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.q = b.p WHERE i.f IS NULL OR 100 * i.f < 50 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p ASC) AS rank FROM m)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
