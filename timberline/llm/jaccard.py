"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Two sets with Jaccard similarity
of p percent or more differ in at most (100 - p) / p of the smaller one's size,
so the sizes are cut into bands and each band has a bound D on the symmetric
difference. The shingles of a document are dealt by hash to G = D + m segments;
a segment keeps 64 parity bits, the XOR of its shingles' hash bits. A shingle
changes bits of one segment only, so the number of segments in which two
sketches differ is at most the symmetric difference, and two linked documents
agree in at least m whole segments: such a segment is the join key.

Segments of parity 0 (mostly empty ones) say nothing and are no keys. If one of
two linked documents has fewer than m of them, one of the m agreeing segments
is another one and a common key. Documents with m or more also emit their first
D + 1 shingles by hash: the first common shingle has at most D before it in
either set, so two such documents share that key. m follows from the band so that this
is rare. A second, smaller
sketch turns one parity bit per shingle and has a few times as many bits as the
set has shingles; its Hamming distance is at most the symmetric difference, too,
and close to it, which drops most candidates. The rest is verified on the sets of the texts.

Equal sets are one class from the start. In a bucket (documents with one key)
all members are first compared with one leader. That settles the bucket unless
a comparison fails. The members of such buckets are then compared across the
components found so far, on their bit sketches inside the task. Of the pairs that
pass a bucket writes a forest over the components, so no more pairs than it has
members: if these are links, the pairs left out join nothing new. Buckets that
left pairs out are looked at again with the components that were found, with
eight times the forests each time, until none is left out. Near copies meet in
many buckets; a member carries its lowest keys, and a pair that shares a lower one
is left to that bucket. No link between components is missed.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.bloom import rows_of
from timberline.llm.common import columns, in_files, saved, table, tidied
from timberline.llm.components import components

GROWTH = 1.5
LEAST_PERCENT = 67  # a linked smaller set is in the same band or the next lower one
BITS_PER_SHINGLE = 4
KEPT_SETS = 64
TOLD_PAIRS = 500_000
WORDS_AT_ONCE = 1 << 21  # sketch words compared at once in a bucket
LEAST_KEYS = 8
MORE_FORESTS = 8
TEXTS_AT_ONCE = 256
SKETCHES_IN_FILE = 4096

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = [np.uint64(x) for x in (29, 32, 33)]


def _edges() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


EDGES = _edges()


def band_of(size: int) -> int:
    return bisect.bisect_right(EDGES, size) - 1


def agreeing(band: int, percent: int) -> tuple[int, int]:
    """``(D, m)`` for pairs whose smaller set is in the band; its sets seldom leave m of the D + m segments empty."""
    difference = (EDGES[band + 1] - 1) * (100 - percent) // percent
    empty = (difference + 1) * math.exp(-EDGES[band] / (difference + 1))
    return difference, 1 + min(math.ceil(2.5 * empty), -(-difference // 4))


@functools.lru_cache(maxsize=None)
def segments_of(band: int, percent: int) -> int:
    return sum(agreeing(band, percent))


def bands_of(size: int, percent: int) -> list[int]:
    """Bands under which a set is sketched: its own, and lower ones that may hold a linked smaller set."""
    return list(range(band_of(-(-percent * size // 100)), band_of(size) + 1))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S[2])) * _M2
    h = (h ^ (h >> _S[0])) * _M3
    return h ^ (h >> _S[1])


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, no words are none."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(words)
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _M1 + h[i:n - k + 1 + i])
    return np.unique(out)


def sketch(hashes: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Parity words of the band's segments."""
    g = np.uint64(segments_of(band, percent))
    words = np.zeros(int(g), np.uint64)
    np.bitwise_xor.at(words, ((hashes >> _S[1]) * g >> _S[1]).astype(np.int64), _mixed(hashes))
    return words


def parity_bits(hashes: np.ndarray, band: int) -> np.ndarray:
    """``BITS_PER_SHINGLE`` parity bits per shingle of the band's largest sets."""
    n = np.uint64((BITS_PER_SHINGLE * EDGES[band + 1] + 62) // 64 * 64)
    at = ((_mixed(hashes) >> _S[1]) * n >> _S[1]).astype(np.int64)
    odd = np.bincount(at, minlength=int(n)).astype(np.uint8) & 1
    return np.packbits(odd)


def keys_of(hashes: np.ndarray, percent: int) -> np.ndarray:
    """One key per band and segment that is not 0, a hash of the parity word and its place; keys of shingles if needed."""
    out = []
    for band in bands_of(len(hashes), percent):
        words = sketch(hashes, band, percent)
        at, place = np.flatnonzero(words), np.uint64(band << 40)
        out.append(_mixed(words[at] * _M1 + place + at.astype(np.uint64)))
        difference, m = agreeing(band, percent)
        if len(words) - len(at) >= m:
            out.append(_mixed(hashes[:difference + 1] * _M3 + place))
    return np.concatenate(out).view(np.int64)


SKETCHES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c", pa.int64()), ("alt", pa.int64()), ("keys", pa.list_(pa.int64())),
                      ("band", pa.int32()), ("own", pa.binary()), ("below", pa.binary())])
SKETCHES_DDL = "doc_id long, n_shingles long, c long, alt long, keys array<long>, band int, own binary, below binary"


def set_digest(h: np.ndarray) -> tuple[int, int]:
    raw = h.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw, seed=len(h)) - (1 << 63)


def _sketcher(width: int, percent: int):
    """Sizes, digests and sketches; only rows with an id are sketched, as the others link with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # classes that this task has sketched already
        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
            n, c, alt, keys, band, own, below = [], [], [], [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                h = shingles(text.as_py(), width)
                digest = set_digest(h) if len(h) else (None, None)
                n.append(len(h))
                c.append(digest[0])
                alt.append(digest[1])
                new = doc.is_valid and len(h) and digest not in seen
                keys.append(keys_of(h, percent) if new else None)
                bands = bands_of(len(h), percent) if new else []
                band.append(bands[-1] if new else None)
                own.append(parity_bits(h, bands[-1]).tobytes() if new else None)
                below.append(parity_bits(h, bands[0]).tobytes() if len(bands) > 1 else None)
                if new:
                    seen.add(digest)
            cols = [batch.column(0).cast(pa.int64()), *(pa.array(x, f.type) for x, f in zip((n, c, alt, keys, band, own, below), list(SKETCHES)[1:]))]
            yield pa.RecordBatch.from_arrays(cols, schema=SKETCHES)
    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, c`` in order -> ``key, lead, c`` for every further class of a key; holds one row between batches."""
    last_key = last_c = lead = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        changed = np.ones(len(key), bool)
        changed[1:] = new[1:] | (c[1:] != c[:-1])
        leads = c[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if last_key is not None and key[0] == last_key:
            first = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(key)
            leads[:first] = lead
            changed[0] = c[0] != last_c
        keep = changed & (c != leads)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(leads[keep]), pa.array(c[keep])], ["key", "lead", "c"])
        last_key, last_c, lead = key[-1], c[-1], leads[-1]


def _near(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs whose Hamming distance does not exceed the symmetric difference that a link allows."""
    side = lambda n: bits.select(*[F.col(c).alias(f"{n}_{c}" if c != "rep" else n) for c in bits.columns])

    @F.pandas_udf("boolean")
    def close(xn: pd.Series, xb: pd.Series, xo: pd.Series, xl: pd.Series, yn: pd.Series, yb: pd.Series, yo: pd.Series, yl: pd.Series) -> pd.Series:
        out = []
        for n, b, own, low, m, c, other, lower in zip(xn, xb, xo, xl, yn, yb, yo, yl):
            p, q = (own, other) if b == c else (own, lower) if b == c - 1 else (low, other) if c == b - 1 else (None, None)
            if p is None or q is None:  # no band in common: the sizes are too far apart
                out.append(False)
                continue
            apart = int(np.bitwise_count(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64)).sum())
            out.append((100 + percent) * apart <= (100 - percent) * (n + m))
        return pd.Series(out, dtype=bool)

    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")
    args = [f"{n}_{c}" for n in "xy" for c in ("n_shingles", "band", "own", "below")]
    return both.where(close(*args)).select("x", "y").distinct()


class Forests:
    """Edge-disjoint forests over ``n`` nodes; an edge goes to the first of them that does not connect its ends."""

    def __init__(self, n: int, most: int):
        self.n, self.most, self.parents = n, most, []

    def root(self, j: int, a: int) -> int:
        up = self.parents[j]
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def add(self, a: int, b: int) -> bool:
        """Whether there was room; ends connected in one forest are connected in all before it."""
        low, high = 0, len(self.parents)
        while low < high:
            mid = (low + high) // 2
            if self.root(mid, a) == self.root(mid, b):
                low = mid + 1
            else:
                high = mid
        if low == self.most:
            return False
        if low == len(self.parents):
            self.parents.append(list(range(self.n)))
        self.parents[low][self.root(low, a)] = self.root(low, b)
        return True

    def full(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The edges that have no room."""
        if len(self.parents) < self.most:
            return np.zeros(len(a), bool)
        root = np.array([self.root(self.most - 1, i) for i in range(self.n)])
        return root[a] == root[b]


def _across(percent: int, forests: int):
    """Rows of buckets in order -> ``x, y`` of near pairs of members in different components, in up to ``forests``
    forests over the components of a bucket; ``cut`` is the key of a bucket that left pairs out."""
    def pairs(g: list[dict]) -> Iterator[tuple[int | None, int | None, int | None]]:
        x = np.stack([np.frombuffer(r["words"], np.uint64) for r in g])
        n, name, key = np.array([r["n_shingles"] for r in g]), [r["m"] for r in g], g[0]["key"]
        values, comp, count = np.unique([r["component"] for r in g], return_inverse=True, return_counts=True)
        least = np.array([r["least"] + [key] * (LEAST_KEYS - len(r["least"])) for r in g], np.int64)
        # the members of the largest component need not be compared with each other
        inside = comp == count.argmax()
        rest = np.flatnonzero(~inside)
        kept, cut = Forests(len(values), forests), False
        step = max(1, WORDS_AT_ONCE // x.size)
        for at in range(0, len(rest), step):
            i = rest[at:at + step]
            apart = np.bitwise_count(x[i][:, None, :] ^ x[None, :, :]).sum(axis=2, dtype=np.int64)
            both = n[i][:, None] + n[None, :]
            near = ((100 + percent) * apart <= (100 - percent) * both) & (comp[i][:, None] != comp[None, :])
            near &= inside[None, :] | (i[:, None] < np.arange(len(g))[None, :])
            row, b = np.nonzero(near)
            order = np.argsort(apart[row, b] / both[row, b], kind="stable")  # the nearest first
            a, b = i[row][order], b[order]
            lower = ((least[a][:, :, None] == least[b][:, None, :]) & (least[a] < key)[:, :, None]).any(axis=(1, 2))
            a, b = a[~lower], b[~lower]
            full = kept.full(comp[a], comp[b])
            cut |= bool(full.any())
            for p, q in zip(a[~full].tolist(), b[~full].tolist()):
                if kept.add(int(comp[p]), int(comp[q])):
                    yield min(name[p], name[q]), max(name[p], name[q]), None
                else:
                    cut = True
        if cut:
            yield None, None, key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        told: set[tuple] = set()  # pairs meet in several buckets; a task writes each once while there is room
        for batch in batches:
            found: set[tuple] = set()
            for r in batch.to_pylist():
                if held and held[0]["key"] != r["key"]:
                    found.update(pairs(held))
                    held = []
                held.append(r)
            yield _pair_batch(found - told)
            if len(told) < TOLD_PAIRS:
                told |= found
        if held:
            yield _pair_batch(set(pairs(held)) - told)
    return run


def _pair_batch(found: set[tuple]) -> pa.RecordBatch:
    cols = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["x", "y", "cut"])


def _crossing(placed: DataFrame, bits: DataFrame, found: DataFrame, percent: int, forests: int) -> DataFrame:
    """``x, y, cut`` of the buckets ``placed``, rows ``key, m, n_shingles, band, lower``, that hold several components."""
    now = placed.join(found.withColumnRenamed("node", "m"), "m", "left").withColumn("component", F.coalesce("component", "m"))
    # all members of a bucket have a sketch of its band; the lowest own band is one that all have
    open_ = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("band").alias("low")).where("a <> b")
    some = now.join(open_.select("key", "low"), "key").where("band = low OR band = low + 1 AND lower")
    least = some.groupBy("m").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("least"))
    words = F.when(F.col("band") == F.col("low"), F.col("own")).otherwise(F.col("below"))
    return (some.join(bits.select(F.col("rep").alias("m"), "own", "below").join(least, "m"), "m")
            .select("key", "m", "component", "n_shingles", words.alias("words"), "least")
            .repartition("key").sortWithinPartitions("key", "m").mapInArrow(tidied(_across(percent, forests)), "x long, y long, cut long"))


def _linked(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """``x, y, linked`` for every pair of representatives, from the sets of their texts.

    Texts, not sets, are shuffled, as they are shorter once compressed; only those of the pairs leave the scan.
    """
    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {}
        for batch in batches:
            out = []
            for name, p, q in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                p, q = p.as_py(), q.as_py()  # one pair of texts at a time
                if name not in sets:  # leaders come again and again
                    if len(sets) >= KEPT_SETS:
                        sets.clear()
                    sets[name] = (p, shingles(p, width))
                s = sets[name][1] if sets[name][0] == p else shingles(p, width)
                t = shingles(q, width)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(len(s) > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["x", "y", "linked"])

    def side(n: str) -> DataFrame:
        texts = rows_of(docs, pairs.select(F.col(n).alias("doc_id")).distinct())
        return texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}_text"))

    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")
    return both.select("x", "y", "x_text", "y_text").mapInArrow(tidied(enough), "x long, y long, linked boolean")


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    Documents are linked when the Jaccard similarity of their shingle sets is at least ``percent`` / 100; the
    component is the smallest id reachable by links. NULL or wordless texts have no shingles and link with nothing.
    Ids name documents: rows with one id are one node. Rows with a NULL id get their size and no component.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = saved(docs.mapInArrow(tidied(_sketcher(width, percent)), SKETCHES_DDL), "sketches")
    size = base.count()
    classes = saved(in_files(base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "c", "alt").agg(
        F.min("doc_id").alias("rep")), size), "jaccard-classes")
    keys = base.where("doc_id IS NOT NULL").select(F.explode("keys").alias("key"), "c")
    stars = saved(keys.repartition("key").sortWithinPartitions("key", "c").mapInArrow(tidied(_leaders), "key long, lead long, c long"), "jaccard-stars")
    name = lambda n: classes.select(F.col("c").alias(f"{n}_c"), F.col("rep").alias(n))

    bits = saved(in_files(base.where("band IS NOT NULL").join(classes, ["n_shingles", "c", "alt"]).groupBy("rep", "n_shingles", "band").agg(
        F.min("own").alias("own"), F.min("below").alias("below")), size, SKETCHES_IN_FILE), "jaccard-bits")

    # every bucket's members against its leader
    n_stars = stars.count()
    asked = saved(in_files(stars.select(F.col("lead").alias("x_c"), F.col("c").alias("y_c")).distinct()
                           .join(name("x"), "x_c").join(name("y"), "y_c").where("x <> y"), n_stars), "jaccard-pairs")
    near = saved(in_files(_near(asked, bits, percent), asked.count()), "jaccard-near")
    n_told = near.count()
    told = saved(in_files(_linked(docs, near, width, percent), n_told, dealt=True), "jaccard-links")
    links = _edges_of(told)
    found = components(links, n_told)

    # buckets of three and more with a failed comparison: members against members of other components
    good = asked.join(links.select(F.col("u").alias("x"), F.col("v").alias("y")).distinct(), ["x", "y"], "left_semi").select(
        F.col("x_c").alias("lead"), F.col("y_c").alias("c")).distinct().withColumn("linked", F.lit(1))
    failed = stars.join(good, ["lead", "c"], "left").groupBy("key").agg(F.count("*").alias("n"), F.count("linked").alias("good"))
    rows = stars.join(failed.where("n > 1 AND good < n").select("key"), "key", "left_semi")
    members = (rows.select("key", F.col("c").alias("m_c")).unionByName(rows.select("key", F.col("lead").alias("m_c"))).distinct()
               .join(name("m"), "m_c").select("key", "m").distinct())
    placed = saved(in_files(members.join(bits.select(F.col("rep").alias("m"), "n_shingles", "band", F.col("below").isNotNull().alias("lower")), "m"),
                            2 * n_stars), "jaccard-members")
    n_placed = placed.count()
    tried = told.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    forests = 1
    while True:
        cross = saved(in_files(_crossing(placed, bits, found, percent, forests), n_placed, dealt=True), "jaccard-cross")
        new = saved(in_files(cross.where("x IS NOT NULL").select("x", "y").distinct().join(tried, ["x", "y"], "left_anti"), cross.count()), "jaccard-pairs")
        n_new = new.count()
        if n_new:
            links = links.unionByName(_edges_of(saved(in_files(_linked(docs, new, width, percent), n_new, dealt=True), "jaccard-links")))
            n_told += n_new
            found = components(links, n_told)
        cut = cross.where("cut IS NOT NULL").select(F.col("cut").alias("key")).distinct()
        if cut.isEmpty():
            break
        tried, placed, forests = tried.unionByName(new), placed.join(cut, "key", "left_semi"), forests * MORE_FORESTS

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n_shingles", "c", "alt", F.coalesce("component", "rep").alias("component_id"))
    return base.select("doc_id", "n_shingles", "c", "alt").join(of_class, ["n_shingles", "c", "alt"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _edges_of(told: DataFrame) -> DataFrame:
    return told.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Wordless documents and rows with a NULL id stay. Repeated rows of the smallest id are one document and all stay.
    """
    keep = similar_documents(docs, width, percent).where("doc_id = component_id").select("doc_id").distinct()
    rest = docs.join(keep.hint("shuffle_hash"), "doc_id", "left_semi")
    return docs.where("doc_id IS NULL").unionByName(rest.select(*columns(docs)))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies among all ``documents``: three-word shingles, Jaccard similarity 9/10."""
    return similar_documents(table(spark, sf, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS p, any_value(y.n) AS q, count(*) AS i
  FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n GROUP BY 1, 2)
  WHERE 100 * i >= 90 * (p + q - i)),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
