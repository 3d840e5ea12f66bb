"""Mix sources to target weights with Sainte-Laguë quotas of equal-token blocks.

Every source is cut into shards by a seeded hash of its rows. The rows of a
shard, in hash order, form one stream of words that is cut into blocks of
(nearly) ``block`` words. Seats of the mix are blocks: the highest quotients
``votes / (2 q + 1)`` first allot them to sources, then within a source to its
shards. A shard with ``n`` blocks and quota ``q`` is taken ``q div n`` times as
a whole; ``q mod n`` further blocks are chosen as one seeded arc of the stream,
so that nearly all documents are taken whole. No block is taken more than
``cap`` times.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.llm.common import WORD, boxed, columns, empty_if_null, in_files, saved, unboxed, unused, word_count

# Rows of a shard: small sources get shards of 64 rows up to 256 shards, large
# ones shards of 65,536 rows. Both only set how far the work spreads.
SMALL_SHARD, SHARDS, LARGE_SHARD = 64, 256, 65_536


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Share the sum of ``sizes`` by weight; excess over ``cap`` x size is reshared until none is above."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            return out
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``v / (2 q + 1)``, at most ``most`` each; ties go to the lower index."""
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = min(int(seats), int(most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def at(x: float) -> np.ndarray:
        """Seats whose quotient is at least x."""
        return np.minimum(most, np.floor(np.minimum(votes / (2 * x) + 0.5, 2.0 ** 62)).astype(np.int64))

    low, high = 0.0, float(votes.max()) * 2
    low = float(votes[votes > 0].min()) / (4.0 * float(most.max()) + 4)
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    got = at(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _shard_quotas(cap: int):
    def quotas(g: pd.DataFrame) -> pd.DataFrame:
        """Quotas of one source's shards; ``seats`` blocks in proportion to their blocks."""
        g = g.sort_values("shard")
        n = g["blocks"].to_numpy()
        q = sainte_lague(n.astype(float), int(g["seats"].iloc[0]), cap * n)
        return pd.DataFrame({"sid": g["sid"].to_numpy(), "shard": g["shard"].to_numpy(), "quota": q})
    return quotas


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block: int = 16, seed: int = 17,
        source: str = "source", text: str | None = "text", size: str | None = None) -> DataFrame:
    """Every row with ``mix_size, mix_source_size, mix_target, mix_taken, mix_spans``.

    Sources in code point order, NULL last, weigh ``weights``, repeating. A row's size is its number of words (or
    column ``size``; NULL counts as 0); ``mix_taken`` is how many words of it the mix takes, repeats counted, and
    ``mix_spans`` lists the copies as word ranges ``(from, to)``. Repeated rows are rows of their own; a row of size 0
    gets no copies; an empty table gives an empty result. Input columns named like a result column are replaced. Only one row per source reaches the driver.
    """
    spark, names = docs.sparkSession, docs.columns
    measured = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(text)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.simpleString() in ("bigint", "int", "string")]
    sized = boxed(docs, measured.alias("mix_size"), F.xxhash64(F.lit(seed), *hashed).alias("_key"), F.col(f"`{source}`").cast("string").alias("_source"))
    per = sized.groupBy(F.col("_source").alias("_s")).agg(F.count("*").alias("n"), F.sum("mix_size").alias("w")).collect()
    per = sorted(per, key=lambda r: (r["_s"] is None, (r["_s"] or "").encode("utf-32-be")))
    goal = targets([r["w"] for r in per], [weights[i % len(weights)] for i in range(len(per))], cap)
    schema = pa.schema([("_s", pa.string()), ("sid", pa.int64()), ("shards", pa.int64()),
                        ("mix_source_size", pa.int64()), ("mix_target", pa.float64())])
    rows = [{"_s": r["_s"], "sid": i, "mix_source_size": r["w"], "mix_target": goal[i],
             "shards": max(min(SHARDS, -(-r["n"] // SMALL_SHARD)), -(-r["n"] // LARGE_SHARD))} for i, r in enumerate(per)]
    sources = local_table(spark, rows, schema)
    dealt = (sized.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("shard", F.pmod("_key", "shards")))
    # words and blocks of each shard
    shard = saved(in_files(dealt.groupBy("sid", "shard").agg(F.sum("mix_size").alias("words"))
                           .withColumn("blocks", F.ceil(F.col("words") / block).cast("long")), sum(r["shards"] for r in rows)), "mix-shards")
    blocks = {r["sid"]: r["n"] for r in shard.groupBy("sid").agg(F.sum("blocks").alias("n")).collect()}
    n = np.array([blocks.get(i, 0) for i in range(len(per))], np.int64)
    votes = np.array([goal[i] * n[i] / r["w"] if r["w"] else 0.0 for i, r in enumerate(per)])
    seats = sainte_lague(votes, round(votes.sum()), cap * n) if len(per) else n
    allotted = local_table(spark, [{"sid": i, "seats": int(s)} for i, s in enumerate(seats)],
                           pa.schema([("sid", pa.int64()), ("seats", pa.int64())]))
    quotas = (shard.where("blocks > 0").join(allotted, "sid").select("sid", "shard", "blocks", "seats").groupBy("sid")
              .applyInPandas(_shard_quotas(cap), "sid long, shard long, quota long"))
    plan = shard.join(quotas, ["sid", "shard"], "left").select(
        "sid", "shard", "words", F.greatest("blocks", F.lit(1)).alias("blocks"), F.coalesce("quota", F.lit(0)).alias("quota"))

    in_shard = Window.partitionBy("sid", "shard").orderBy("_key", "mix_size")
    to_here = in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_end", F.sum("mix_size").over(to_here)).withColumn("_start", F.col("_end") - F.col("mix_size"))
    full, extra = F.expr("quota div blocks"), F.col("quota") % F.col("blocks")
    first = F.pmod(F.xxhash64(F.lit(seed), "sid", "shard"), "blocks")
    border = lambda b: F.expr(f"(({b}) * words) div blocks")
    placed = placed.join(plan, ["sid", "shard"]).withColumns({"_full": full, "_first": first, "_last": first + extra}).withColumns({
        "_a": border("_first"), "_b": border("least(_last, blocks)"), "_c": border("greatest(_last - blocks, 0)")})
    zero = F.lit(0).cast("long")
    arcs = {"_from1": F.greatest(F.col("_a") - F.col("_start"), zero), "_to1": F.least(F.col("_b"), F.col("_end")) - F.col("_start"),
            "_from2": zero, "_to2": F.least(F.col("_c"), F.col("_end")) - F.col("_start")}
    placed = placed.withColumns(arcs)
    over = lambda k: F.greatest(F.col(f"_to{k}") - F.col(f"_from{k}"), zero)
    span = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    spans = F.concat(
        F.array_repeat(span(zero, F.col("mix_size")), F.col("_full").cast("int")),
        F.filter(F.array(span(F.col("_from1"), F.col("_to1")), span(F.col("_from2"), F.col("_to2"))), lambda s: s["to"] > s["from"]))
    taken = F.col("_full") * F.col("mix_size") + over(1) + over(2)
    placed = placed.withColumns({"mix_taken": taken, "mix_spans": F.when(F.col("mix_size") > 0, spans).otherwise(F.slice(spans, 1, 0))})
    return unboxed(placed, names, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_spans")


def excerpt(text: Column, start: Column, stop: Column, size: Column) -> Column:
    """Words ``start`` to ``stop`` of a text with the white space after each; the text itself when that is all of it."""
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, (start + 1).cast("int"), (stop - start).cast("int")), "")
    return F.when((start == 0) & (stop == size), text).otherwise(part)


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per copy taken, cut to the words taken.

    The length column ``n_chars``, when there is one, follows the cut text.
    """
    row = unused(docs, "row")
    whole = docs.select(F.struct(*columns(docs)).alias(row), *[F.col(f"`{c}`") for c in (text, options.get("source", "source"))])
    out = mix(whole, text=text, **options).withColumn("span", F.explode("mix_spans"))
    out = out.withColumn("body", excerpt(empty_if_null(text), F.col("span.from"), F.col("span.to"), F.col("mix_size")))
    new = {text: F.col("body")}
    if n_chars in docs.columns:
        new[n_chars] = F.length("body").cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns])


def op10_mix_sources(spark, sf: str) -> DataFrame:
    """All ``documents`` mixed to weights 5, 2, 1 with targets up to three times a source's size."""
    from timberline.llm.common import table
    sized = saved(table(spark, sf, "documents").select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    return mix(sized, text=None, size="size").select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
