"""Row order, ranks, quantiles and draws without a single-task sort."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import BROADCAST_ROWS, clean_double, frozen

# Distinct values one aggregation buffer or one window group may hold.
GROUP_VALUES = 1_000_000
MAX_BUCKETS = 4096
CASE_EDGES = 64
COLUMN_BATCH = 64  # columns reshaped to long form together

ROW_BITS = 33  # width of the row part of monotonically_increasing_id


def bucket_of(x: Column, edges: Sequence[float], right: bool = True) -> Column:
    """Index of the interval of ``x`` between sorted ``edges`` (NULL stays NULL).

    ``right=True``: intervals ``(e[i-1], e[i]]``; otherwise ``[e[i-1], e[i])``.
    A row is compared about log2(len(edges)) times: by a balanced CASE for few
    edges, by halving steps over an array constant for many.
    """
    if len(edges) > CASE_EDGES:
        table = F.array(*[F.lit(float(e)) for e in edges])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])

        def step(at: Column, jump: Column) -> Column:
            edge = F.get(table, at + jump - 1)     # NULL past the end: no jump
            return F.when(x > edge if right else x >= edge, at + jump).otherwise(at)

        return F.when(x.isNotNull(), F.aggregate(steps, F.lit(0), step))

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(float(edges[mid]))
        return F.when(x <= edge if right else x < edge, node(lo, mid)).otherwise(node(mid + 1, hi))

    return F.when(x.isNotNull(), node(0, len(edges)))


def draw(keys: Sequence[str | Column], *salts: object) -> Column:
    """Deterministic 128-bit hex draw per key and salt: md5 of the joined text."""
    parts = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]
    parts += [s if isinstance(s, Column) else F.lit(str(s)) for s in salts]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def draw_text(*parts: object) -> str:
    """The same draw for values held by the driver."""
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def uniform(keys: Sequence[str | Column], *salts: object) -> Column:
    """Deterministic uniform number in [0, 1) from the first 32 bits of the draw."""
    return F.conv(F.substring(draw(keys, *salts), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


# Poisson(1) distribution function at 0…11.
POISSON_ONE = tuple(math.exp(-1.0) * sum(1.0 / math.factorial(j) for j in range(k + 1)) for k in range(12))


def poisson_one(hex8: Column) -> Column:
    """Bootstrap multiplicity by inversion: Poisson(1) from 8 hex digits of a draw.

    The digits are compared as text with the scaled distribution function,
    which orders them like the numbers they write.
    """
    cuts = [f"{min(math.ceil(c * 2 ** 32), 2 ** 32 - 1):08x}" for c in POISSON_ONE]

    def node(lo: int, hi: int) -> Column:
        # small counts are by far the most likely, so they are tested first
        return F.lit(lo) if lo == hi else F.when(hex8 < cuts[lo], lo).otherwise(node(lo + 1, hi))

    return node(0, len(cuts)).cast("long")


def with_replicates(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Adds bootstrap weights ``w0…``; one md5 serves four replicates.

    Draws, digits and weights are separate projections, so that each is
    computed once per row however often it is used.
    """
    groups = range(-(-n // 4))
    drawn = df.withColumns({f"_d{g}": draw(keys, seed, g) for g in groups})
    parts = drawn.withColumns({f"_h{r}": F.substring(f"_d{r // 4}", (r % 4) * 8 + 1, 8) for r in range(n)})
    weighted = parts.withColumns({f"w{r}": poisson_one(F.col(f"_h{r}")) for r in range(n)})
    return weighted.drop(*[f"_d{g}" for g in groups], *[f"_h{r}" for r in range(n)])


def global_index(df: DataFrame, order_by: Sequence[Column], name: str = "index") -> DataFrame:
    """Exact zero-based position of every row in the given total order.

    Range partitioning spreads the sort; equal rows are split by a running id
    so that no group of copies ends up in one task. The sorted rows are
    checkpointed, which fixes partitions and positions; the index is then the
    partition's offset plus the position inside it — no window, no second
    shuffle.
    """
    order = [*order_by, F.monotonically_increasing_id()]
    ordered = frozen(df.repartitionByRange(*order).sortWithinPartitions(*order))
    mono = F.monotonically_increasing_id()
    placed = ordered.withColumn("_mono", mono)
    part = F.shiftright("_mono", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).count().collect()
    offsets, run = [], 0
    by_part = {r["_part"]: r["count"] for r in sizes}
    for p in range(max(by_part, default=-1) + 1):
        offsets.append(run)
        run += by_part.get(p, 0)
    if not offsets:
        offsets = [0]
    table = F.array(*[F.lit(o).cast("long") for o in offsets])
    local = F.col("_mono").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (placed
            .withColumn(name, F.get(table, part.cast("int")) + local)
            .drop("_mono"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the table is proven to have at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def lookup(df: DataFrame, table: DataFrame, key: str, weight: str, total: int,
           heavy_share: int = 1000) -> DataFrame:
    """Left join of ``df`` with a one-row-per-key ``table``, safe for hot keys.

    A small table is broadcast after counting it. A large one is split by its
    ``weight`` column (rows of ``df`` per key): keys with more than
    ``total / heavy_share`` rows number fewer than ``heavy_share`` and are
    broadcast; the remaining keys go through a shuffle where none is hot.
    """
    if small(table):
        return df.join(F.broadcast(table.drop(weight)), key, "left")
    heavy = F.col(weight) * heavy_share > F.lit(total)
    marked = df.join(
        F.broadcast(table.where(heavy).drop(weight).withColumn("_hot", F.lit(True))), key, "left")
    hot = marked.where("_hot").drop("_hot")
    cold = (marked.where("_hot IS NULL").select(*df.columns)
            .join(table.where(~heavy).drop(weight), key, "left"))
    return hot.unionByName(cold)


def value_edges(values: DataFrame, value: str, distinct: int, target: int = GROUP_VALUES) -> list[float]:
    """Cut points that keep about ``target`` distinct values per bucket ([] = one bucket)."""
    k = min(MAX_BUCKETS, math.ceil(distinct / target))
    if k <= 1:
        return []
    probs = [i / k for i in range(1, k)]
    row = values.select(F.col(value)).distinct().agg(
        F.percentile_approx(value, probs, max(10_000, 20 * k)).alias("e")).first()
    return sorted(set(row["e"] or []))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(clean_double(df, col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def running_sums(table: DataFrame, value: str, sums: Sequence[str], edges: Sequence[float],
                 descending: bool = False) -> DataFrame:
    """Adds ``cum_<s>``: inclusive running sums over a table with one row per value.

    Rows are windowed inside value buckets (``edges``); the sums of the buckets
    before come from a bucket-total table with ``len(edges) + 1`` rows.
    """
    rows = table.where(F.col(value).isNotNull()).withColumn("_b", bucket_of(F.col(value), edges))
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums})
    if not edges:
        return out.drop("_b")
    totals = {r["_b"]: r for r in rows.groupBy("_b").agg(*[F.sum(s).alias(s) for s in sums]).collect()}
    buckets = range(len(edges) + 1)
    for s in sums:
        offsets, run = {}, 0
        for b in (reversed(buckets) if descending else buckets):
            offsets[b] = run
            run += totals[b][s] if b in totals else 0
        table_ = F.array(*[F.lit(offsets[b]) for b in buckets])
        out = out.withColumn(f"cum_{s}", F.col(f"cum_{s}") + F.get(table_, F.col("_b")))
    return out.drop("_b")


def exact_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], accuracy: int = 10_000,
                    group_values: int = GROUP_VALUES) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation, ``{column: [q…]}`` on the driver.

    Two passes over all columns together. The first brackets every wanted rank
    between two sketched quantiles. The second counts the rows of the gaps and,
    value by value, of the narrow bands in between, where the exact values are
    then read off. A column whose ranks miss the bands, or whose bands hold too
    many values for one window group, goes through a full value count instead.
    """
    cols = list(wanted)
    if len(cols) > COLUMN_BATCH:
        out = {}
        for i in range(0, len(cols), COLUMN_BATCH):
            out |= exact_quantiles(df, {c: wanted[c] for c in cols[i:i + COLUMN_BATCH]}, accuracy, group_values)
        return out
    if not cols:
        return {}
    slack = 2.0 / accuracy
    brackets = {c: sorted({max(0.0, p - slack) for p in wanted[c]} | {min(1.0, p + slack) for p in wanted[c]}) for c in cols}
    first = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.percentile_approx(clean_double(df, c), brackets[c], accuracy).alias(f"q{i}"),
        F.count(clean_double(df, c)).alias(f"n{i}"))]).first()
    out: dict[str, list[float | None]] = {}
    bands: dict[int, list[tuple[float, float]]] = {}
    for i, c in enumerate(cols):
        if not first[f"n{i}"]:
            out[c] = [None] * len(wanted[c])
            continue
        at = dict(zip(brackets[c], first[f"q{i}"]))
        spans: list[tuple[float, float]] = []
        for p in sorted(wanted[c]):
            lo, hi = at[max(0.0, p - slack)], at[min(1.0, p + slack)]
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        bands[i] = spans
    if not bands:
        return out

    def slot(x: Column, spans: list[tuple[float, float]]) -> Column:
        """Odd numbers inside a band, even numbers in the gaps."""
        expr = None
        for j, (lo, hi) in enumerate(spans):
            expr = F.when(x < lo, 2 * j) if expr is None else expr.when(x < lo, 2 * j)
            expr = expr.when(x <= hi, 2 * j + 1)
        return expr.otherwise(2 * len(spans))

    cells = [F.struct(F.lit(i).alias("f"), slot(clean_double(df, cols[i]), spans).alias("s"),
                      clean_double(df, cols[i]).alias("v")) for i, spans in bands.items()]
    counted = (df.select(F.inline(F.array(*cells))).where("v IS NOT NULL")
               .select("f", "s", F.when(F.col("s") % 2 == 1, F.col("v")).alias("v"))
               .groupBy("f", "s", "v").agg(F.count(F.lit(1)).alias("n")).persist())
    sizes = counted.groupBy("f", "s").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")).collect()
    need, start = [], {}
    for i in bands:
        c, n, run = cols[i], first[f"n{i}"], 0
        slots = sorted((r["s"], r["n"], r["values"]) for r in sizes if r["f"] == i)
        ranks = {r for p in wanted[c] for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
        fine = True
        for s, size, values in slots:
            inside = [r for r in ranks if run <= r < run + size]
            fine = fine and not (inside and (s % 2 == 0 or values > group_values))
            start[(i, s)] = run
            run += size
        if fine:
            need += [(i, s, r) for r in ranks for s, size, _ in slots if start[(i, s)] <= r < start[(i, s)] + size]
        else:
            out[c] = _ranked_values(df, c, wanted[c], n, group_values)
    found: dict[tuple[int, int], float] = {}
    if need:
        inside = Window.partitionBy("f", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        pairs = sorted({(i, s) for i, s, _ in need})
        key = F.struct("f", "s")
        offset = F.create_map(*[x for i, s in pairs for x in (F.struct(F.lit(i).alias("f"), F.lit(s).alias("s")),
                                                              F.lit(start[(i, s)]).cast("long"))])
        ranks = F.create_map(*[x for i, s in pairs for x in (
            F.struct(F.lit(i).alias("f"), F.lit(s).alias("s")),
            F.array(*[F.lit(r).cast("long") for a, b, r in need if (a, b) == (i, s)]))])
        placed = (counted.where(F.col("s") % 2 == 1).withColumn("hi", F.sum("n").over(inside) + offset[key])
                  .where(F.exists(ranks[key], lambda r: (r < F.col("hi")) & (r >= F.col("hi") - F.col("n")))))
        for r in placed.collect():
            for i, s, rank in need:
                if (i, s) == (r["f"], r["s"]) and r["hi"] - r["n"] <= rank < r["hi"]:
                    found[(i, rank)] = r["v"]
    counted.unpersist()
    for i in bands:
        c, n = cols[i], first[f"n{i}"]
        if c in out:
            continue
        result = []
        for p in wanted[c]:
            pos = p * (n - 1)
            lo, hi = found[(i, math.floor(pos))], found[(i, math.ceil(pos))]
            result.append(lo + (hi - lo) * (pos - math.floor(pos)))
        out[c] = result
    return out


def _ranked_values(df: DataFrame, col: str, probs: Sequence[float], n: int, group_values: int) -> list[float | None]:
    """Quantiles from the full value counts, windowed inside value buckets."""
    counts = value_counts(df, col).where("value IS NOT NULL").persist()
    edges = value_edges(counts, "value", counts.count(), group_values)
    ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    bucketed = counts.withColumn("_b", bucket_of(F.col("value"), edges))
    totals = {r["_b"]: r["t"] for r in bucketed.groupBy("_b").agg(F.sum("n").alias("t")).collect()}
    spans, run = [], 0
    for b in sorted(totals):
        spans.append((b, run, run + totals[b]))
        run += totals[b]
    need = sorted({b for r in ranks for b, lo, hi in spans if lo <= r < hi})
    start = {b: lo for b, lo, _ in spans}
    inside = Window.partitionBy("_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.create_map(*[F.lit(v) for b in need for v in (b, start[b])])[F.col("_b")]
    placed = (bucketed.where(F.col("_b").isin(need))
              .withColumn("_hi", F.sum("n").over(inside) + offset))
    hit = F.array(*[F.lit(r) for r in ranks])
    wanted_rows = placed.where(F.exists(hit, lambda r: (r < F.col("_hi")) & (r >= F.col("_hi") - F.col("n"))))
    found = [(r["_hi"] - r["n"], r["_hi"], r["value"]) for r in wanted_rows.collect()]
    counts.unpersist()

    def at(rank: int) -> float:
        return next(v for lo, hi, v in found if lo <= rank < hi)

    result = []
    for p in probs:
        pos = p * (n - 1)
        lo, hi = at(math.floor(pos)), at(math.ceil(pos))
        result.append(lo + (hi - lo) * (pos - math.floor(pos)))
    return result


def average_rank(df: DataFrame, col: str, name: str, group_values: int = GROUP_VALUES) -> DataFrame:
    """Rank with ties averaged: counted per value, prefix-summed, joined back."""
    counts = frozen(value_counts(df, col))
    info = counts.agg(F.count("value").alias("d"), F.sum("n").alias("n")).first()
    edges = value_edges(counts.where("value IS NOT NULL"), "value", info["d"] or 0, group_values)
    ranks = running_sums(counts, "value", ["n"], edges).select(
        F.col("value").alias("_v"), "n",
        (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    keyed = df.withColumn("_v", clean_double(df, col))
    return lookup(keyed, ranks, "_v", "n", info["n"] or 0).drop("_v")
