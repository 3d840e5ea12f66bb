"""Variable importance and interactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import local_table, one_row
from timberline.functions.impurity import impurity
from timberline.operators.nodecounts import class_columns, node_class_counts, pivoted
from timberline.operators.ordering import draw, draw_text, global_index
from timberline.plans.tree import TreeModel


def split_gains(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """``(node_id, split_feature, n, gain)`` of every split, counted on ``df``."""
    nodes = pivoted(node_class_counts(df, model, weight_col=weight_col), model)
    valued = nodes.withColumn("imp", impurity(class_columns(model), model.criterion))
    kids = valued.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(
        F.try_divide(F.sum(F.col("n") * F.col("imp")), F.sum("n")).alias("below"))
    return (valued.where("NOT is_terminal").join(F.broadcast(kids), "node_id")
            .select("node_id", "split_feature", "n", (F.col("imp") - F.coalesce("below", F.lit(0.0))).alias("gain")))


def _normalised(table: DataFrame) -> DataFrame:
    """Shares of the total, zeros dropped, with rank and cumulative share."""
    total = F.sum("raw").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.round("share", 12)), "feature")
    t = table.withColumn("share", F.when(total > 0, F.col("raw") / total).otherwise(0.0)).where("share > 0")
    return t.select("feature", F.col("share").alias("importance"), F.row_number().over(order).alias("place"),
                    F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def feature_importance(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Impurity importance: share of rows times impurity decrease, summed and normalised."""
    gains = split_gains(df, model, weight_col)
    return _normalised(gains.groupBy(F.col("split_feature").alias("feature")).agg(
        F.greatest(F.sum(F.col("n") * F.col("gain")), F.lit(0.0)).alias("raw")))


def gain_importance(df: DataFrame, model: TreeModel, weight_col: str | None = None) -> DataFrame:
    """Sum of the gains of a feature's splits, not weighted by rows, normalised."""
    return _normalised(split_gains(df, model, weight_col).groupBy(F.col("split_feature").alias("feature")).agg(
        F.greatest(F.sum("gain"), F.lit(0.0)).alias("raw")))


def features_for_share(table: DataFrame, share: float = 0.9) -> DataFrame:
    """How many top features are needed to reach a cumulative share."""
    return table.agg(F.count_if(F.round(F.col("cumulative") - F.col("importance"), 12) < share).alias("features"))


# --- permutation ---------------------------------------------------------

TRIAL_BATCH = 32  # trials evaluated by one job, which reads the rows once per trial


def used_features(model: TreeModel) -> list[str]:
    """Features of the splits in node order — the order of the ``x0…`` columns."""
    return list(dict.fromkeys(n.split.feature for n in model.internal()))


@dataclass(frozen=True)
class Shuffle:
    """One trial: the features to permute and how far each is shifted."""
    name: str
    rep: int
    shifts: tuple[tuple[str, int], ...]


def shift_of(feature: str, rep: int, seed: int, n: int) -> int:
    """Shift in 1…n-1 from the md5 of feature, repeat and seed."""
    if n < 2:
        return 0
    return int(draw_text(feature, rep, seed)[:8], 16) % (n - 1) + 1


def _indexed(df: DataFrame, model: TreeModel, key: Sequence[str], seed: int) -> DataFrame:
    inputs = model.inputs(df)
    rows = df.where(F.col(f"`{model.target}`").isNotNull()).select(
        F.col(f"`{model.target}`").cast("string").alias("_y"), draw(key, seed).alias("_d"),
        *[inputs[f].alias(f"x{i}") for i, f in enumerate(used_features(model))])
    return global_index(rows, [F.col("_d")], "_i").drop("_d")


def shuffled_accuracy(indexed: DataFrame, model: TreeModel, trials: Sequence[Shuffle], n: int) -> dict[tuple[str, int], float]:
    """Accuracy of every trial, many trials to a job.

    Rows stand in drawn order, so giving row i the value of row i + shift
    (modulo n) permutes a feature at random. Each trial reads its donor rows
    through a join on the row position, a key without repeats.
    """
    if len(trials) > TRIAL_BATCH:
        out = {}
        for i in range(0, len(trials), TRIAL_BATCH):
            out |= shuffled_accuracy(indexed, model, trials[i:i + TRIAL_BATCH], n)
        return out
    features = used_features(model)
    place = {f: i for i, f in enumerate(features)}
    width = max(len(t.shifts) for t in trials)
    donors = indexed.select(F.col("_i"), *[F.col(f"x{i}") for i in range(len(features))])
    rows = [F.struct(F.lit(t).alias("_t"), *[
        e for w in range(width) for e in (
            F.lit(place[trial.shifts[w][0]] if w < len(trial.shifts) else -1).alias(f"_f{w}"),
            F.lit(trial.shifts[w][1] if w < len(trial.shifts) else 0).cast("long").alias(f"_s{w}"))])
        for t, trial in enumerate(trials)]
    wide = indexed.select("*", F.inline(F.array(*rows)))
    for w in range(width):
        wide = wide.withColumn(f"_j{w}", F.pmod(F.col("_i") + F.col(f"_s{w}"), F.lit(n)))
        side = donors.select(F.col("_i").alias(f"_j{w}"), *[F.col(f"x{i}").alias(f"d{w}_{i}") for i in range(len(features))])
        wide = wide.join(side, f"_j{w}")
    values = {}
    for f, i in place.items():
        c = F.col(f"x{i}")
        for w in range(width):
            c = F.when(F.col(f"_f{w}") == i, F.col(f"d{w}_{i}")).otherwise(c)
        values[f] = c
    guess = model.route(values, lambda node: F.lit(model.prediction(node.node_id)))
    hits = wide.groupBy("_t").agg(F.count_if(guess == F.col("_y")).alias("hits")).collect()
    return {(trials[r["_t"]].name, trials[r["_t"]].rep): r["hits"] / n for r in hits}


def _baseline(indexed: DataFrame, model: TreeModel) -> tuple[int, float]:
    features = used_features(model)
    values = {f: F.col(f"x{i}") for i, f in enumerate(features)}
    guess = model.route(values, lambda node: F.lit(model.prediction(node.node_id)))
    s = one_row(indexed, {"n": F.count(F.lit(1)), "hits": F.count_if(guess == F.col("_y"))})
    return s["n"], s["hits"] / s["n"] if s["n"] else 0.0


def permutation_drops(df: DataFrame, model: TreeModel, key: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """``(feature, rep, drop)``: accuracy lost when a feature is permuted.

    Features the tree does not use cannot change a prediction and are left out.
    """
    indexed = _indexed(df, model, key, seed)
    n, base = _baseline(indexed, model)
    features = used_features(model)
    trials = [Shuffle(f, r, ((f, shift_of(f, r, seed, n)),)) for f in features for r in range(repeats)]
    acc = shuffled_accuracy(indexed, model, trials, n) if trials else {}
    return local_table(df.sparkSession, [{"feature": f, "rep": r, "drop": base - a} for (f, r), a in acc.items()],
                       pa.schema([("feature", pa.string()), ("rep", pa.int32()), ("drop", pa.float64())]))


def permutation_importance(df: DataFrame, model: TreeModel, key: Sequence[str], repeats: int = 10,
                           seed: int = 42) -> DataFrame:
    """Mean accuracy drop, negatives to 0, normalised, with cumulative share."""
    drops = permutation_drops(df, model, key, repeats, seed)
    return _normalised(drops.groupBy("feature").agg(F.greatest(F.avg("drop"), F.lit(0.0)).alias("raw")))


def interactions(df: DataFrame, model: TreeModel, key: Sequence[str], features: Sequence[str] | None = None,
                 repeats: int = 5, seed: int = 42, top: int | None = 10, floor: float = 0.001) -> DataFrame:
    """drop(both) - drop(a) - drop(b) for pairs of features that each matter.

    Without a list of features the ``top`` most important ones are taken (``None``: all that the tree uses).
    """
    spark = df.sparkSession
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("interaction", pa.float64())])
    used = used_features(model)
    if features is None:
        features = [r["feature"] for r in feature_importance(df, model).orderBy("place").collect()][:top]
    features = [f for f in features if f in used]
    if len(features) < 2:
        return local_table(spark, [], schema)
    indexed = _indexed(df, model, key, seed)
    n, base = _baseline(indexed, model)
    single = [Shuffle(f, r, ((f, shift_of(f, r, seed, n)),)) for f in features for r in range(repeats)]
    acc = shuffled_accuracy(indexed, model, single, n)
    drop = {f: sum(base - acc[(f, r)] for r in range(repeats)) / repeats for f in features}
    pairs = [(a, b) for a, b in combinations([f for f in features if drop[f] > 0], 2)]
    if not pairs:
        return local_table(spark, [], schema)
    both = [Shuffle(f"{i}", r, ((a, shift_of(a, r, seed, n)), (b, shift_of(b, r, seed, n))))
            for i, (a, b) in enumerate(pairs) for r in range(repeats)]
    acc2 = shuffled_accuracy(indexed, model, both, n)
    rows = [{"a": a, "b": b, "interaction": sum(base - acc2[(f"{i}", r)] for r in range(repeats)) / repeats
             - drop[a] - drop[b]} for i, (a, b) in enumerate(pairs)]
    return local_table(spark, [r for r in rows if abs(r["interaction"]) > floor], schema)
