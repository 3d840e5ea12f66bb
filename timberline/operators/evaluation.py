"""Evaluation of scored tables.

A scored table has the true class, the prediction and the positive
probability. Everything derives from two small tables: class pairs, and
positives/negatives per distinct score (at most one row per leaf).
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.core import clean_double, frozen, local_table, one_row, spread
from timberline.operators.grow import TreeParams, feature_kinds, fit, grow, laid_out
from timberline.operators.missing import LEARNED, fill_values, fill_with
from timberline.operators.ordering import draw, global_index, running_sums, small, value_edges, with_replicates
from timberline.operators.splits import CLASS, WEIGHT
from timberline.plans.tree import TreeModel

METRICS = pa.schema([("metric", pa.string()), ("value", pa.float64())])
FOLDS = pa.schema([("fold", pa.int32()), ("n", pa.int64()), ("correct", pa.int64()), ("accuracy", pa.float64())])

MAX_PAIRS = 1_000_000  # pairs of class and prediction that the driver takes


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _mass(scored: DataFrame, weight_col: str | None, condition: Column | None = None) -> Column:
    """Number of rows, or their weight, where a condition holds."""
    if weight_col is None:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    w = clean_double(scored, weight_col)
    return F.sum(w if condition is None else F.when(condition, w).otherwise(0.0))


def confusion_matrix(scored: DataFrame, y: str = "y", prediction: str = "prediction", weight_col: str | None = None) -> DataFrame:
    """``(actual, predicted, n, row_share)`` for every pair that occurs."""
    pairs = (scored.where(F.col(f"`{y}`").isNotNull())
             .groupBy(_text(y).alias("actual"), _text(prediction).alias("predicted"))
             .agg(_mass(scored, weight_col).alias("n")))
    return pairs.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def _pairs(scored: DataFrame, y: str, prediction: str, weight_col: str | None = None) -> dict[tuple[str, str], float]:
    n = _mass(scored, weight_col)
    rows = (scored.where(F.col(f"`{y}`").isNotNull())
            .groupBy(_text(y).alias("a"), _text(prediction).alias("p")).agg(n.alias("n")).limit(MAX_PAIRS + 1).collect())
    if len(rows) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of class and prediction")
    return {(r["a"], r["p"]): float(r["n"]) for r in rows}


def _div(a: float, b: float) -> float:
    return a / b if b else 0.0


def class_metrics(scored: DataFrame, y: str = "y", prediction: str = "prediction", weight_col: str | None = None) -> DataFrame:
    """Precision, recall, F1, support and predicted count per class, plus macro and weighted rows.

    With weights, support and predicted count are sums of weights.
    """
    pairs = _pairs(scored, y, prediction, weight_col)
    size = pa.int64() if weight_col is None else pa.float64()
    return local_table(scored.sparkSession, _class_rows(pairs, int if weight_col is None else float), pa.schema([
        ("class", pa.string()), ("precision", pa.float64()), ("recall", pa.float64()), ("f1", pa.float64()),
        ("support", size), ("predicted", size)]))


def _class_rows(pairs: dict[tuple[str, str], float], size=int) -> list[dict]:
    classes = sorted({c for pair in pairs for c in pair if c is not None})
    rows = []
    for c in classes:
        tp = pairs.get((c, c), 0.0)
        support = sum(n for (a, _), n in pairs.items() if a == c)
        predicted = sum(n for (_, p), n in pairs.items() if p == c)
        precision, recall = _div(tp, predicted), _div(tp, support)
        rows.append({"class": c, "precision": precision, "recall": recall,
                     "f1": _div(2 * precision * recall, precision + recall),
                     "support": size(support), "predicted": size(predicted)})
    total = sum(r["support"] for r in rows)
    for name, weight in (("macro", lambda r: 1 / len(rows)), ("weighted", lambda r: _div(r["support"], total))):
        rows.append({"class": f"{name} avg", **{m: sum(r[m] * weight(r) for r in rows[:len(classes)])
                                                for m in ("precision", "recall", "f1")},
                     "support": total, "predicted": total})
    return rows


def classification_metrics(scored: DataFrame, y: str = "y", prediction: str = "prediction",
                           positive: str | None = None, weight_col: str | None = None) -> DataFrame:
    """Accuracy family, binary rates and MCC as ``(metric, value)``.

    With weights, ``weighted_`` metrics of the same names follow, from sums of weights.
    """
    pairs = _pairs(scored, y, prediction)
    rows = [{"metric": k, "value": v} for k, v in _metric_values(pairs, positive).items()]
    if weight_col is not None:
        weighted = _metric_values(_pairs(scored, y, prediction, weight_col), positive)
        rows += [{"metric": f"weighted_{k}", "value": v} for k, v in weighted.items()]
    return local_table(scored.sparkSession, rows, METRICS)


def _metric_values(pairs: dict[tuple[str, str], float], positive: str | None) -> dict[str, float]:
    total = sum(pairs.values())
    right = sum(n for (a, p), n in pairs.items() if a == p)
    per_class = _class_rows(pairs, float)[:-2]
    seen = [r for r in per_class if r["support"]]
    out = {"accuracy": _div(right, total), "error_rate": 1.0 - _div(right, total),
           # every class weighted by 1 / its count
           "balanced_accuracy": _div(sum(r["recall"] for r in seen), len(seen))}
    if positive is not None:
        tp = pairs.get((positive, positive), 0.0)
        fn = sum(n for (a, p), n in pairs.items() if a == positive and p != positive)
        fp = sum(n for (a, p), n in pairs.items() if a != positive and p == positive)
        tn = total - tp - fn - fp
        out |= {"tp": tp, "fp": fp, "tn": tn, "fn": fn, "tpr": _div(tp, tp + fn), "tnr": _div(tn, tn + fp),
                "fpr": _div(fp, fp + tn), "fnr": _div(fn, fn + tp), "ppv": _div(tp, tp + fp),
                "npv": _div(tn, tn + fn), "f1": _div(2 * tp, 2 * tp + fp + fn),
                "mcc": _div(tp * tn - fp * fn, math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))}
        out |= {"sensitivity": out["tpr"], "specificity": out["tnr"]}
    return out


def class_distribution(scored: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """Actual and predicted rows per class."""
    pairs = scored.groupBy(_text(y).alias("a"), _text(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select("n", F.inline(F.array(
        F.struct(F.col("a").alias("class"), F.lit(1).alias("is_actual")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("is_actual"))))).where("class IS NOT NULL")
    return both.groupBy("class").agg(F.sum(F.when(F.col("is_actual") == 1, F.col("n")).otherwise(0)).alias("actual"),
                                     F.sum(F.when(F.col("is_actual") == 0, F.col("n")).otherwise(0)).alias("predicted"))


def log_loss(scored: DataFrame, y: str = "y", p: str = "p", positive: str = "1", weight_col: str | None = None) -> DataFrame:
    """(Weighted) mean of -ln(probability of the true class), clipped at 1e-15."""
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1.0 - 1e-15), F.col(p)))
    loss = F.when(_text(y) == positive, -F.ln(clipped)).otherwise(-F.ln(F.lit(1.0) - clipped))
    rows = scored.where(F.col(f"`{y}`").isNotNull())
    if weight_col is None:
        return rows.agg(F.avg(loss).alias("log_loss"))
    w = clean_double(scored, weight_col)
    return rows.agg(F.try_divide(F.sum(w * loss), F.sum(F.when(loss.isNotNull(), w))).alias("log_loss"))


# --- rank metrics --------------------------------------------------------

def score_table(scored: DataFrame, y: str = "y", p: str = "p", positive: str = "1", weight_col: str | None = None) -> tuple[DataFrame, float, float]:
    """``(p, pos, neg, cum_pos, cum_neg)`` by falling score, with the class totals.

    One row per distinct score: leaves for a tree. With very many distinct
    scores the running sums are bucketed. With weights the counts are sums of weights.
    """
    rows = scored.where(F.col(f"`{y}`").isNotNull() & F.col(p).isNotNull())
    table = frozen(rows.groupBy(F.col(p).cast("double").alias("p")).agg(
        _mass(scored, weight_col, _text(y) == positive).alias("pos"), _mass(scored, weight_col, _text(y) != positive).alias("neg")))
    t = table.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("d")).first()
    edges = value_edges(table, "p", t["d"])
    return (running_sums(table, "p", ["pos", "neg"], edges, descending=True),
            float(t["pos"] or 0), float(t["neg"] or 0))


def roc_auc(scored: DataFrame, y: str = "y", p: str = "p", positive: str = "1", weight_col: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    t, pos, neg = score_table(scored, y, p, positive, weight_col)
    above = F.col("cum_pos") - F.col("pos") / 2.0
    return t.agg(F.try_divide(F.sum(F.col("neg") * above), F.lit(pos * neg)).alias("auc"))


def average_precision(scored: DataFrame, y: str = "y", p: str = "p", positive: str = "1", weight_col: str | None = None) -> DataFrame:
    """Sum of recall steps times precision."""
    t, pos, _ = score_table(scored, y, p, positive, weight_col)
    step = F.try_divide(F.col("pos").cast("double"), F.lit(pos)) * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return t.agg(F.sum(step).alias("average_precision"))


def ks_curve(scored: DataFrame, y: str = "y", p: str = "p", positive: str = "1", weight_col: str | None = None) -> DataFrame:
    t, pos, neg = score_table(scored, y, p, positive, weight_col)
    cdf_pos, cdf_neg = F.try_divide("cum_pos", F.lit(pos)), F.try_divide("cum_neg", F.lit(neg))
    return t.select(F.col("p").alias("threshold"), cdf_pos.alias("cdf_pos"), cdf_neg.alias("cdf_neg"),
                    F.abs(cdf_pos - cdf_neg).alias("ks"))


def ks_statistic(scored: DataFrame, y: str = "y", p: str = "p", positive: str = "1", weight_col: str | None = None) -> DataFrame:
    """Largest distance of the cumulative class shares and the highest score reaching it."""
    return ks_curve(scored, y, p, positive, weight_col).agg(
        F.max("ks").alias("ks"), F.max_by("threshold", F.struct(F.round("ks", 12), "threshold")).alias("threshold"))


def threshold_counts(scored: DataFrame, thresholds: Sequence[float] | None = None, y: str = "y", p: str = "p",
                     positive: str = "1", weight_col: str | None = None) -> DataFrame:
    """``(threshold, tp, fp, pos, neg)``: rows scoring at or above each threshold.

    Without thresholds the distinct scores are used, with 0 and 1 added.
    """
    t, pos, neg = score_table(scored, y, p, positive, weight_col)
    kind = "long" if weight_col is None else "double"
    totals = [F.lit(pos).cast(kind).alias("pos"), F.lit(neg).cast(kind).alias("neg")]
    none = F.lit(0).cast(kind)
    if thresholds is None:
        own = t.select(F.col("p").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
        ends = t.agg(F.max("cum_pos").alias("a"), F.max("cum_neg").alias("b"), F.max("p").alias("hi"), F.min("p").alias("lo"))
        ends = ends.select(F.inline(F.array(
            F.when(F.col("hi") < 1.0, F.struct(F.lit(1.0).alias("threshold"), none.alias("tp"), none.alias("fp"))),
            F.when(F.col("lo") > 0.0, F.struct(F.lit(0.0).alias("threshold"), F.col("a").alias("tp"),
                                               F.col("b").alias("fp")))))).where("threshold IS NOT NULL")
        return own.unionByName(ends).select("*", *totals)
    # explicit thresholds: one sum per threshold over the score table
    cuts = sorted(set(thresholds))
    wide = t.agg(*[F.struct(F.lit(float(c)).alias("threshold"),
                            F.sum(F.when(F.col("p") >= c, F.col("pos")).otherwise(0)).alias("tp"),
                            F.sum(F.when(F.col("p") >= c, F.col("neg")).otherwise(0)).alias("fp")).alias(f"s{i}")
                   for i, c in enumerate(cuts)])
    return wide.select(F.inline(F.array(*[f"s{i}" for i in range(len(cuts))]))).select("*", *totals)


def roc_curve(scored: DataFrame, thresholds: Sequence[float] | None = None, **kw) -> DataFrame:
    """``(threshold, fpr, tpr)``; the ends (0,0) and (1,1) always occur."""
    t = threshold_counts(scored, thresholds, **kw)
    curve = t.select("threshold", F.coalesce(F.try_divide("fp", "neg"), F.lit(0.0)).alias("fpr"),
                     F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)).alias("tpr"))
    if thresholds is None:
        return curve
    seen = curve.agg(F.max("fpr").alias("a"), F.max("tpr").alias("b"), F.min("fpr").alias("c"), F.min("tpr").alias("d"))
    none = F.lit(None).cast("double").alias("threshold")
    ends = seen.select(F.inline(F.array(
        F.when((F.col("c") > 0) | (F.col("d") > 0), F.struct(none, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))),
        F.when((F.col("a") < 1) | (F.col("b") < 1), F.struct(none, F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))
    ))).where("fpr IS NOT NULL")
    return curve.unionByName(ends)


def _area(curve: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Trapezoid area; a curve has one row per threshold, which is checked."""
    if not small(curve, 1_000_000):
        raise ValueError("too many thresholds for one curve; give a threshold list")
    w = Window.orderBy(x, y)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0
    return curve.select(part.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias(name))


def roc_area(scored: DataFrame, thresholds: Sequence[float] | None = None, **kw) -> DataFrame:
    return _area(roc_curve(scored, thresholds, **kw), "fpr", "tpr", "area")


def pr_curve(scored: DataFrame, thresholds: Sequence[float] | None = None, **kw) -> DataFrame:
    """``(threshold, precision, recall)``; precision is 0 where nothing is predicted positive."""
    return threshold_counts(scored, thresholds, **kw).select(
        "threshold", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)).alias("recall"))


def pr_area(scored: DataFrame, thresholds: Sequence[float] | None = None, **kw) -> DataFrame:
    return _area(pr_curve(scored, thresholds, **kw), "recall", "precision", "area")


def lift_curve(scored: DataFrame, thresholds: Sequence[float] | None = None, **kw) -> DataFrame:
    """Cumulative lift and percent of the rows at or above each threshold (NULL base rate → NULL)."""
    n = F.col("pos") + F.col("neg")
    taken = F.col("tp") + F.col("fp")
    lift = F.try_divide(F.try_divide(F.col("tp"), taken), F.try_divide(F.col("pos"), n))
    return threshold_counts(scored, thresholds, **kw).select(
        "threshold", F.when(taken > 0, lift).otherwise(0.0).alias("lift"),
        F.try_divide(taken * F.lit(100.0), n).alias("population_pct"))


def lift_table(scored: DataFrame, key: Sequence[str], n: int = 10, y: str = "y", p: str = "p", positive: str = "1",
               seed: int = 42) -> DataFrame:
    """Response rate and lift of n equal row bins of falling score; ties in drawn order."""
    rows = scored.where(F.col(f"`{y}`").isNotNull() & F.col(p).isNotNull())
    keyed = rows.select(F.col(p).alias("_p"), draw(key, seed).alias("_d"), (_text(y) == positive).cast("long").alias("_y"))
    indexed = global_index(keyed, [F.col("_p").desc(), F.col("_d")], "_i")
    total = one_row(indexed, {"n": F.count(F.lit(1)), "pos": F.sum("_y")})
    # quantile bins of the positions 0…N-1, right-closed
    last = total["n"] - 1
    bins = F.greatest(F.lit(1), F.ceil(F.col("_i") * F.lit(n) / F.lit(max(last, 1)))) - 1
    base = (total["pos"] or 0) / total["n"] if total["n"] else 0.0
    return (indexed.groupBy(bins.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))
            .select("bin", "n", "positives", (F.col("positives") / F.col("n")).alias("rate"),
                    F.try_divide(F.col("positives") / F.col("n"), F.lit(base)).alias("lift")))


# --- resampling ----------------------------------------------------------

def assign_folds(df: DataFrame, target: str, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds: position inside the class in drawn order, modulo k.

    Positions come from one distributed index over (class, draw) minus the
    class's first position.
    """
    rows = df.where(F.col(f"`{target}`").isNotNull())
    y = _text(target)
    sizes = {r["y"]: r["n"] for r in rows.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("too many classes to stratify")
    start, run = {}, 0
    for c in sorted(sizes, key=lambda s: s.encode()):
        start[c] = run
        run += sizes[c]
    indexed = global_index(rows.withColumns({"_y": y, "_d": draw(key, seed)}), [F.col("_y"), F.col("_d")], "_i")
    offset = F.create_map(*[F.lit(v) for c, s in start.items() for v in (c, s)])[F.col("_y")]
    return indexed.withColumn("fold", F.pmod(F.col("_i") - offset, F.lit(k)).cast("int")).drop("_i", "_d", "_y")


def cross_validate(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], k: int = 5, seed: int = 42,
                   categorical: Sequence[str] = (), **params) -> DataFrame:
    """Accuracy per fold. The k trees grow together: one job per level for all folds.

    When ``missing`` learns fill values from the rows, each fold is filled with values of its training rows only, and
    its tree grows by itself.
    """
    p = TreeParams(**params)
    kinds = feature_kinds(df, features, categorical)
    folds = assign_folds(df, target, key, k, seed)
    if p.missing in LEARNED:
        out = []
        for r in range(k):
            filled = fill_with(folds, fill_values(folds.where(F.col("fold") != r), features, p.missing))
            model = fit(filled.where(F.col("fold") != r), features, target, categorical, **{**params, "missing": "ignore"})
            guess = model.route(model.inputs(filled), lambda n, m=model: F.lit(m.prediction(n.node_id)))
            n, right = filled.where(F.col("fold") == r).agg(F.count(F.lit(1)), F.count_if(guess == _text(target))).first()
            out += [{"fold": r, "n": n, "correct": right, "accuracy": right / n}] if n else []
        return local_table(df.sparkSession, out, FOLDS)
    with laid_out(folds, kinds, target, p, keep=["fold"]) as (data, layout, classes, pos, _):
        train = data.withColumn("_rep", F.explode(F.array_except(
            F.array(*[F.lit(i) for i in range(k)]), F.array("fold"))))
        at_root = {r: [0.0] * len(classes) for r in range(k)}
        for row in data.groupBy("fold", CLASS).agg(F.sum(WEIGHT).alias("w")).collect():
            for r in range(k):
                if r != row["fold"]:
                    at_root[r][row[CLASS]] += float(row["w"])
        models = grow(train, kinds, classes, pos, target, p, layout, at_root, rep_col="_rep")
        right = None
        for r, model in models.items():
            guess = model.route(model.inputs(data), lambda n, m=model: F.lit(classes.index(m.prediction(n.node_id))))
            hit = F.col("fold") == r
            right = F.when(hit, guess) if right is None else right.when(hit, guess)
        rows = data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"),
                                        F.count_if(right == F.col(CLASS)).alias("correct")).collect()
    out = [{"fold": r["fold"], "n": r["n"], "correct": r["correct"], "accuracy": r["correct"] / r["n"]}
           for r in sorted(rows, key=lambda r: r["fold"])]
    return local_table(df.sparkSession, out, FOLDS)


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"),
                     F.min("accuracy").alias("cv_min"), F.max("accuracy").alias("cv_max"))


def model_stability(scored: DataFrame, key: Sequence[str], n: int = 100, seed: int = 42, y: str = "y",
                    prediction: str = "prediction") -> DataFrame:
    """Bootstrap accuracy: rows are scored once, replicates are weighted sums in one pass."""
    rows = spread(scored.where(F.col(f"`{y}`").isNotNull()).select(
        *key, (_text(y) == _text(prediction)).cast("long").alias("_ok")))
    weighted = with_replicates(rows, key, n, seed)
    s = one_row(weighted, {k: v for r in range(n) for k, v in (
        (f"n{r}", F.sum(f"w{r}")), (f"c{r}", F.sum(F.col(f"w{r}") * F.col("_ok"))))})
    acc = [s[f"c{r}"] / s[f"n{r}"] for r in range(n) if s[f"n{r}"]]
    mean = statistics.fmean(acc) if acc else 0.0
    std = statistics.pstdev(acc) if acc else 0.0
    row = {"accuracy_mean": mean, "accuracy_std": std, "accuracy_min": min(acc, default=0.0),
           "accuracy_max": max(acc, default=0.0), "stability": 1.0 - std / mean if mean > 0 else 0.0}
    return local_table(scored.sparkSession, [row], pa.schema([(c, pa.float64()) for c in row]))


def compare_models(scored: dict[str, DataFrame], y: str = "y", prediction: str = "prediction", p: str = "p",
                   positive: str = "1", weight_col: str | None = None) -> DataFrame:
    """``(model, metric, value)``: class and rank metrics of several scored tables.

    Each table is read once, for the rows (or weights) per class, prediction and score; all metrics follow from these.
    """
    rows = []
    for name, table in scored.items():
        cells = frozen(table.where(F.col(f"`{y}`").isNotNull()).groupBy(
            _text(y).alias("y"), _text(prediction).alias("prediction"), F.col(p).cast("double").alias("p")).agg(
            _mass(table, weight_col).cast("double").alias("n")))
        values = _metric_values(_pairs(cells, "y", "prediction", "n"), positive)
        values["auc"] = roc_auc(cells, positive=positive, weight_col="n").first()[0]
        values["average_precision"] = average_precision(cells, positive=positive, weight_col="n").first()[0]
        values["ks"] = ks_statistic(cells, positive=positive, weight_col="n").first()["ks"]
        values["log_loss"] = log_loss(cells, positive=positive, weight_col="n").first()[0]
        rows += [{"model": name, "metric": m, "value": v} for m, v in values.items()]
    spark = next(iter(scored.values())).sparkSession
    return local_table(spark, rows, pa.schema([("model", pa.string()), ("metric", pa.string()), ("value", pa.float64())]))


def evaluate(df: DataFrame, model: TreeModel, threshold: float | None = 0.5) -> DataFrame:
    """Score and list every metric as ``(metric, value)``."""
    from timberline.operators.scoring import predict
    scored = predict(df, model, threshold if len(model.classes) == 2 else None)
    return compare_models({"model": scored}, model.target, positive=model.positive).drop("model")
