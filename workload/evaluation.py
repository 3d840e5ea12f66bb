"""Evaluation, importance, reports, recipes, scoring of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timberline.core import checkpoint_dir
from timberline.operators import evaluation as V
from timberline.operators import grow as G
from timberline.operators import importance as I
from timberline.operators import pruning as P
from timberline.operators import reports as N
from timberline.operators import scoring as S
from timberline.plans import recipe as K
from timberline.streaming import scoring as ST
from workload.base import CREDIT, CREDIT_NULL, DOCS, credit, credit_null, docs, query, table
from workload.binning import weight_sql
from workload.trees import KEY, LEAF, fixed_tree

CUT = 0.334

SCORED = f"""
    r AS (SELECT *, {LEAF} AS leaf_id FROM {CREDIT}), m AS (SELECT leaf_id, AVG(y) AS p FROM r GROUP BY 1),
    s AS (SELECT r.*, m.p, (m.p >= {CUT})::INT AS yh FROM r JOIN m USING (leaf_id)),
    c AS (SELECT SUM(y * yh)::DOUBLE AS tp, SUM((1 - y) * yh)::DOUBLE AS fp, SUM((1 - y) * (1 - yh))::DOUBLE AS tn, SUM(y * (1 - yh))::DOUBLE AS fn, COUNT(*)::DOUBLE AS n FROM s)"""
SCORED3 = f"""
    r AS (SELECT l_returnflag AS y, {LEAF} AS leaf_id FROM lineitem), k AS (SELECT leaf_id, y, COUNT(*) AS n FROM r GROUP BY ALL),
    m AS (SELECT leaf_id, arg_min(y, (-n, y)) AS guess FROM k GROUP BY 1), s AS (SELECT r.y, m.guess FROM r JOIN m USING (leaf_id))"""


def scored(spark, sf, threshold=CUT):
    return S.predict(credit(spark, sf), fixed_tree(spark, sf), threshold)


def scored3(spark, sf):
    return S.predict(credit(spark, sf).drop("y"), fixed_tree(spark, sf, "l_returnflag")).withColumnRenamed("l_returnflag", "y")


@query("confusion_matrix", f"""
    WITH {SCORED} SELECT CAST(y AS VARCHAR) AS actual, CAST(yh AS VARCHAR) AS predicted, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY y) AS row_share
    FROM s GROUP BY y, yh""", "row_share")
def confusion_matrix(spark, sf):
    return V.confusion_matrix(scored(spark, sf))


@query("confusion_matrix_multiclass", f"""
    WITH {SCORED3} SELECT y AS actual, guess AS predicted, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY y) AS row_share FROM s GROUP BY y, guess""", "row_share")
def confusion_matrix_multiclass(spark, sf):
    return V.confusion_matrix(scored3(spark, sf))


def metric_rows(pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::DOUBLE AS value FROM c" for k, v in pairs.items())


BINARY = {
    "accuracy": "(tp + tn) / n", "error_rate": "(fp + fn) / n", "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "tp": "tp", "fp": "fp", "tn": "tn", "fn": "fn", "tpr": "tp / (tp + fn)", "tnr": "tn / (tn + fp)", "fpr": "fp / (fp + tn)", "fnr": "fn / (fn + tp)",
    "ppv": "COALESCE(tp / NULLIF(tp + fp, 0), 0)", "npv": "COALESCE(tn / NULLIF(tn + fn, 0), 0)", "f1": "2 * tp / (2 * tp + fp + fn)",
    "mcc": "COALESCE((tp * tn - fp * fn) / NULLIF(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)",
    "sensitivity": "tp / (tp + fn)", "specificity": "tn / (tn + fp)"}


WEIGHTED = """SELECT SUM(l_quantity * y * yh)::DOUBLE AS tp, SUM(l_quantity * (1 - y) * yh)::DOUBLE AS fp, SUM(l_quantity * (1 - y) * (1 - yh))::DOUBLE AS tn,
    SUM(l_quantity * y * (1 - yh))::DOUBLE AS fn, SUM(l_quantity)::DOUBLE AS n FROM s"""


@query("classification_metrics", f"""
    WITH {SCORED} {metric_rows(BINARY)} UNION ALL SELECT 'weighted_' || metric, value FROM (WITH c AS ({WEIGHTED}) {metric_rows(BINARY)})""", "value")
def classification_metrics(spark, sf):
    return V.classification_metrics(scored(spark, sf), positive="1", weight_col="l_quantity")


@query("class_metrics", f"""
    WITH {SCORED3}, t AS (SELECT DISTINCT y AS class FROM s),
    a AS (SELECT class, (SELECT COUNT(*) FROM s WHERE y = class AND guess = class)::DOUBLE AS tp, (SELECT COUNT(*) FROM s WHERE y = class) AS support,
                 (SELECT COUNT(*) FROM s WHERE guess = class) AS predicted FROM t),
    b AS (SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, tp / support AS recall, 2 * tp / (support + predicted) AS f1, support, predicted FROM a)
    SELECT * FROM b UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support)::BIGINT, SUM(support)::BIGINT FROM b
    UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support), SUM(f1 * support) / SUM(support), SUM(support)::BIGINT, SUM(support)::BIGINT FROM b""",
       "precision recall f1")
def class_metrics(spark, sf):
    return V.class_metrics(scored3(spark, sf))


@query("class_distribution", f"""
    WITH {SCORED3} SELECT class, (SELECT COUNT(*) FROM s WHERE y = class) AS actual, (SELECT COUNT(*) FROM s WHERE guess = class) AS predicted
    FROM (SELECT y AS class FROM s UNION SELECT guess FROM s)""")
def class_distribution(spark, sf):
    return V.class_distribution(scored3(spark, sf))


@query("log_loss", f"WITH {SCORED} SELECT AVG(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss FROM s", "log_loss")
def log_loss(spark, sf):
    return V.log_loss(scored(spark, sf))


@query("roc_auc", f"""
    WITH {SCORED}, k AS (SELECT p, SUM(y)::DOUBLE AS a, SUM(1 - y)::DOUBLE AS b FROM s GROUP BY p)
    SELECT SUM(x.a * y.b * CASE WHEN x.p > y.p THEN 1 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / (SUM(x.a * y.b)) AS auc FROM k x, k y""", "auc")
def roc_auc(spark, sf):
    return V.roc_auc(scored(spark, sf))


@query("roc_auc_weighted", f"""
    WITH {SCORED}, k AS (SELECT p, SUM(l_quantity * y)::DOUBLE AS a, SUM(l_quantity * (1 - y))::DOUBLE AS b FROM s GROUP BY p)
    SELECT SUM(x.a * y.b * CASE WHEN x.p > y.p THEN 1 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / (SUM(x.a * y.b)) AS auc FROM k x, k y""", "auc")
def roc_auc_weighted(spark, sf):
    return V.roc_auc(scored(spark, sf), weight_col="l_quantity")


@query("log_loss_weighted", f"WITH {SCORED} SELECT SUM(l_quantity * CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) / SUM(l_quantity) AS log_loss FROM s", "log_loss")
def log_loss_weighted(spark, sf):
    return V.log_loss(scored(spark, sf), weight_col="l_quantity")


# a score with very many distinct values: the price itself
@query("roc_auc_continuous", f"""
    SELECT (SUM(CASE WHEN y = 1 THEN rk END) - MAX(np) * (MAX(np) + 1) / 2) / (MAX(np) * (COUNT(*) - MAX(np))) AS auc FROM
      (SELECT y, rank() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rk, (SUM(y) OVER ())::DOUBLE AS np FROM {CREDIT})""", "auc")
def roc_auc_continuous(spark, sf):
    return V.roc_auc(credit(spark, sf).withColumn("p", F.col("l_extendedprice")))


@query("average_precision", f"""
    WITH {SCORED}, t AS (SELECT DISTINCT p AS t FROM s),
    q AS (SELECT t, SUM(y)::DOUBLE AS tp, COUNT(*)::DOUBLE AS k FROM t JOIN s ON s.p >= t GROUP BY t),
    w AS (SELECT tp / k AS prec, (tp - lag(tp, 1, 0) OVER (ORDER BY t DESC)) / (SELECT SUM(y) FROM s) AS step FROM q)
    SELECT SUM(prec * step) AS average_precision FROM w""", "average_precision")
def average_precision(spark, sf):
    return V.average_precision(scored(spark, sf))


KS = f"""{SCORED}, t AS (SELECT DISTINCT p AS threshold FROM s),
    q AS (SELECT threshold, SUM(y)::DOUBLE / (SELECT SUM(y) FROM s) AS cdf_pos, SUM(1 - y)::DOUBLE / (SELECT SUM(1 - y) FROM s) AS cdf_neg FROM t JOIN s ON s.p >= threshold GROUP BY 1)"""


@query("ks_curve", f"WITH {KS} SELECT *, ABS(cdf_pos - cdf_neg) AS ks FROM q", "threshold cdf_pos cdf_neg ks")
def ks_curve(spark, sf):
    return V.ks_curve(scored(spark, sf))


@query("ks_statistic", f"WITH {KS} SELECT ABS(cdf_pos - cdf_neg) AS ks, threshold FROM q ORDER BY ROUND(ABS(cdf_pos - cdf_neg), 12) DESC, threshold DESC LIMIT 1", "ks threshold")
def ks_statistic(spark, sf):
    return V.ks_statistic(scored(spark, sf))


CURVE = f"""{SCORED}, t AS (SELECT DISTINCT p AS threshold FROM s UNION SELECT 0 UNION SELECT 1),
    q AS (SELECT threshold, COALESCE(SUM(y), 0)::DOUBLE AS tp, COALESCE(SUM(1 - y), 0)::DOUBLE AS fp FROM t LEFT JOIN s ON s.p >= threshold GROUP BY 1),
    w AS (SELECT SUM(y)::DOUBLE AS pos, SUM(1 - y)::DOUBLE AS neg FROM s)"""


@query("roc_curve", f"WITH {CURVE} SELECT threshold, fp / neg AS fpr, tp / pos AS tpr FROM q, w", "threshold fpr tpr")
def roc_curve(spark, sf):
    return V.roc_curve(scored(spark, sf))


@query("roc_curve_thresholds", f"""
    WITH {SCORED}, t AS (SELECT unnest([0.33, 0.3333, 0.334, 0.335]::DOUBLE[]) AS threshold),
    q AS (SELECT threshold, COALESCE(SUM(y), 0)::DOUBLE / (SELECT SUM(y) FROM s) AS tpr, COALESCE(SUM(1 - y), 0)::DOUBLE / (SELECT SUM(1 - y) FROM s) AS fpr FROM t LEFT JOIN s ON s.p >= threshold GROUP BY 1)
    SELECT threshold, fpr, tpr FROM q UNION ALL SELECT NULL, 0, 0 WHERE (SELECT MIN(fpr) FROM q) > 0 OR (SELECT MIN(tpr) FROM q) > 0
    UNION ALL SELECT NULL, 1, 1 WHERE (SELECT MAX(fpr) FROM q) < 1 OR (SELECT MAX(tpr) FROM q) < 1""", "threshold fpr tpr")
def roc_curve_thresholds(spark, sf):
    return V.roc_curve(scored(spark, sf), [0.33, 0.3333, 0.334, 0.335])


@query("roc_area", f"""
    WITH {CURVE}, c2 AS (SELECT fp / neg AS x, tp / pos AS v FROM q, w)
    SELECT SUM((x - px) * (v + pv) / 2) AS area FROM (SELECT x, v, lag(x) OVER o AS px, lag(v) OVER o AS pv FROM c2 WINDOW o AS (ORDER BY x, v))""", "area")
def roc_area(spark, sf):
    return V.roc_area(scored(spark, sf))


@query("pr_curve", f"WITH {CURVE} SELECT threshold, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, tp / pos AS recall FROM q, w", "threshold precision recall")
def pr_curve(spark, sf):
    return V.pr_curve(scored(spark, sf))


@query("pr_area", f"""
    WITH {CURVE}, u AS (SELECT COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, tp / pos AS recall FROM q, w),
    a AS (SELECT (recall - lag(recall) OVER o) * (precision + lag(precision) OVER o) / 2 AS a FROM u WINDOW o AS (ORDER BY recall, precision))
    SELECT SUM(a) AS area FROM a""", "area")
def pr_area(spark, sf):
    return V.pr_area(scored(spark, sf))


@query("lift_curve", f"""
    WITH {CURVE} SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) / (pos / (pos + neg)) ELSE 0 END AS lift, (tp + fp) * 100 / (pos + neg) AS population_pct FROM q, w""",
       "threshold lift population_pct")
def lift_curve(spark, sf):
    return V.lift_curve(scored(spark, sf))


ORDER = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, '42'))"


@query("lift_table", f"""
    WITH {SCORED}, o AS (SELECT y, row_number() OVER (ORDER BY p DESC, {ORDER}) - 1 AS i, COUNT(*) OVER () AS n FROM s),
    b AS (SELECT CAST(GREATEST(1, ceil(i * 10 / (n - 1)::DOUBLE)) - 1 AS INT) AS bin, COUNT(*) AS n, SUM(y)::BIGINT AS positives FROM o GROUP BY 1)
    SELECT bin, n, positives, positives::DOUBLE / n AS rate, positives::DOUBLE / n / (SELECT AVG(y) FROM s) AS lift FROM b""", "rate lift")
def lift_table(spark, sf):
    return V.lift_table(scored(spark, sf), KEY)


@query("assign_folds", f"""
    SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5(concat_ws('|', doc_id, '42'))) - 1) % 5 AS INT) AS fold FROM {DOCS}""")
def assign_folds(spark, sf):
    return V.assign_folds(docs(spark, sf), "toxic", ["doc_id"]).select("doc_id", "toxic", "fold")


def _cv_sql() -> str:
    """Five one-split trees on n_chars, each scored on its own fold."""
    imp = lambda a, b: f"(1 - (power({a}, 2) + power({b}, 2)) / power({a} + {b}, 2))"
    return f"""
    WITH f AS (SELECT *, (row_number() OVER (PARTITION BY toxic ORDER BY md5(concat_ws('|', doc_id, '42'))) - 1) % 5 AS fold FROM {DOCS}),
    h AS (SELECT rep, n_chars AS v, SUM(1 - toxic)::DOUBLE AS c0, SUM(toxic)::DOUBLE AS c1 FROM f, (SELECT unnest(range(5)) AS rep) WHERE fold <> rep GROUP BY ALL),
    p AS (SELECT rep, (v + lead(v) OVER w) / 2.0::DOUBLE AS thr, SUM(c0) OVER w AS l0, SUM(c1) OVER w AS l1, SUM(c0) OVER (PARTITION BY rep) AS t0, SUM(c1) OVER (PARTITION BY rep) AS t1
          FROM h WINDOW w AS (PARTITION BY rep ORDER BY v ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, {imp('t0', 't1')} - (l0 + l1) / (t0 + t1) * {imp('l0', 'l1')} - (t0 + t1 - l0 - l1) / (t0 + t1) * {imp('(t0 - l0)', '(t1 - l1)')} AS gain FROM p WHERE thr IS NOT NULL),
    b AS (SELECT *, (l1 > l0)::INT AS left_guess, (t1 - l1 > t0 - l0)::INT AS right_guess FROM g QUALIFY row_number() OVER (PARTITION BY rep ORDER BY ROUND(gain, 12) DESC, thr) = 1)
    SELECT CAST(fold AS INT) AS fold, COUNT(*) AS n, COUNT(*) FILTER (toxic = CASE WHEN n_chars <= thr THEN left_guess ELSE right_guess END) AS correct,
           AVG((toxic = CASE WHEN n_chars <= thr THEN left_guess ELSE right_guess END)::INT) AS accuracy FROM f JOIN b ON f.fold = b.rep GROUP BY fold"""


@query("cross_validate", _cv_sql(), "accuracy")
def cross_validate(spark, sf):
    return V.cross_validate(docs(spark, sf), ["n_chars"], "toxic", ["doc_id"], criterion="gini", max_depth=1)


@query("cross_validation_summary", f"SELECT AVG(accuracy) AS cv_mean, stddev_pop(accuracy) AS cv_std, MIN(accuracy) AS cv_min, MAX(accuracy) AS cv_max FROM ({_cv_sql()})",
       "cv_mean cv_std cv_min cv_max")
def cross_validation_summary(spark, sf):
    return V.cross_validation_summary(V.cross_validate(docs(spark, sf), ["n_chars"], "toxic", ["doc_id"], criterion="gini", max_depth=1))


@query("model_stability", f"""
    WITH {SCORED}, w AS (SELECT x.r AS rep, (y = yh)::INT AS ok, {weight_sql('l_orderkey, l_partkey, l_suppkey, l_linenumber', 'x.r')} AS w FROM s, (SELECT unnest(range(12)) AS r) x),
    a AS (SELECT SUM(w * ok)::DOUBLE / SUM(w) AS acc FROM w GROUP BY rep)
    SELECT AVG(acc) AS accuracy_mean, stddev_pop(acc) AS accuracy_std, MIN(acc) AS accuracy_min, MAX(acc) AS accuracy_max, 1 - stddev_pop(acc) / AVG(acc) AS stability FROM a""",
       "accuracy_mean accuracy_std accuracy_min accuracy_max stability")
def model_stability(spark, sf):
    return V.model_stability(scored(spark, sf), KEY, n=12)


def model_sql(name: str, cut: float) -> str:
    return f"""SELECT '{name}' AS model, metric, value FROM (
    WITH {SCORED.replace(f"p >= {CUT}", f"p >= {cut}")}, k AS (SELECT p, SUM(y)::DOUBLE AS a, SUM(1 - y)::DOUBLE AS b FROM s GROUP BY p),
    q AS (SELECT p, a, SUM(a) OVER o AS ca, SUM(b) OVER o AS cb, SUM(a) OVER () AS pa, SUM(b) OVER () AS pb FROM k WINDOW o AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
    {metric_rows(BINARY)}
    UNION ALL SELECT 'auc', SUM(x.a * y.b * CASE WHEN x.p > y.p THEN 1 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / SUM(x.a * y.b) FROM k x, k y
    UNION ALL SELECT 'average_precision', SUM(a / pa * ca / (ca + cb)) FROM q UNION ALL SELECT 'ks', MAX(ABS(ca / pa - cb / pb)) FROM q
    UNION ALL SELECT 'log_loss', AVG(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) FROM s)"""


@query("compare_models", f"{model_sql('cut', CUT)} UNION ALL {model_sql('all', 0.0)}", "value")
def compare_models(spark, sf):
    return V.compare_models({"cut": scored(spark, sf), "all": scored(spark, sf, 0.0)})


# --- reports -------------------------------------------------------------

ALL = f"""
    r AS (SELECT {LEAF} AS leaf, y FROM {CREDIT}), a AS (SELECT leaf AS node_id, y FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END, y FROM r UNION ALL SELECT 0, y FROM r),
    k0 AS (SELECT node_id, COUNT(*) AS n, SUM(y)::BIGINT AS p FROM a GROUP BY 1),
    k AS (SELECT *, 1 - power(p::DOUBLE / n, 2) - power(1 - p::DOUBLE / n, 2) AS imp, node_id >= 3 AS is_leaf,
          CASE node_id WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS up,
          CASE WHEN node_id = 0 THEN 0 WHEN node_id < 3 THEN 1 ELSE 2 END AS depth, GREATEST(p, n - p)::DOUBLE AS hits,
          CASE node_id WHEN 0 THEN 'x0' WHEN 1 THEN 'x/1' WHEN 2 THEN 'x/2' WHEN 3 THEN 'x/1/1' WHEN 4 THEN 'x/1/2' ELSE 'x/2/' || (node_id - 4) END AS path FROM k0)"""


def report_args(spark, sf):
    return credit(spark, sf), fixed_tree(spark, sf)


@query("node_report", f"""
    WITH {ALL} SELECT CAST(row_number() OVER w AS INT) AS node_no, node_id, path, n AS node_size, (SUM(n) OVER w)::BIGINT AS cumulative_size,
      ROUND(SUM(n) OVER w * 100.0::DOUBLE / SUM(n) OVER (), 2) AS cumulative_pct, p AS target_count, (SUM(p) OVER w)::BIGINT AS cumulative_target_count,
      p * 100.0::DOUBLE / n AS target_rate, ROUND(SUM(p) OVER w * 100.0::DOUBLE / SUM(n) OVER w, 2) AS cumulative_target_rate,
      p::DOUBLE / n / (SUM(p) OVER () / SUM(n) OVER ()::DOUBLE) * 100 AS lift
    FROM k WHERE is_leaf WINDOW w AS (ORDER BY n DESC, node_id ROWS UNBOUNDED PRECEDING)""", "target_rate lift cumulative_pct cumulative_target_rate")
def node_report(spark, sf):
    return N.node_report(*report_args(spark, sf)).drop("rule")


@query("node_report_weighted", f"""
    WITH r AS (SELECT {LEAF} AS node_id, l_quantity AS w, y FROM {CREDIT})
    SELECT node_id, SUM(w) AS node_size, SUM(w * y) AS target_count, SUM(w * y) * 100 / SUM(w) AS target_rate FROM r GROUP BY 1""", "node_size target_count target_rate")
def node_report_weighted(spark, sf):
    return N.node_report(*report_args(spark, sf), weight_col="l_quantity").select("node_id", "node_size", "target_count", "target_rate")


@query("prune_cc_search_weighted", f"""
    WITH r AS (SELECT {LEAF} AS leaf, l_quantity AS w, y FROM {CREDIT}), g AS (SELECT leaf, AVG(y) > 0.5 AS yes FROM r GROUP BY 1)
    SELECT SUM(w * (y = yes::INT)::INT) / SUM(w) AS accuracy FROM r JOIN g USING (leaf)""", "accuracy")
def prune_cc_search_weighted(spark, sf):
    """Accuracy of the unpruned tree (the smallest alpha), by weight."""
    _, trials = P.prune_cc_search(fixed_tree(spark, sf), credit(spark, sf), "l_quantity")
    return trials.orderBy("alpha").limit(1).select("accuracy")


@query("feature_importance_weighted", f"""
    WITH r AS (SELECT {LEAF} AS leaf, l_quantity AS w, y FROM {CREDIT}), a AS (SELECT leaf AS node, w, y FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END, w, y FROM r UNION ALL SELECT 0, w, y FROM r),
    k AS (SELECT node, SUM(w) AS n, SUM(w * y) AS p FROM a GROUP BY 1), i AS (SELECT node, n, 1 - power(p / n, 2) - power(1 - p / n, 2) AS imp, CASE WHEN node IN (1, 2) THEN 0 WHEN node IN (3, 4) THEN 1 WHEN node >= 5 THEN 2 END AS up FROM k),
    g AS (SELECT up.node, (up.imp - SUM(c.n * c.imp) / SUM(c.n)) * up.n AS raw FROM i c JOIN i up ON c.up = up.node GROUP BY up.node, up.imp, up.n)
    SELECT ['l_quantity', 'l_linestatus', 'l_extendedprice'][node + 1] AS feature, raw / SUM(raw) OVER () AS importance FROM g""", "importance")
def feature_importance_weighted(spark, sf):
    return I.feature_importance(*report_args(spark, sf), weight_col="l_quantity").select("feature", "importance")


@query("node_rates", f"""
    WITH {ALL} SELECT node_id, path, is_leaf AS is_terminal, n, p AS positives, n - p AS others, p * 100.0::DOUBLE / n AS target_rate, (n - p) * 100.0::DOUBLE / n AS other_rate,
      p::DOUBLE / n / (SELECT p::DOUBLE / n FROM k WHERE node_id = 0) * 100 AS lift FROM k""", "target_rate other_rate lift")
def node_rates(spark, sf):
    return N.node_rates(*report_args(spark, sf))


@query("class_shares", f"""
    WITH r AS (SELECT {LEAF} AS leaf, l_returnflag AS y FROM lineitem), a AS (SELECT leaf AS node_id, y FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END, y FROM r UNION ALL SELECT 0, y FROM r)
    SELECT node_id, y, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY node_id) AS share FROM a GROUP BY node_id, y""", "share")
def class_shares(spark, sf):
    return N.class_shares(credit(spark, sf), fixed_tree(spark, sf, "l_returnflag"))


@query("evaluate_nodes", f"""
    WITH {ALL} SELECT node_id, path, is_leaf AS is_terminal, n, CASE WHEN p > n - p THEN '1' ELSE '0' END AS prediction, hits / n AS accuracy,
      CASE WHEN p > n - p THEN p::DOUBLE / n ELSE 0 END AS precision, CASE WHEN p > n - p THEN 1 ELSE 0 END::DOUBLE AS recall,
      CASE WHEN p > n - p THEN 2 * p::DOUBLE / n / (p::DOUBLE / n + 1) ELSE 0 END AS f1 FROM k""", "accuracy precision recall f1")
def evaluate_nodes(spark, sf):
    return N.evaluate_nodes(*report_args(spark, sf))


@query("leaf_performance", f"""
    WITH {ALL} SELECT node_id, path, n, CASE WHEN p > n - p THEN '1' ELSE '0' END AS prediction, hits / n AS purity, hits / n AS accuracy, n / SUM(n) OVER ()::DOUBLE AS row_share
    FROM k WHERE is_leaf""", "purity accuracy row_share")
def leaf_performance(spark, sf):
    return N.leaf_performance(*report_args(spark, sf))


@query("leaf_performance_summary", f"""
    WITH {ALL} SELECT COUNT(*) AS leaves, MIN(hits / n) AS min_purity, MAX(hits / n) AS max_purity, AVG(hits / n) AS mean_purity, stddev_pop(hits / n) AS std_purity,
      MIN(hits / n) AS min_accuracy, MAX(hits / n) AS max_accuracy, AVG(hits / n) AS mean_accuracy, stddev_pop(hits / n) AS std_accuracy, SUM(hits) / SUM(n) AS weighted_accuracy FROM k WHERE is_leaf""",
       "min_purity max_purity mean_purity std_purity min_accuracy max_accuracy mean_accuracy std_accuracy weighted_accuracy")
def leaf_performance_summary(spark, sf):
    return N.leaf_performance_summary(*report_args(spark, sf))


@query("leaf_errors", f"""
    WITH r AS (SELECT {LEAF} AS leaf_id, l_tax * 100 AS v FROM lineitem), m AS (SELECT leaf_id, AVG(v) AS mean FROM r GROUP BY 1)
    SELECT leaf_id, COUNT(*) AS n, mean, AVG(power(v - mean, 2)) AS mse, AVG(ABS(v - mean)) AS mae, sqrt(AVG(power(v - mean, 2))) AS rmse FROM r JOIN m USING (leaf_id) GROUP BY leaf_id, mean""",
       "mean mse mae rmse")
def leaf_errors(spark, sf):
    df, model = report_args(spark, sf)
    return N.leaf_errors(df.withColumn("tax_pct", F.col("l_tax") * 100), model, "tax_pct")


@query("tree_summary", f"""
    WITH {ALL} SELECT COUNT(*) AS nodes, COUNT(*) FILTER (is_leaf) AS leaves, MAX(depth) AS depth, AVG(depth) FILTER (is_leaf) AS mean_leaf_depth, MIN(n) FILTER (is_leaf) AS min_leaf_size,
      MAX(n) FILTER (is_leaf) AS max_leaf_size, AVG(n) FILTER (is_leaf) AS mean_leaf_size, AVG(imp) AS mean_impurity, MIN(imp) AS min_impurity, MAX(imp) AS max_impurity,
      (SUM(p) FILTER (is_leaf))::BIGINT AS positives, (SUM(n) FILTER (is_leaf))::BIGINT AS rows FROM k""", "mean_leaf_depth mean_leaf_size mean_impurity min_impurity max_impurity")
def tree_summary(spark, sf):
    return N.tree_summary(*report_args(spark, sf))


@query("feature_usage", f"""
    WITH {ALL} SELECT CASE node_id WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_linestatus' ELSE 'l_extendedprice' END AS feature, 1::BIGINT AS splits, depth AS first_depth, n AS rows_split FROM k WHERE NOT is_leaf""")
def feature_usage(spark, sf):
    return N.feature_usage(*report_args(spark, sf))


@query("level_summary", f"""
    WITH {ALL} SELECT depth, COUNT(*) AS nodes, COUNT(*) FILTER (is_leaf) AS leaves, SUM(n)::BIGINT AS rows, AVG(imp) AS mean_impurity, SUM(imp * n) / SUM(n) AS weighted_impurity FROM k GROUP BY depth""",
       "mean_impurity weighted_impurity")
def level_summary(spark, sf):
    return N.level_summary(*report_args(spark, sf))


SPLITS = f"""{ALL}, q AS (SELECT k.node_id, k.n, k.imp, SUM(c.n * c.imp) / SUM(c.n) AS below, COUNT(*) AS kids, -SUM(c.n / k.n::DOUBLE * log2(c.n / k.n::DOUBLE)) AS h,
      MIN(c.imp) AS lo, MAX(c.imp) AS hi, AVG(c.imp) AS mid, stddev_pop(c.imp) AS sd,
      CASE k.node_id WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_linestatus' ELSE 'l_extendedprice' END AS f FROM k JOIN k c ON c.up = k.node_id GROUP BY k.node_id, k.n, k.imp)"""


@query("split_quality", f"""
    WITH {SPLITS} SELECT node_id, f AS split_feature, n, imp AS parent_impurity, below AS child_impurity, imp - below AS reduction, (imp - below) / imp AS relative_reduction,
      h / log2(kids) AS balance, lo AS min_child_impurity, hi AS max_child_impurity, mid AS mean_child_impurity, sd AS std_child_impurity FROM q""",
       "parent_impurity child_impurity reduction relative_reduction balance min_child_impurity max_child_impurity mean_child_impurity std_child_impurity", digits=9)
def split_quality(spark, sf):
    return N.split_quality(*report_args(spark, sf))


@query("important_nodes", f"""
    WITH {SPLITS} SELECT node_id, 'large_decrease' AS reason FROM q WHERE imp - below > 0.000001
    UNION ALL SELECT node_id, 'large_leaf' FROM (SELECT *, AVG(n) OVER () AS m FROM k WHERE is_leaf) WHERE n > 1.1 * m
    UNION ALL SELECT node_id, 'accurate_leaf' FROM k WHERE is_leaf AND hits / n > 0.6665""")
def important_nodes(spark, sf):
    return N.important_nodes(*report_args(spark, sf), decrease=0.000001, size_factor=1.1, accuracy=0.6665)


@query("compare_nodes", f"""
    WITH {ALL} SELECT a.node_id AS a, b.node_id AS b, a.up = b.up AS is_sibling, a.depth - b.depth AS depth_difference, a.n - b.n AS n_difference, a.imp - b.imp AS impurity_difference,
      a.p::DOUBLE / a.n - b.p::DOUBLE / b.n AS rate_difference, a.hits / a.n - b.hits / b.n AS accuracy_difference, (a.p > a.n - a.p) = (b.p > b.n - b.p) AS same_prediction
    FROM k a, k b WHERE a.node_id = 3 AND b.node_id = 4""", "impurity_difference rate_difference accuracy_difference")
def compare_nodes(spark, sf):
    return N.compare_nodes(*report_args(spark, sf), 3, 4)


@query("relatives", f"""
    WITH {ALL} SELECT c.node_id, c.up::BIGINT AS parent_id, c.n::DOUBLE / k.n AS size_ratio, k.imp - c.imp AS impurity_reduction,
      CAST(row_number() OVER (PARTITION BY c.up ORDER BY c.n DESC, c.node_id) AS INT) AS size_rank, CAST(row_number() OVER (PARTITION BY c.up ORDER BY c.imp, c.node_id) AS INT) AS purity_rank
    FROM k c JOIN k ON c.up = k.node_id""", "size_ratio impurity_reduction")
def relatives(spark, sf):
    return N.relatives(*report_args(spark, sf))


@query("purity", f"""
    WITH {ALL} SELECT node_id, n, imp AS gini, -(p::DOUBLE / n * log2(p::DOUBLE / n) + (1 - p::DOUBLE / n) * log2(1 - p::DOUBLE / n)) AS entropy, hits * 100 / n AS dominant_pct FROM k""",
       "gini entropy dominant_pct")
def purity(spark, sf):
    return N.purity(*report_args(spark, sf))


# --- importance ----------------------------------------------------------

def importance_sql(raw: str) -> str:
    return f"""WITH {SPLITS}, i AS (SELECT f, GREATEST(0, {raw}) AS raw FROM q), s AS (SELECT f AS feature, raw / SUM(raw) OVER () AS importance FROM i)
    SELECT feature, importance, CAST(row_number() OVER w AS INT) AS place, SUM(importance) OVER w AS cumulative FROM s WHERE importance > 0
    WINDOW w AS (ORDER BY ROUND(importance, 12) DESC, feature ROWS UNBOUNDED PRECEDING)"""


@query("feature_importance", importance_sql("n * (imp - below)"), "importance cumulative")
def feature_importance(spark, sf):
    return I.feature_importance(*report_args(spark, sf))


@query("gain_importance", importance_sql("imp - below"), "importance cumulative")
def gain_importance(spark, sf):
    return I.gain_importance(*report_args(spark, sf))


# a two-split tree on the labelled documents, so that permuting changes predictions
def docs_tree(spark, sf):
    from timberline.operators import edit as E
    from timberline.plans.tree import Split
    df = docs_target(spark, sf)
    m = G.fit(df, ["n_chars", "lang"], "y", growth="manual")
    m = E.apply_split(m, df, 0, Split("n_chars", "numeric", "<=", 2000.0))
    return E.apply_split(m, df, 1, Split("lang", "categorical", categories=(("en", 0), ("fr", 0), ("de", 1), ("es", 1))))


def docs_target(spark, sf):
    return docs(spark, sf).withColumn("y", ((F.col("n_chars") > 1500) | F.col("lang").isin("en", "fr")).cast("int"))


DT = f"""
    d AS (SELECT *, (n_chars > 1500 OR lang IN ('en', 'fr'))::INT AS y, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, '42'))) - 1 AS i, COUNT(*) OVER () AS n FROM {DOCS}),
    g AS (SELECT leaf, (2 * SUM(y) > COUNT(*))::INT AS guess FROM (SELECT *, CASE WHEN n_chars <= 2000 THEN CASE WHEN lang IN ('en', 'fr') THEN 3 ELSE 4 END ELSE 2 END AS leaf FROM d) GROUP BY leaf),
    reps AS (SELECT unnest(range(5)) AS rep),
    sh AS (SELECT f, rep, ('0x' || substr(md5(f || '|' || rep || '|42'), 1, 8))::BIGINT % ((SELECT COUNT(*) FROM d) - 1) + 1 AS s FROM (SELECT unnest(['n_chars', 'lang']) AS f), reps),
    base AS (SELECT AVG((d.y = g.guess)::INT) AS acc FROM d JOIN g ON g.leaf = CASE WHEN n_chars <= 2000 THEN CASE WHEN lang IN ('en', 'fr') THEN 3 ELSE 4 END ELSE 2 END),
    drops AS (SELECT sh.f, sh.rep, (SELECT acc FROM base) - AVG((d.y = g.guess)::INT) AS drop_ FROM d JOIN sh ON TRUE JOIN d o ON o.i = (d.i + sh.s) % d.n
      JOIN g ON g.leaf = CASE WHEN CASE WHEN sh.f = 'n_chars' THEN o.n_chars ELSE d.n_chars END <= 2000 THEN
        CASE WHEN CASE WHEN sh.f = 'lang' THEN o.lang ELSE d.lang END IN ('en', 'fr') THEN 3 ELSE 4 END ELSE 2 END GROUP BY sh.f, sh.rep)"""


@query("permutation_drops", f"WITH {DT} SELECT f AS feature, CAST(rep AS INT) AS rep, drop_ AS \"drop\" FROM drops", '"drop"')
def permutation_drops(spark, sf):
    return I.permutation_drops(docs_target(spark, sf), docs_tree(spark, sf), ["doc_id"], repeats=5)


@query("permutation_importance", f"""
    WITH {DT}, m AS (SELECT f AS feature, GREATEST(0, AVG(drop_)) AS raw FROM drops GROUP BY f), s AS (SELECT feature, raw / SUM(raw) OVER () AS importance FROM m)
    SELECT feature, importance, CAST(row_number() OVER w AS INT) AS place, SUM(importance) OVER w AS cumulative FROM s WHERE importance > 0
    WINDOW w AS (ORDER BY ROUND(importance, 12) DESC, feature ROWS UNBOUNDED PRECEDING)""", "importance cumulative")
def permutation_importance(spark, sf):
    return I.permutation_importance(docs_target(spark, sf), docs_tree(spark, sf), ["doc_id"], repeats=5)


@query("interactions", f"""
    WITH {DT}, b AS (SELECT a.rep, (SELECT acc FROM base) - AVG((d.y = g.guess)::INT) AS both_ FROM d JOIN sh a ON a.f = 'n_chars' JOIN sh l ON l.f = 'lang' AND l.rep = a.rep
      JOIN d o ON o.i = (d.i + a.s) % d.n JOIN d w ON w.i = (d.i + l.s) % d.n
      JOIN g ON g.leaf = CASE WHEN o.n_chars <= 2000 THEN CASE WHEN w.lang IN ('en', 'fr') THEN 3 ELSE 4 END ELSE 2 END GROUP BY a.rep),
    v AS (SELECT AVG(both_) - (SELECT AVG(drop_) FROM drops WHERE f = 'n_chars') - (SELECT AVG(drop_) FROM drops WHERE f = 'lang') AS v FROM b)
    SELECT 'n_chars' AS a, 'lang' AS b, v AS interaction FROM v WHERE ABS(v) > 0.001 AND (SELECT MIN(m) FROM (SELECT AVG(drop_) AS m FROM drops GROUP BY f)) > 0""", "interaction")
def interactions(spark, sf):
    return I.interactions(docs_target(spark, sf), docs_tree(spark, sf), ["doc_id"], ["n_chars", "lang"], repeats=5)


# --- recipes and streams -------------------------------------------------

STEPS = [
    ("filter", {"conditions": [("l_quantity", "is_not_null"), ("l_discount", ">", 0.01)]}),
    ("fill_median", {"cols": ["l_linenumber"]}),
    ("ratio", {"name": "tax_per_discount", "a": "l_tax", "b": "l_discount"}),
    ("flag", {"name": "bulk", "column": "l_quantity", "op": ">=", "value": 30}),
    ("bin_custom", {"col": "l_quantity", "edges": [0, 10, 30, 45], "name": "q_bin"}),
    ("filter", {"conditions": [("bulk", "=", 1), ("l_returnflag", "=", "A", "or")]}),
]
FIRST = f"(SELECT * FROM {CREDIT_NULL} WHERE l_quantity IS NOT NULL AND l_discount > 0.01)"


@query("recipe", f"""
    SELECT l_orderkey, l_partkey, l_suppkey, COALESCE(l_linenumber::DOUBLE, (SELECT median(l_linenumber) FROM {FIRST})) AS l_linenumber, l_tax / l_discount AS tax_per_discount,
      (l_quantity >= 30)::INT AS bulk, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 1 ELSE 2 END AS q_bin
    FROM {FIRST} WHERE l_quantity >= 30 OR l_returnflag = 'A'""", "l_linenumber tax_per_discount")
def recipe(spark, sf):
    return K.apply_recipe(credit_null(spark, sf), STEPS).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "tax_per_discount", "bulk", "q_bin")


@query("recipe_report", f"""
    WITH c AS (SELECT COUNT(*) AS a, COUNT(*) FILTER (l_quantity IS NOT NULL AND l_discount > 0.01) AS b,
                      COUNT(*) FILTER (l_quantity IS NOT NULL AND l_discount > 0.01 AND (l_quantity >= 30 OR l_returnflag = 'A')) AS d FROM {CREDIT_NULL})
    SELECT 1 AS step, 'filter' AS kind, a AS rows_before, b AS rows_after, a - b AS rows_removed, 12::BIGINT AS columns_after FROM c
    UNION ALL SELECT 2, 'fill_median', b, b, 0, 12 FROM c UNION ALL SELECT 3, 'ratio', b, b, 0, 13 FROM c UNION ALL SELECT 4, 'flag', b, b, 0, 14 FROM c
    UNION ALL SELECT 5, 'bin_custom', b, b, 0, 15 FROM c UNION ALL SELECT 6, 'filter', b, d, b - d, 15 FROM c""")
def recipe_report(spark, sf):
    return K.recipe_report(credit_null(spark, sf), STEPS)


@query("score_stream", f"""
    WITH {SCORED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, leaf_id, p, CAST(yh AS VARCHAR) AS prediction FROM s WHERE l_tax > 0.02""", "p")
def score_stream(spark, sf):
    """All of lineitem as a file stream: filtered, scored and appended to Parquet."""
    model = fixed_tree(spark, sf)
    out = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "lineitem").schema
    stream = ST.read_stream(spark, f"{sf}/lineitem*.parquet", schema)
    done = ST.score_stream(stream, model, [("l_tax", ">", 0.02)], CUT).select(*KEY, "leaf_id", "p", "prediction")
    ST.write_stream(done, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data")
