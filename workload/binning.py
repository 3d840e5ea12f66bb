"""Supervised binning and category grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.operators import binning as B
from timberline.operators import grouping as G
from workload.base import CREDIT, CREDIT_NULL, PARTS, credit, credit_null, parts, query, table

import pyarrow as pa


def edges_frame(spark, edges):
    return local_table(spark, [{"i": i, "edge": e} for i, e in enumerate(edges)], pa.schema([("i", pa.int32()), ("edge", pa.float64())]))


def listed(sql: str) -> str:
    """SQL for one list ``e`` of edges → rows (i, edge)."""
    return f"SELECT CAST(unnest(range(len(e))) AS INT) AS i, unnest(e) AS edge FROM ({sql})"


@query("edges_equal_width", listed("SELECT [MIN(l_extendedprice) + (MAX(l_extendedprice) - MIN(l_extendedprice)) * k / 6.0::DOUBLE FOR k IN range(7)] AS e FROM lineitem"
                                   .replace("[MIN(l_extendedprice) + (MAX(l_extendedprice) - MIN(l_extendedprice)) * k / 6.0::DOUBLE FOR k IN range(7)]",
                                            "list_transform(range(7), lambda k: lo + (hi - lo) * k / 6.0::DOUBLE)")
                                   .replace("FROM lineitem", "FROM (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem)")), "edge")
def edges_equal_width(spark, sf):
    return edges_frame(spark, B.edges_equal_width(table(spark, sf, "lineitem"), "l_extendedprice", 6))


@query("edges_equal_freq", listed("SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS e FROM lineitem"), "edge")
def edges_equal_freq(spark, sf):
    return edges_frame(spark, B.edges_equal_freq(table(spark, sf, "lineitem"), "l_quantity", 8))


@query("edges_quantile_preset", listed("SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.0, 0.33, 0.67, 1.0]))) AS e FROM orders"), "edge")
def edges_quantile_preset(spark, sf):
    return edges_frame(spark, B.edges_quantile(table(spark, sf, "orders"), "o_totalprice", 3))


@query("edges_outlier", listed("""
    SELECT list_sort(list_distinct(list_filter([lo, CASE WHEN a > lo AND a < hi THEN a END, CASE WHEN b > lo AND b < hi THEN b END, hi], lambda x: x IS NOT NULL))) AS e
    FROM (SELECT lo, hi, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM
      (SELECT MIN(value) AS lo, MAX(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""), "edge")
def edges_outlier(spark, sf):
    return edges_frame(spark, B.edges_outlier(table(spark, sf, "events"), "value"))


@query("validate_bins", """
    SELECT FALSE AS valid, 'gap,range_not_covered' AS problems, MIN(l_quantity) AS data_min, MAX(l_quantity) AS data_max FROM lineitem""")
def validate_bins(spark, sf):
    return B.validate_bins(table(spark, sf, "lineitem"), "l_quantity", [(1.0, 10.0), (10.0, 20.0), (21.0, 40.0)])


EDGES = [1.0, 8.0, 16.0, 30.0, 45.0, 60.0]


def bin_case(c: str, edges=EDGES) -> str:
    parts_ = [f"WHEN {c} < {edges[0]} OR {c} > {edges[-1]} THEN -1"]
    parts_ += [f"WHEN {c} < {e} THEN {i}" for i, e in enumerate(edges[1:-1])]
    return f"CASE {' '.join(parts_)} WHEN {c} IS NOT NULL THEN {len(edges) - 2} END"


GINI = "1 - (power(p, 2) + power(n - p, 2)) / power(n, 2)"


@query("bin_stats", f"""
    WITH r AS (SELECT {bin_case('l_quantity')} AS b, y FROM {CREDIT_NULL}),
    k AS (SELECT b, COUNT(*) AS n FROM r WHERE b IS NOT NULL GROUP BY b),
    big AS (SELECT b FROM k ORDER BY n DESC, b LIMIT 1),
    f AS (SELECT COALESCE(b, (SELECT b FROM big)) AS b, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p FROM r GROUP BY 1),
    e AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS bin, unnest([1.0, 8, 16, 30, 45]::DOUBLE[]) AS lower, unnest([8.0, 16, 30, 45, 60]::DOUBLE[]) AS upper)
    SELECT bin, lower, upper, COALESCE(n, 0)::BIGINT AS n, COALESCE(n, 0) * 100.0 / (SELECT SUM(n) FROM f) AS pct, p / n AS mean_target,
           COALESCE({GINI}, 0) AS gini, COALESCE(p, 0)::BIGINT AS positives FROM e LEFT JOIN f ON e.bin = f.b""", "pct mean_target gini")
def bin_stats(spark, sf):
    t = B.bin_stats(credit_null(spark, sf), "l_quantity", EDGES, "y")
    return t.select("bin", "lower", "upper", "n", "pct", "mean_target", "gini", F.element_at("class_counts", F.lit("1")).alias("positives"))


@query("category_stats", """
    WITH c AS (SELECT p_brand AS category, y, COUNT(*) AS k FROM """ + PARTS + """ GROUP BY ALL)
    SELECT category, SUM(k)::BIGINT AS n, SUM(k * y)::DOUBLE / SUM(k) AS mean_target, 1 - SUM(k * k)::DOUBLE / power(SUM(k), 2) AS gini FROM c GROUP BY 1""",
       "mean_target gini")
def category_stats(spark, sf):
    return B.category_stats(parts(spark, sf), "p_brand", "y").drop("class_counts")


@query("merge_small_bins", listed("SELECT [1.0, 8.0, 30.0, 60.0]::DOUBLE[] AS e FROM (SELECT COUNT(*) FROM lineitem)"))
def merge_small_bins(spark, sf):
    """Quantity bins below 12 % join their right neighbour, the last its left."""
    edges = [1.0, 3.0, 8.0, 10.0, 30.0, 59.0, 60.0]
    return edges_frame(spark, B.merge_small_bins(credit(spark, sf), "l_quantity", edges, "y", min_share=0.12))


def quality_sql(edges=EDGES, crit="gini", source=CREDIT, col="l_quantity") -> str:
    """Every value of ``b`` is a group: the bins, -1 outside the edges, NULL."""
    g = {"gini": "1 - (power(p / n, 2) + power(1 - p / n, 2))",
         "entropy": "-(CASE WHEN p > 0 THEN p / n * log2(p / n) ELSE 0 END + CASE WHEN p < n THEN (1 - p / n) * log2(1 - p / n) ELSE 0 END)",
         "log_loss": "-(CASE WHEN p > 0 THEN p / n * ln(p / n) ELSE 0 END + CASE WHEN p < n THEN (1 - p / n) * ln(1 - p / n) ELSE 0 END)"}[crit]
    k = len(edges) - 1
    return f"""(
    WITH r AS (SELECT {bin_case(col, edges)} AS b, y FROM {source}),
    f AS (SELECT b, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p FROM r GROUP BY 1),
    a AS (SELECT SUM(n) AS n, SUM(p) AS p FROM f), w AS (SELECT n AS total, {g} AS before, (SELECT SUM(n * ({g})) FROM f) / n AS after FROM a),
    e AS (SELECT unnest(range({k})) AS bin),
    i AS (SELECT bin, COALESCE(n, 0) AS n, CASE WHEN n > 0 THEN 1 - ({g}) ELSE 0 END AS purity FROM e LEFT JOIN f ON e.bin = f.b)
    SELECT before AS impurity_before, after AS impurity_after, before - after AS impurity_decrease,
           (before - after) / before AS gain_ratio, COUNT(*) AS n_bins, SUM(n) AS binned, AVG(purity) FILTER (n > 0) AS mean_purity, MIN(purity) FILTER (n > 0) AS least_purity, COUNT(*) FILTER (n = 0) AS empty_bins,
           COUNT(*) FILTER (n > 0 AND n < floor(total / 20)) AS small_bins, MAX(n) AS hi, MIN(n) FILTER (n > 0) AS lo, total
    FROM i, w GROUP BY before, after, total)"""


QCOLS = "impurity_before, impurity_after, impurity_decrease, gain_ratio, n_bins, empty_bins, small_bins"
QFLOATS = "impurity_before impurity_after impurity_decrease gain_ratio"

for _crit in ("gini", "entropy", "log_loss"):
    @query(f"bin_split_quality_{_crit}", f"SELECT {QCOLS} FROM {quality_sql(crit=_crit)}", QFLOATS, digits=9)
    def bin_split_quality(spark, sf, crit=_crit):
        return B.bin_split_quality(credit(spark, sf), "l_quantity", EDGES, "y", crit)


@query("bin_split_quality_nulls", f"SELECT {QCOLS} FROM {quality_sql(source=CREDIT_NULL)}", QFLOATS, digits=9)
def bin_split_quality_nulls(spark, sf):
    """A quarter of the rows without a value: they are a group of their own, not a pure one."""
    return B.bin_split_quality(credit_null(spark, sf), "l_quantity", EDGES, "y")


NULL_RATIO = f"SELECT ABS(gain_ratio) < 0.02 AS no_gain FROM {quality_sql(source=CREDIT_NULL, col='l_linenumber', edges=[1.0, 2.0, 5.0, 7.0])}"


@query("bin_split_quality_unrelated_nulls", NULL_RATIO)
def bin_split_quality_unrelated_nulls(spark, sf):
    """The line number has nothing to do with the target; its NULLs must not change that."""
    q = B.bin_split_quality(credit_null(spark, sf), "l_linenumber", [1.0, 2.0, 5.0, 7.0], "y")
    return q.select((F.abs("gain_ratio") < 0.02).alias("no_gain"))


RATING = """(SELECT *, (empty_bins > 0)::INT + (small_bins > 0)::INT + (impurity_decrease < 0.01)::INT + (gain_ratio < 0.1)::INT + (hi / lo > 10)::INT AS issues,
   (impurity_decrease >= 0.01)::INT + (gain_ratio > 0.3)::INT + (hi / lo < 3)::INT AS strengths FROM {q})"""
SCORED = """(SELECT *, GREATEST(0, LEAST(gain_ratio * 100, 50) - 10 * issues + 5 * strengths)::DOUBLE AS score FROM """ + RATING + ")"
LABEL = "CASE WHEN score >= 70 THEN 'excellent' WHEN score >= 50 THEN 'good' WHEN score >= 30 THEN 'fair' WHEN score >= 10 THEN 'poor' ELSE 'very_poor' END"


def named_sql(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + ")"


ISSUE_LIST = named_sql({"empty_bins": "empty_bins > 0", "small_bins": "small_bins > 0", "no_improvement": "impurity_decrease <= 0",
                        "tiny_improvement": "impurity_decrease > 0 AND impurity_decrease < 0.01", "low_gain_ratio": "gain_ratio < 0.1", "imbalanced_bins": "hi / lo > 10"})
STRENGTH_LIST = named_sql({"good_decrease": "impurity_decrease >= 0.01", "high_gain_ratio": "gain_ratio > 0.3", "balanced_bins": "hi / lo < 3"})


def rate_sql(source: str) -> str:
    return (f"SELECT score, {LABEL} AS label, issues::BIGINT AS issues, strengths::BIGINT AS strengths, {ISSUE_LIST} AS issue_list, {STRENGTH_LIST} AS strength_list "
            f"FROM {SCORED.format(q=quality_sql(source=source))}")


@query("rate_split", rate_sql(CREDIT), "score")
def rate_split(spark, sf):
    return B.rate_split(credit(spark, sf), "l_quantity", EDGES, "y")


@query("rate_split_nulls", rate_sql(CREDIT_NULL), "score")
def rate_split_nulls(spark, sf):
    return B.rate_split(credit_null(spark, sf), "l_quantity", EDGES, "y")


# a target that follows the price, so that ratings are not all poor
@query("rate_split_strong", """
    WITH r AS (SELECT CASE WHEN l_extendedprice < 40000 THEN 0 ELSE 1 END AS b, (l_extendedprice > 50000)::INT AS y FROM lineitem),
    f AS (SELECT b, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p FROM r GROUP BY b), w AS (SELECT SUM(n) AS n, SUM(p) AS p FROM f),
    q AS (SELECT 1 - power(w.p / w.n, 2) - power(1 - w.p / w.n, 2) AS before, (SELECT SUM(n * (1 - power(p / n, 2) - power(1 - p / n, 2))) / SUM(n) FROM f) AS after,
                 (SELECT MAX(n) / MIN(n) FROM f) AS spread FROM w),
    s AS (SELECT GREATEST(0, LEAST((before - after) / before * 100, 50) - 10 * ((before - after < 0.01)::INT + ((before - after) / before < 0.1)::INT + (spread > 10)::INT)
                 + 5 * ((before - after >= 0.01)::INT + ((before - after) / before > 0.3)::INT + (spread < 3)::INT))::DOUBLE AS score FROM q)
    SELECT score, """ + LABEL + " AS label FROM s", "score")
def rate_split_strong(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("y", (F.col("l_extendedprice") > 50000).cast("int"))
    lo, hi = df.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return B.rate_split(df, "l_extendedprice", [lo, 40000.0, hi], "y").select("score", "label")


@query("bin_importance", f"SELECT 'l_quantity' AS feature, impurity_decrease * 0.5 AS importance FROM {quality_sql()}", "importance", digits=9)
def bin_importance(spark, sf):
    df = credit(spark, sf)
    return B.bin_importance(df, "l_quantity", EDGES, "y", total_rows=2 * df.count())


@query("deviance_reduction", f"""
    SELECT 2 * total * impurity_before AS deviance_before, 2 * total * impurity_after AS deviance_after, 2 * total * impurity_decrease AS reduction,
           gain_ratio AS reduction_ratio FROM {quality_sql(crit='log_loss')}""", "deviance_before deviance_after reduction reduction_ratio")
def deviance_reduction(spark, sf):
    return B.deviance_reduction(credit(spark, sf), "l_quantity", EDGES, "y")


def optimal_sql() -> str:
    options = []
    for k in range(2, 7):
        probs = ", ".join(f"{i}::DOUBLE / {k}" for i in range(k + 1))
        options.append(f"""SELECT {k} AS k, list_sort(list_distinct(quantile_cont(l_extendedprice, [{probs}]))) AS e FROM lineitem""")
    return f"""
    WITH o AS ({' UNION ALL '.join(options)}),
    b AS (SELECT k, e, unnest(range(len(e) - 1)) AS i FROM o),
    c AS (SELECT k, e, i, COUNT(*)::DOUBLE AS n, SUM((l_linestatus = 'O')::INT)::DOUBLE AS p FROM b JOIN lineitem
          ON l_extendedprice >= e[i + 1] AND (l_extendedprice < e[i + 2] OR (i = len(e) - 2 AND l_extendedprice = e[i + 2])) GROUP BY ALL),
    t AS (SELECT COUNT(*)::DOUBLE AS n, SUM((l_linestatus = 'O')::INT)::DOUBLE AS p FROM lineitem),
    q AS (SELECT k, any_value(e) AS e, COUNT(*) AS n_bins, (SELECT 2 * p / n * (1 - p / n) FROM t) AS before,
                 SUM(c.n * 2 * c.p / c.n * (1 - c.p / c.n)) / SUM(c.n) AS after, MAX(n) / MIN(n) AS spread FROM c GROUP BY k),
    s AS (SELECT k, e, n_bins, GREATEST(0, LEAST((before - after) / before * 100, 50)
            - 10 * ((before - after < 0.01)::INT + ((before - after) / before < 0.1)::INT + (spread > 10)::INT)
            + 5 * ((before - after >= 0.01)::INT + ((before - after) / before > 0.3)::INT + (spread < 3)::INT))::DOUBLE AS score FROM q)
    SELECT k::BIGINT AS requested_bins, n_bins, score, unnest(e) AS edge FROM (SELECT * FROM s ORDER BY score DESC, k LIMIT 1)"""


@query("optimal_bins", optimal_sql(), "score edge")
def optimal_bins(spark, sf):
    return B.optimal_bins(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus", max_bins=6).select(
        "requested_bins", "n_bins", "score", F.explode("edges").alias("edge"))


def poisson_sql(u: str) -> str:
    import math
    edges, p, total = [], math.exp(-1.0), 0.0
    for k in range(12):
        total += p
        edges.append(round(total, 12))
        p /= k + 1
    return "(" + " + ".join(f"({u} >= {e!r}::DOUBLE)::INT" for e in edges) + ")"


def weight_sql(keys: str, r: str = "r") -> str:
    u = f"(('0x' || substr(md5(concat_ws('|', {keys}, '42', {r} // 4)), ({r} % 4) * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    return poisson_sql(u)


@query("bin_stability", f"""
    WITH r AS (SELECT {bin_case('value', [0.0, 2.0, 10.0, 30.0, 1000.0])} AS b, (event_type = 'purchase')::INT AS y, event_id FROM events),
    w AS (SELECT x.r AS rep, b, y, {weight_sql('event_id', 'x.r')} AS w FROM r, (SELECT unnest(range(20)) AS r) x),
    c AS (SELECT rep, b, SUM(w)::DOUBLE AS n, SUM(w * y)::DOUBLE AS p FROM w GROUP BY ALL),
    t AS (SELECT rep, SUM(n) AS tn, SUM(p) AS tp FROM c GROUP BY rep),
    q AS (SELECT rep, 1 - power(tp / tn, 2) - power(1 - tp / tn, 2) AS before,
                 SUM(CASE WHEN n > 0 THEN n / tn * (1 - power(p / n, 2) - power(1 - p / n, 2)) ELSE 0 END) AS after FROM c JOIN t USING (rep) GROUP BY rep, tn, tp)
    SELECT AVG((before - after) / before) AS mean_gain_ratio, stddev_pop((before - after) / before) AS gain_ratio_std, AVG(before - after) AS mean_impurity_decrease,
           stddev_pop(before - after) AS impurity_decrease_std, 1 / (1 + stddev_pop((before - after) / before)) AS stability_score FROM q""",
       "mean_gain_ratio gain_ratio_std mean_impurity_decrease impurity_decrease_std stability_score", digits=9)
def bin_stability(spark, sf):
    df = table(spark, sf, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return B.bin_stability(df, ["event_id"], "value", [0.0, 2.0, 10.0, 30.0, 1000.0], "y", n_boot=20)


@query("preview_split_bins", f"""
    WITH r AS (SELECT {bin_case('l_quantity')} AS b, y FROM {CREDIT}), t AS (SELECT COUNT(*)::DOUBLE AS total FROM r),
    f AS (SELECT b, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p FROM r WHERE b >= 0 GROUP BY 1),
    e AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS bin),
    i AS (SELECT bin, COALESCE(n, 0) AS n, total, COALESCE(1 - (power(p / n, 2) + power(1 - p / n, 2)), 0) AS impurity FROM e LEFT JOIN f ON e.bin = f.b, t),
    u AS (SELECT *, CASE WHEN n > 0 THEN 1 - impurity ELSE 0 END AS purity, n < floor(total / 20) AS is_small FROM i)
    SELECT bin, n::BIGINT AS n, n * 100 / total AS pct, impurity, purity,
           CASE WHEN n = 0 THEN 'empty' WHEN is_small THEN 'small' WHEN purity > 0.9 THEN 'pure' ELSE 'normal' END AS status,
           CASE WHEN n = 0 THEN 0 ELSE GREATEST(0, LEAST(100, 50 - CASE WHEN is_small THEN 20 ELSE 0 END
             + CASE WHEN purity > 0.7 THEN 20 WHEN purity > 0.5 THEN 10 WHEN purity < 0.1 THEN -15 ELSE 0 END
             + CASE WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5 ELSE 0 END)) END::DOUBLE AS bin_score FROM u""", "pct impurity purity bin_score")
def preview_split_bins(spark, sf):
    return B.preview_split(credit(spark, sf), "l_quantity", EDGES, "y")["bins"].drop("lower", "upper", "top_class")


WARNING_LIST = named_sql({"empty_bins": "empty_bins > 0", "no_improvement": "impurity_decrease <= 0", "bins_under_3_rows": "lo < 3", "very_low_gain": "gain_ratio < 0.05",
                          "one_bin_over_80_pct": "hi > 0.8 * binned", "all_bins_pure": "empty_bins = 0 AND least_purity > 0.95"})
ADVICE_LIST = named_sql({"remove_empty_bins": "empty_bins > 0", "merge_small_bins": "small_bins > 0", "try_other_feature": "gain_ratio < 0.1", "use_equal_frequency": "hi / lo > 10",
                         "ready_to_apply": "label IN ('good', 'excellent')", "acceptable": "label = 'fair'", "fewer_bins": "n_bins > floor(binned / 10)",
                         "strong_binary_split": "n_bins = 2 AND gain_ratio > 0.3 AND n_bins <= floor(binned / 10)"})


def summary_sql(source: str) -> str:
    return f"""
    SELECT 'l_quantity' AS feature, n_bins, n_bins - empty_bins AS n_filled, binned::BIGINT AS n, impurity_before, impurity_after, impurity_decrease, gain_ratio,
           score, label, impurity_decrease > 0 AS beneficial, mean_purity, lo::BIGINT AS min_bin, hi::BIGINT AS max_bin, {WARNING_LIST} AS warnings, {ADVICE_LIST} AS recommendations
    FROM (SELECT *, {LABEL} AS label FROM {SCORED.format(q=quality_sql(source=source))})"""


@query("preview_split_summary", summary_sql(CREDIT), QFLOATS + " score mean_purity")
def preview_split_summary(spark, sf):
    return B.preview_split(credit(spark, sf), "l_quantity", EDGES, "y")["summary"]


@query("preview_split_nulls", summary_sql(CREDIT_NULL), QFLOATS + " score mean_purity")
def preview_split_nulls(spark, sf):
    return B.preview_split(credit_null(spark, sf), "l_quantity", EDGES, "y")["summary"]


CONFIGS = {"two": [1.0, 25.0, 60.0], "three": [1.0, 15.0, 35.0, 60.0], "uneven": [1.0, 2.0, 60.0]}


@query("compare_splits", f"""
    SELECT name, score, gain_ratio, impurity_decrease, n_bins, empty_bins, label, balance,
           row_number() OVER (ORDER BY score DESC, o) = 1 AS best_score, row_number() OVER (ORDER BY gain_ratio DESC, o) = 1 AS best_gain,
           row_number() OVER (ORDER BY balance DESC, o) = 1 AS best_balance
    FROM ({' UNION ALL '.join(f"SELECT '{n}' AS name, {i} AS o, score, gain_ratio, impurity_decrease, n_bins, empty_bins, {LABEL} AS label, score - 5.0 * (n_bins - 2) AS balance FROM {SCORED.format(q=quality_sql(e))}" for i, (n, e) in enumerate(CONFIGS.items()))})""",
       "score gain_ratio impurity_decrease balance", digits=9)
def compare_splits(spark, sf):
    return B.compare_splits(credit(spark, sf), "l_quantity", CONFIGS, "y")


# --- grouping ------------------------------------------------------------

COUNTS = f"""
    c AS (SELECT p_brand AS category, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p FROM {PARTS} GROUP BY 1), t AS (SELECT SUM(n) AS tn, SUM(p) AS tp, COUNT(*) AS k FROM c)"""


def equal_groups(score: str, groups: int = 3, order: str = "score, category") -> str:
    return f"""WITH {COUNTS}, s AS (SELECT category, n::BIGINT AS n, {score} AS score, k FROM c, t)
    SELECT category, n, score, CAST(LEAST((row_number() OVER (ORDER BY {order}) - 1) // (k // {groups}), {groups} - 1) + 1 AS VARCHAR) AS grp FROM s"""


H = "ROUND(-(p / n * log2(p / n) + (1 - p / n) * log2(1 - p / n)), 12)"
CELL = "power(GREATEST(ABS({o} - {e}) - 0.5, 0), 2) / ({e})"
CHI = " + ".join(CELL.format(o=o, e=e) for o, e in (
    ("p", "n * tp / tn"), ("(n - p)", "n * (tn - tp) / tn"), ("(tp - p)", "(tn - n) * tp / tn"),
    ("(tn - tp - n + p)", "(tn - n) * (tn - tp) / tn")))


@query("group_categories_entropy", equal_groups(H), "score")
def group_entropy(spark, sf):
    return G.group_categories(parts(spark, sf), "p_brand", "y", "entropy")


@query("group_categories_chi_square", equal_groups(f"ROUND({CHI}, 9)"), "score")
def group_chi_square(spark, sf):
    return G.group_categories(parts(spark, sf), "p_brand", "y", "chi_square")


@query("group_categories_target_mean", equal_groups("p / n"), "score")
def group_target_mean(spark, sf):
    return G.group_categories(parts(spark, sf), "p_brand", "y", "target_mean")


@query("group_categories_target_class", """
    WITH c AS (SELECT p_brand AS category, p_type, COUNT(*) AS k FROM part GROUP BY ALL)
    SELECT category, SUM(k)::BIGINT AS n, MAX(k)::DOUBLE / SUM(k) AS score, 'Target_' || arg_min(p_type, (-k, p_type)) AS grp FROM c GROUP BY category""", "score")
def group_target_class(spark, sf):
    return G.group_categories(table(spark, sf, "part"), "p_brand", "p_type", "target_mean")


@query("group_categories_frequency_quartile", """
    WITH c AS (SELECT p_brand AS category, COUNT(*) AS n FROM part GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS lo, quantile_cont(n, 0.75) AS hi FROM c)
    SELECT category, n, n::DOUBLE AS score, CASE WHEN n >= hi THEN 'high' WHEN n >= lo THEN 'medium' ELSE 'low' END AS grp FROM c, q""")
def group_quartile(spark, sf):
    return G.group_categories(table(spark, sf, "part"), "p_brand", method="frequency_quartile")


@query("group_categories_simple", equal_groups("n", 5, "category"))
def group_simple(spark, sf):
    return G.group_categories(parts(spark, sf), "p_brand", method="simple")


def chunks(score: str, order: str, groups: int) -> str:
    return f"""WITH {COUNTS}, s AS (SELECT category, n::BIGINT AS n, {score} AS score, row_number() OVER (ORDER BY {order}) - 1 AS i,
      CASE WHEN k <= {groups} THEN 1 ELSE k // {groups} END AS size, k FROM c, t),
      g AS (SELECT *, i // size AS ch, CAST(ceil(k / size::DOUBLE) AS BIGINT) AS total FROM s)
    SELECT category, n, score, CAST(CASE WHEN total > {groups} AND ch = total - 1 THEN total - 2 ELSE ch END + 1 AS VARCHAR) AS grp FROM g"""


@query("group_categories_frequency", chunks("n", "n DESC, category", 4))
def group_frequency(spark, sf):
    return G.group_categories(parts(spark, sf), "p_brand", method="frequency", max_groups=4)


@query("group_categories_target_rate", chunks("p / n", "p / n, category", 6), "score")
def group_target_rate(spark, sf):
    return G.group_categories(parts(spark, sf), "p_brand", "y", "target_rate", max_groups=6)
