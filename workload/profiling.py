"""Profiles, correlations, feature selection, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import profiling as P
from workload.base import CREDIT, CREDIT_NULL, DOCS, credit, credit_null, docs, query, table


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

# value ranges decide the integer width; strings are counted
_INTS = {"o_orderkey": "bigint", "o_custkey": "bigint"}


@query("suggest_schema", union(
    [f"""SELECT '{c}' AS feature, 'bigint' AS current, CASE WHEN MIN({c}) >= -128 AND MAX({c}) <= 127 THEN 'tinyint'
         WHEN MIN({c}) >= -32768 AND MAX({c}) <= 32767 THEN 'smallint' WHEN MIN({c}) >= -2147483648 AND MAX({c}) <= 2147483647 THEN 'int'
         ELSE 'bigint' END AS suggested, 0::BIGINT AS nulls FROM orders""" for c in _INTS]
    + [f"""SELECT '{c}', 'string', CASE WHEN COUNT(DISTINCT {c}) <= LEAST(100, COUNT(*) / 10) THEN 'category' ELSE 'string' END, 0 FROM orders"""
       for c in ("o_orderstatus", "o_orderpriority")]
    + ["SELECT 'o_totalprice', 'double', CASE WHEN bool_or(o_totalprice <> floor(o_totalprice)) THEN 'float' ELSE 'int' END, 0 FROM orders",
       "SELECT 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 0"]))
def suggest_schema(spark, sf):
    return P.suggest_schema(table(spark, sf, "orders"))


@query("infer_string_types", union([
    f"""SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS levels, CASE WHEN COUNT({c}) > 0 AND COUNT({c}) = COUNT(try_cast({c} AS DOUBLE)) THEN 'numeric'
        WHEN COUNT(DISTINCT {c}) <= 2 AND bool_and(lower({c}) IN ('true', 'false', '1', '0', 'yes', 'no', 'y', 'n')) THEN 'boolean'
        WHEN COUNT(DISTINCT {c}) < 50 OR COUNT(DISTINCT {c}) < COUNT(*) * 0.05 THEN 'category' ELSE 'text' END AS inferred
        FROM (SELECT *, CAST(p_size AS VARCHAR) AS size_text, CASE WHEN p_size > 20 THEN 'Yes' ELSE 'no' END AS big, p_name || p_partkey AS label FROM part)"""
    for c in ("p_name", "p_brand", "size_text", "big", "label")]))
def infer_string_types(spark, sf):
    df = table(spark, sf, "part").withColumns({
        "size_text": F.col("p_size").cast("string"), "big": F.when(F.col("p_size") > 20, "Yes").otherwise("no"),
        "label": F.concat("p_name", F.col("p_partkey").cast("string"))})
    return P.infer_string_types(df, ["p_name", "p_brand", "size_text", "big", "label"])


@query("suggest_roles", """
    SELECT * FROM (VALUES ('event_id', 'integer'), ('ts', 'date'), ('user_id', 'integer'), ('value', 'float')) v(feature, role)
    UNION ALL SELECT 'event_type', CASE WHEN COUNT(DISTINCT event_type) < COUNT(*) * 0.5 THEN 'category' ELSE 'text' END FROM events
    UNION ALL SELECT 'props', CASE WHEN COUNT(DISTINCT props) < COUNT(*) * 0.5 THEN 'category' ELSE 'text' END FROM events
    UNION ALL SELECT 'day', 'date'""")
def suggest_roles(spark, sf):
    return P.suggest_roles(table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")))


def _summary(c: str, kind: str) -> str:
    text = f"CAST(MIN({c}) AS VARCHAR)"
    return f"""SELECT '{c}' AS feature, '{kind}' AS type, COUNT(*) - COUNT({c}) AS missing, (COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) AS missing_pct,
               COUNT(DISTINCT {c}) AS distinct_values, {text} AS example FROM {CREDIT_NULL}"""


@query("variable_summary", union([
    _summary(*p) for p in (("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_returnflag", "string"),
                           ("l_extendedprice", "double"))]), "missing_pct")
def variable_summary(spark, sf):
    return P.variable_summary(credit_null(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_extendedprice"))


@query("analyze_columns", union([
    f"""SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS distinct_values, COUNT(*) - COUNT({c}) AS nulls,
        CAST(MIN({c}) AS VARCHAR) AS min_value, CAST(MAX({c}) AS VARCHAR) AS max_value FROM part"""
    for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]))
def analyze_columns(spark, sf):
    return P.analyze_columns(table(spark, sf, "part"))


@query("dataset_summary", """
    WITH d AS (SELECT lang, source, CASE WHEN n_chars > 3000 THEN NULL ELSE n_chars // 1000 END AS k FROM documents),
    g AS (SELECT COUNT(*) AS c FROM d GROUP BY lang, source, k)
    SELECT SUM(c)::BIGINT AS rows, 3::BIGINT AS columns, SUM(c - 1)::BIGINT AS duplicate_rows, SUM(c - 1) * 100.0::DOUBLE / SUM(c) AS duplicate_pct,
           (SELECT COUNT(*) FROM d WHERE k IS NULL) AS missing_cells,
           (SELECT COUNT(*) FROM d WHERE k IS NULL) * 100.0::DOUBLE / (SUM(c) * 3) AS missing_pct FROM g""", "duplicate_pct missing_pct")
def dataset_summary(spark, sf):
    return P.dataset_summary(table(spark, sf, "documents").select(
        "lang", "source", F.when(F.col("n_chars") <= 3000, F.floor(F.col("n_chars") / 1000)).alias("k")))


@query("describe_numeric", union([
    f"""SELECT '{c}' AS feature, COUNT({c}) AS n, AVG({c}) AS mean, stddev_samp({c}) AS std, MIN({c})::DOUBLE AS min,
        quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, MAX({c})::DOUBLE AS max FROM {CREDIT_NULL}"""
    for c in (*NUM, "l_linenumber")]), "mean std min q25 q50 q75 max", digits=7)
def describe_numeric(spark, sf):
    return P.describe_numeric(credit_null(spark, sf), [*NUM, "l_linenumber"])


MOMENTS = ("(SELECT AVG({c}) AS m, AVG({c} * {c}) - AVG({c}) * AVG({c}) AS v FROM {t})")


def skew(c: str, t: str) -> str:
    """Population skewness from centred moments."""
    return f"(SELECT AVG(power({c} - m, 3)) / power(AVG(power({c} - m, 2)), 1.5) FROM {t}, (SELECT AVG({c}) AS m FROM {t}))"


def _profile(c: str, t: str) -> str:
    return f"""
    SELECT feature, n, missing_pct, distinct_values, min, max, mean, std, has_decimals, distinct_values = 2 AS is_binary, sk AS skew,
      CASE WHEN ABS(sk) < 0.5 THEN 'normal' WHEN ABS(sk) < 1 THEN 'moderately_skewed' ELSE 'highly_skewed' END AS skew_class,
      outliers > 0 AS has_outliers,
      CASE WHEN n < 2 OR distinct_values <= 2 THEN 2 ELSE CAST(GREATEST(2, LEAST(20, distinct_values,
        CASE WHEN ABS(sk) > 2 THEN GREATEST(ceil(log2(n) + 1), CASE WHEN iqr > 0 THEN ceil((max - min) / (2 * iqr / cbrt(n))) ELSE ceil(sqrt(n)) END)
             WHEN distinct_values < 10 THEN LEAST(distinct_values, 5) WHEN n < 100 THEN LEAST(ceil(log2(n) + 1), 5)
             WHEN n > 1000 THEN LEAST(ceil((max - min) / (3.5::DOUBLE * std / cbrt(n))), 15) ELSE LEAST(ceil(sqrt(n)), 10) END)) AS INT) END AS suggested_bins
    FROM (SELECT '{c}' AS feature, COUNT({c}) AS n, (COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) AS missing_pct, COUNT(DISTINCT {c}) AS distinct_values,
            MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max, AVG({c}) AS mean, stddev_samp({c}) AS std, bool_or({c} <> floor({c})) AS has_decimals,
            {skew(c, t)} AS sk, MAX(iqr) AS iqr, COUNT(*) FILTER ({c} < q1 - 1.5 * iqr OR {c} > q3 + 1.5 * iqr) AS outliers
          FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {t}))"""


@query("feature_profile", union([_profile(c, "lineitem") for c in (*NUM, "l_linenumber")]), "missing_pct min max mean std skew", digits=7)
def feature_profile(spark, sf):
    return P.feature_profile(table(spark, sf, "lineitem"), [*NUM, "l_linenumber"])


@query("feature_profile_events", _profile("value", "events"), "missing_pct min max mean std skew")
def feature_profile_events(spark, sf):
    return P.feature_profile(table(spark, sf, "events"), ["value"])


@query("skew_class_loose", union([
    f"SELECT '{c}' AS feature, CASE WHEN ABS(s) > 2 THEN 'highly_skewed' WHEN ABS(s) > 1 THEN 'moderately_skewed' ELSE 'normal' END AS skew_class "
    f"FROM (SELECT {skew(c, t)} AS s)" for c, t in (("n_chars", "documents"), ("doc_id", "documents"))]))
def skew_class_loose(spark, sf):
    df = table(spark, sf, "documents")
    return P.long_stats(df, {c: {"s": F.skewness(c)} for c in ("n_chars", "doc_id")}).select(
        "feature", P.skew_class(F.col("s"), "loose").alias("skew_class"))


@query("outlier_summary", union([
    f"""SELECT '{c}' AS feature, MAX(q1 - 1.5 * (q3 - q1)) AS low, MAX(q3 + 1.5 * (q3 - q1)) AS high,
        COUNT(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
        COUNT(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / COUNT({c}) AS outlier_pct
        FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})"""
    for c, t in (("value", "events"), ("user_id", "events"))]), "low high outlier_pct")
def outlier_summary(spark, sf):
    return P.outlier_summary(table(spark, sf, "events"), ["value", "user_id"])


@query("suggest_bin_count_median", union([
    f"""SELECT '{c}' AS feature, CAST(GREATEST(3, LEAST(20, median(v))) AS INT) AS suggested_bins FROM (
        SELECT unnest([ceil(log2(COUNT({c})) + 1), ceil(sqrt(COUNT({c}))), ceil(2 * power(COUNT({c}), 1.0::DOUBLE / 3))]) AS v FROM {t})"""
    for c, t in (("l_quantity", "lineitem"), ("l_tax", "lineitem"))]))
def suggest_bin_count_median(spark, sf):
    return P.suggest_bin_count(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], variant="median")


def _freq(c: str, t: str) -> str:
    return f"""
    SELECT '{c}' AS feature, COUNT(*) AS categories, MAX(n) * 100.0::DOUBLE / SUM(n) AS most_frequent_pct, MIN(n) * 100.0::DOUBLE / SUM(n) AS least_frequent_pct,
      MAX(n)::DOUBLE / MIN(n) AS imbalance_ratio, COUNT(*) > 1 AND MAX(n)::DOUBLE / MIN(n) < 5 AS is_balanced,
      -SUM(n::DOUBLE / total * log2(n::DOUBLE / total)) AS entropy, SUM(n) FILTER (r <= 3)::DOUBLE / SUM(n) AS top3_share,
      COUNT(*) FILTER (n::DOUBLE / total > 0.05)::DOUBLE / COUNT(*) AS uniformity
    FROM (SELECT n, SUM(n) OVER () AS total, row_number() OVER (ORDER BY n DESC) AS r FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY {c}))"""


@query("frequency_profile", union([_freq("p_brand", "part"), _freq("p_type", "part"), _freq("p_name", "part")]),
       "most_frequent_pct least_frequent_pct imbalance_ratio entropy top3_share uniformity")
def frequency_profile(spark, sf):
    return P.frequency_profile(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@query("category_profile", union([
    f"""SELECT '{c}' AS feature, COUNT(*) AS categories, COUNT(*) = 2 AS is_binary, COUNT(*) > 50 AS is_high_cardinality,
        CASE WHEN COUNT(*) <= 2 THEN 'binary' WHEN COUNT(*) <= 10 THEN 'low' WHEN COUNT(*) <= 50 THEN 'medium' WHEN COUNT(*) <= 100 THEN 'high' ELSE 'very_high' END AS cardinality,
        CAST(CASE WHEN COUNT(*) <= 5 THEN COUNT(*) WHEN COUNT(*) <= 20 THEN LEAST(5, COUNT(*) // 2) ELSE LEAST(10, COUNT(*) // 5) END AS INT) AS suggested_bins,
        COUNT(*) FILTER (n < (SELECT COUNT(*) FROM part) * 0.01::DOUBLE) AS rare_categories, 0.0::DOUBLE AS missing_pct
        FROM (SELECT {c}, COUNT(*) AS n FROM part GROUP BY {c})""" for c in ("p_brand", "p_type", "p_name")]), "missing_pct")
def category_profile(spark, sf):
    return P.category_profile(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@query("top_categories", union([
    f"""SELECT * FROM (SELECT '{c}' AS feature, {c} AS value, COUNT(*) AS n, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, {c}) AS INT) AS place
        FROM part GROUP BY {c}) WHERE place <= 10""" for c in ("p_brand", "p_name")]))
def top_categories(spark, sf):
    return P.top_categories(table(spark, sf, "part"), ["p_brand", "p_name"])


SUB = "(SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20)"


@query("subset_profile_numeric", union([
    f"""SELECT '{c}' AS feature, COUNT({c}) AS n, AVG({c}) AS mean, quantile_cont({c}, 0.5) AS q50, {skew(c, SUB)} AS skew,
        COUNT(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, COUNT(*) - COUNT({c}) AS missing
        FROM {SUB}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {SUB})""" for c in ("l_quantity", "l_extendedprice")]),
       "mean q50 skew")
def subset_profile_numeric(spark, sf):
    out = P.subset_profile(table(spark, sf, "lineitem"), "l_returnflag = 'R' AND l_quantity > 20", ["l_quantity", "l_extendedprice"])
    return out["numeric"].select("feature", "n", "mean", "q50", "skew", "outliers", "missing")


@query("subset_profile_top", f"""
    SELECT * FROM (SELECT 'l_linestatus' AS feature, l_linestatus AS value, COUNT(*) AS n,
      CAST(row_number() OVER (ORDER BY COUNT(*) DESC, l_linestatus) AS INT) AS place FROM {SUB} GROUP BY l_linestatus) WHERE place <= 5""")
def subset_profile_top(spark, sf):
    return P.subset_profile(table(spark, sf, "lineitem"), "l_returnflag = 'R' AND l_quantity > 20", ["l_linestatus"])["top"]


@query("quality_scores", union([
    f"""SELECT '{c}' AS feature, COUNT({c})::DOUBLE / COUNT(*) AS completeness, COUNT(DISTINCT {c})::DOUBLE / COUNT(*) AS uniqueness,
        1 - COUNT(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1))::DOUBLE / COUNT({c}) AS in_range
        FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events)""" for c in ("value", "user_id")]
    + ["SELECT 'event_type', COUNT(event_type)::DOUBLE / COUNT(*), COUNT(DISTINCT event_type)::DOUBLE / COUNT(*), NULL FROM events"]),
       "completeness uniqueness in_range")
def quality_scores(spark, sf):
    return P.quality_scores(table(spark, sf, "events"), ["value", "user_id", "event_type"])


PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]


@query("correlations", union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, ABS(corr({a}, {b})) > 0.7 AS is_high FROM lineitem" for a, b in PAIRS]), "r")
def correlations(spark, sf):
    return P.correlations(table(spark, sf, "lineitem"), NUM)


@query("correlation_summary", f"""
    SELECT MAX(r) AS max_abs_r, AVG(r) AS mean_abs_r, COUNT(*) FILTER (r > 0.7) AS high_pairs
    FROM ({union([f"SELECT ABS(corr({a}, {b})) AS r FROM lineitem" for a, b in PAIRS])})""", "max_abs_r mean_abs_r")
def correlation_summary(spark, sf):
    return P.correlation_summary(table(spark, sf, "lineitem"), NUM)


@query("target_correlations", f"""
    SELECT feature, abs_r, CAST(row_number() OVER (ORDER BY abs_r DESC, feature) AS INT) AS place
    FROM ({union([f"SELECT '{c}' AS feature, ABS(corr({c}, y)) AS abs_r FROM {CREDIT}" for c in NUM])})""", "abs_r")
def target_correlations(spark, sf):
    return P.target_correlations(credit(spark, sf), "y", NUM)


@query("variance_relevance", f"""
    SELECT feature, variance, explained, (variance / MAX(variance) OVER () + explained) / 2 AS relevance FROM ({union([
    f"SELECT '{c}' AS feature, (SELECT var_samp({c}) FROM lineitem) AS variance, ROUND(1 - AVG(v) / (SELECT var_samp({c}) FROM lineitem), 4) + 0.0::DOUBLE AS explained "
    f"FROM (SELECT var_samp({c}) AS v FROM lineitem GROUP BY l_returnflag)" for c in NUM])})""", "variance explained relevance", digits=4)
def variance_relevance(spark, sf):
    return P.variance_relevance(table(spark, sf, "lineitem"), "l_returnflag", NUM)


SCORES = f"""(SELECT feature, raw / MAX(raw) OVER () AS score FROM ({union([
    f"SELECT '{c}' AS feature, ABS(corr({c}, y)) AS raw FROM {CREDIT}" for c in (*NUM, 'l_linenumber')]
    + ["SELECT 'l_linestatus', 0.0::DOUBLE"])}))"""


def _scores(spark, sf):
    return P.screen_features(credit(spark, sf).select(*NUM, "l_linenumber", "l_linestatus", "y"), "y")


@query("screen_features", f"SELECT * FROM {SCORES}", "score")
def screen_features(spark, sf):
    return _scores(spark, sf)


@query("screen_features_variance", f"""
    SELECT feature, raw / MAX(raw) OVER () AS score FROM ({union([f"SELECT '{c}' AS feature, var_samp({c}) AS raw FROM lineitem" for c in NUM])})""", "score")
def screen_features_variance(spark, sf):
    return P.screen_features(table(spark, sf, "lineitem").select(*NUM))


RANKED = f"(SELECT feature, score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INT) AS place FROM {SCORES})"


@query("select_features_top_n", f"SELECT * FROM {RANKED} WHERE place <= 3", "score")
def select_features_top_n(spark, sf):
    return P.select_features(_scores(spark, sf), "top_n", 3)


@query("select_features_min_score", f"SELECT * FROM {RANKED} WHERE score >= 0.5", "score")
def select_features_min_score(spark, sf):
    return P.select_features(_scores(spark, sf), "min_score", 0.5)


@query("select_features_top_pct", f"SELECT * FROM {RANKED} WHERE place <= floor(0.5 * 6)", "score")
def select_features_top_pct(spark, sf):
    return P.select_features(_scores(spark, sf), "top_pct", 50)


@query("select_features_cumulative", f"""
    SELECT feature, score, place FROM (SELECT *, (SUM(score) OVER (ORDER BY place) - score) / SUM(score) OVER () AS b FROM {RANKED})
    WHERE b < 0.8 OR place = 1""", "score")
def select_features_cumulative(spark, sf):
    return P.select_features(_scores(spark, sf), "cumulative", 0.8)


@query("exclude_features", f"""
    SELECT feature, kind, abs_r, variance, missing_share, kind IN ('numeric', 'datetime') AND COALESCE(variance >= 1, TRUE) AND missing_share <= 0.12 AS keep
    FROM ({union([f"SELECT '{c}' AS feature, 'numeric' AS kind, ABS(corr({c}, y)) AS abs_r, var_samp({c}) AS variance, 1 - COUNT({c})::DOUBLE / COUNT(*) AS missing_share FROM {CREDIT_NULL}"
                  for c in (*NUM, 'l_linenumber')]
                 + [f"SELECT '{c}', '{k}', NULL, NULL, 0.0 FROM (SELECT 1)" for c, k in (('l_linestatus', 'categorical'), ('l_shipdate', 'datetime'))])})""",
       "abs_r variance missing_share", digits=4)
def exclude_features(spark, sf):
    df = credit_null(spark, sf).select(*NUM, "l_linenumber", "l_linestatus", "l_shipdate", "y")
    return P.exclude_features(df, "y", ("numeric", "datetime"), min_variance=1.0, max_missing=0.12)


@query("binary_columns", union([
    f"SELECT feature, null_pct FROM (SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS k, (COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) AS null_pct FROM {DOCS}) WHERE k = 2 AND null_pct <= 20"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")]), "null_pct")
def binary_columns(spark, sf):
    return P.binary_columns(docs(spark, sf))


@query("potential_targets", union([
    f"SELECT * FROM (SELECT '{c}' AS feature, COUNT(DISTINCT {c}) AS levels FROM {DOCS}) WHERE levels <= 10"
    for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")]))
def potential_targets(spark, sf):
    return P.potential_targets(docs(spark, sf))


@query("target_profile", """
    WITH c AS (SELECT l_returnflag AS class, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER () AS s FROM lineitem GROUP BY 1)
    SELECT class, n, s * 100 AS pct, row_number() OVER (ORDER BY n DESC, class) = 1 AS is_majority,
           (SELECT 1 - SUM(s * s) FROM c) AS gini, (SELECT -SUM(s * log2(s)) FROM c) AS entropy FROM c""", "pct gini entropy")
def target_profile(spark, sf):
    return P.target_profile(table(spark, sf, "lineitem"), "l_returnflag")


@query("numeric_target_profile", """
    SELECT COUNT(o_totalprice) AS n, AVG(o_totalprice) AS mean, median(o_totalprice) AS median, stddev_samp(o_totalprice) AS std,
           var_samp(o_totalprice) AS variance, MAX(o_totalprice) - MIN(o_totalprice) AS range FROM orders""", "mean median std range variance", digits=3)
def numeric_target_profile(spark, sf):
    return P.numeric_target_profile(table(spark, sf, "orders"), "o_totalprice")


@query("validate_target", f"""
    WITH c AS (SELECT toxic, COUNT(*) AS n FROM {DOCS} GROUP BY 1), r AS (SELECT MIN(n)::DOUBLE / MAX(n) AS r, COUNT(*) AS k FROM c)
    SELECT k AS levels, 0::BIGINT AS nulls, k = 2 AS is_valid, CASE WHEN k = 2 THEN r END AS imbalance,
           CASE WHEN k <> 2 THEN NULL WHEN r < 0.1 THEN 'severe' WHEN r < 0.3 THEN 'moderate' ELSE 'ok' END AS balance,
           CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM r""", "imbalance confidence")
def validate_target(spark, sf):
    return P.validate_target(docs(spark, sf), "toxic")


@query("validate_target_multiclass", """
    SELECT COUNT(DISTINCT event_type) AS levels, 0::BIGINT AS nulls, FALSE AS is_valid, NULL::DOUBLE AS imbalance, NULL::VARCHAR AS balance,
           GREATEST(0, 1 - (COUNT(DISTINCT event_type) - 2) * 0.2)::DOUBLE AS confidence FROM events""", "confidence")
def validate_target_multiclass(spark, sf):
    return P.validate_target(table(spark, sf, "events"), "event_type")


@query("suggest_target_thresholds", """
    WITH t AS (SELECT 'median' AS kind, median(value) AS threshold FROM events UNION ALL SELECT 'mean', AVG(value) FROM events
               UNION ALL SELECT 'q3', quantile_cont(value, 0.75) FROM events
               UNION ALL SELECT 'round', c FROM (SELECT unnest([10.0::DOUBLE, 50, 100, 500, 1000]) AS c), (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events)
                         WHERE hi - lo > 10 AND c > lo AND c < hi),
    b AS (SELECT kind, threshold, (SELECT COUNT(*) FROM events WHERE value <= threshold) AS below, (SELECT COUNT(*) FROM events WHERE value > threshold) AS above FROM t)
    SELECT kind, threshold, below, above, balance FROM (
      SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ABS(balance - 0.5), threshold) AS p
      FROM (SELECT *, LEAST(below, above)::DOUBLE / GREATEST(below, above) AS balance FROM b)) WHERE p <= 3 OR kind <> 'round'""", "threshold balance")
def suggest_target_thresholds(spark, sf):
    return P.suggest_target_thresholds(table(spark, sf, "events"), "value")


@query("binarize_target", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS target FROM events")
def binarize_target(spark, sf):
    return P.binarize_target(table(spark, sf, "events"), "event_type", {"purchase": 1, "click": 1, "view": 0}).select("event_id", "target")
