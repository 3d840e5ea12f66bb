"""Derived columns, scaling, encodings, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import scalar as S
from timberline.operators import transforms as T
from workload.base import CREDIT_NULL, credit_null, query, table

LI = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def li(spark, sf, *extra):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *extra)


@query("formula_column", f"SELECT {LI}, l_extendedprice * (1 - l_discount) * (1 + l_tax) + power(l_quantity, 2) AS v FROM lineitem", "v")
def formula_column(spark, sf):
    df = table(spark, sf, "lineitem")
    return S.formula_column(df, "l_extendedprice * (1 - l_discount) * (1 + l_tax) + power(l_quantity, 2)", "v").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "v")


@query("formula_functions", f"""
    SELECT {LI}, log10(l_extendedprice) + ln(l_quantity) + sqrt(l_quantity) AS a, exp(l_tax) + sin(l_discount) + cos(l_tax) + tan(l_tax) AS b,
           least(l_quantity, 30.0) + greatest(l_discount, l_tax) AS c, (l_quantity + l_discount + l_tax) / 3 AS m,
           floor(l_extendedprice / 7) + ceil(l_quantity / 3) AS f FROM lineitem""", "a b c m f")
def formula_functions(spark, sf):
    df = table(spark, sf, "lineitem")
    for sql, name in (("log10(l_extendedprice) + ln(l_quantity) + sqrt(l_quantity)", "a"),
                      ("exp(l_tax) + sin(l_discount) + cos(l_tax) + tan(l_tax)", "b"),
                      ("least(l_quantity, 30D) + greatest(l_discount, l_tax)", "c"),
                      ("floor(l_extendedprice / 7) + ceil(l_quantity / 3)", "f")):
        df = S.formula_column(df, sql, name)
    return df.withColumn("m", S.row_mean(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "a", "b", "c", "m", "f")


@query("formula_column_statistics", """
    SELECT o_orderkey, (o_totalprice - m) / s + o_totalprice / t AS v
    FROM orders, (SELECT AVG(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, SUM(o_totalprice) AS t FROM orders)""", "v")
def formula_column_statistics(spark, sf):
    return S.formula_column(table(spark, sf, "orders"), "(o_totalprice - m) / s + o_totalprice / t", "v", stats={
        "m": ("mean", "o_totalprice"), "s": ("std", "o_totalprice"), "t": ("sum", "o_totalprice")}).select("o_orderkey", "v")


@query("formula_result_types", "SELECT p_partkey, p_size * 3 AS i, CAST(p_partkey AS VARCHAR) AS s FROM part")
def formula_result_types(spark, sf):
    df = S.formula_column(table(spark, sf, "part"), "p_size * 3", "i", "int")
    return S.formula_column(df, "p_partkey", "s", "category").select("p_partkey", F.col("i").cast("int"), "s")


@query("derive_if", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size FROM orders")
def derive_if(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", S.derive_if(df, "o_totalprice", ">", 200000, F.lit("large"), F.lit("small")).alias("size"))


@query("derive_ratio", f"SELECT {LI}, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS r FROM lineitem", "r")
def derive_ratio(spark, sf):
    return li(spark, sf, S.ratio(F.col("l_tax"), F.col("l_discount")).alias("r"))


@query("derive_difference_sum", f"""
    SELECT l_orderkey, l_partkey, l_quantity - l_linenumber AS d, COALESCE(l_quantity, 0) + COALESCE(l_linenumber, 0) AS s,
           l_quantity + l_linenumber AS t FROM {CREDIT_NULL}""", "d s t")
def derive_difference_sum(spark, sf):
    a, b = F.col("l_quantity"), F.col("l_linenumber")
    return credit_null(spark, sf).select("l_orderkey", "l_partkey", S.difference(a, b).alias("d"), S.add_up(a, b).alias("s"),
                                         S.add_up(a, b, skipna=False).alias("t"))


@query("derive_interaction", f"""
    SELECT {LI}, l_quantity * l_tax * l_discount AS m, l_quantity + l_tax AS a, l_quantity - l_tax - l_discount AS s,
           CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS d FROM lineitem""", "m a s d")
def derive_interaction(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     S.interaction(df, ["l_quantity", "l_tax", "l_discount"]).alias("m"),
                     S.interaction(df, ["l_quantity", "l_tax"], "add").alias("a"),
                     S.interaction(df, ["l_quantity", "l_tax", "l_discount"], "subtract").alias("s"),
                     S.interaction(df, ["l_quantity", "l_discount"], "divide").alias("d"))


@query("derive_binary_flag", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'blue|red') THEN 1 ELSE 0 END AS f, CASE WHEN p_size >= 25 THEN 1 ELSE 0 END AS g FROM part")
def derive_binary_flag(spark, sf):
    df = table(spark, sf, "part")
    return df.select("p_partkey", S.binary_flag(df, "p_name", "contains", "blue|red").alias("f"),
                     S.binary_flag(df, "p_size", ">=", 25).alias("g"))


@query("log_transform_modes", """
    SELECT c_custkey, ln(c_acctbal + (SELECT ABS(MIN(c_acctbal)) + 1 FROM customer)) AS offset_log,
           log10(c_acctbal + (SELECT ABS(MIN(c_acctbal)) + 1 FROM customer)) AS offset_log10,
           ln(1 + GREATEST(c_acctbal, 0)) AS clipped, ln(c_nationkey + 1) AS plus1, CASE WHEN c_nationkey <> 0 THEN ln(c_nationkey) END AS null_zero
    FROM customer""", "offset_log offset_log10 clipped plus1 null_zero")
def log_transform_modes(spark, sf):
    df = table(spark, sf, "customer")
    df = T.log_transform(df, "c_acctbal", "offset_log")
    df = T.log_transform(df, "c_acctbal", "offset_log10", base=10)
    df = T.log_transform(df, "c_acctbal", "clipped", "log1p_clip")
    df = T.log_transform(df, "c_nationkey", "plus1", "plus1")
    df = T.log_transform(df, "c_nationkey", "null_zero", "null_zero")
    return df.select("c_custkey", "offset_log", "offset_log10", "clipped", "plus1", "null_zero")


@query("sqrt_transform", """
    SELECT c_custkey, sqrt(c_acctbal + (SELECT ABS(MIN(c_acctbal)) FROM customer)) AS s, sqrt(ABS(c_acctbal)) AS a FROM customer""", "s a")
def sqrt_transform(spark, sf):
    df = T.sqrt_transform(table(spark, sf, "customer"), "c_acctbal", "s")
    return T.sqrt_transform(df, "c_acctbal", "a", "abs").select("c_custkey", "s", "a")


@query("math_transform", """
    SELECT c_custkey, c_acctbal * c_acctbal AS sq, ABS(c_acctbal) AS ab, exp(c_nationkey / 10.0::DOUBLE) AS ex,
           CASE WHEN c_nationkey <> 0 THEN 1.0::DOUBLE / c_nationkey END AS rc FROM customer""", "sq ab ex rc")
def math_transform(spark, sf):
    x, k = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        "c_custkey", S.math_transform(x, "square").alias("sq"), S.math_transform(x, "abs").alias("ab"),
        S.math_transform(k / 10.0, "exp").alias("ex"), S.math_transform(k, "reciprocal").alias("rc"))


@query("rank_transform", f"""
    SELECT {LI}, rank() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r,
           rank() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS p
    FROM lineitem""", "r p")
def rank_transform(spark, sf):
    df = T.rank_transform(table(spark, sf, "lineitem"), "l_quantity", "r")
    return T.rank_transform(df, "l_extendedprice", "p").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "r", "p")


@query("scale_minmax", """
    SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) AS a, (o_totalprice - lo) / (hi - lo) * 12 - 2 AS b
    FROM orders, (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders)""", "a b")
def scale_minmax(spark, sf):
    df = T.minmax_scale(table(spark, sf, "orders"), "o_totalprice", "a")
    return T.minmax_scale(df, "o_totalprice", "b", -2.0, 10.0).select("o_orderkey", "a", "b")


@query("scale_standardize", """
    SELECT o_orderkey, (o_totalprice - m) / s AS a, (o_totalprice - m) / p AS b
    FROM orders, (SELECT AVG(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, stddev_pop(o_totalprice) AS p FROM orders)""", "a b")
def scale_standardize(spark, sf):
    df = T.standardize(table(spark, sf, "orders"), "o_totalprice", "a")
    return T.standardize(df, "o_totalprice", "b", ddof=0).select("o_orderkey", "a", "b")


@query("one_hot", """
    SELECT o_orderkey, (o_orderstatus = 'F')::INT AS "o_orderstatus_F", (o_orderstatus = 'O')::INT AS "o_orderstatus_O",
           (o_orderstatus = 'P')::INT AS "o_orderstatus_P" FROM orders""")
def one_hot(spark, sf):
    return T.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@query("label_encode", """
    SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS code FROM part""")
def label_encode(spark, sf):
    return T.label_encode(table(spark, sf, "part"), "p_brand", "code").select("p_partkey", "code")


@query("label_encode_many", """
    SELECT doc_id, CAST(dense_rank() OVER (ORDER BY encode(text)) - 1 AS INT) AS code FROM documents""")
def label_encode_many(spark, sf):
    return T.label_encode(table(spark, sf, "documents"), "text", "code", literal_cap=100).select("doc_id", "code")


@query("binary_encode", """
    SELECT l_orderkey, l_partkey, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS a,
           CASE l_linestatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS b FROM lineitem""")
def binary_encode(spark, sf):
    df = T.binary_encode(table(spark, sf, "lineitem"), "l_linestatus", "a")
    return T.binary_encode(df, "l_linestatus", "b", {"F": 1, "O": 0}).select("l_orderkey", "l_partkey", "a", "b")


@query("text_transform", """
    SELECT p_partkey, length(p_name) AS n, len(regexp_extract_all(p_name, '\\S+'))::INT AS words, upper(p_name) AS up,
           lower(p_brand) AS low, try_cast(NULLIF(regexp_extract(p_brand, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS num,
           replace(p_brand, '#', '') AS plain,
           array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title
    FROM part""", "num")
def text_transform(spark, sf):
    n, b = F.col("p_name"), F.col("p_brand")
    t = S.text_transform
    return table(spark, sf, "part").select(
        "p_partkey", t(n, "length").cast("long").alias("n"), t(n, "word_count").alias("words"), t(n, "upper").alias("up"),
        t(b, "lower").alias("low"), t(b, "extract_number").alias("num"), t(b, "strip_punctuation").alias("plain"),
        t(n, "title").alias("title"))


@query("text_word_count_documents", """
    SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::INT AS words FROM documents""")
def text_word_count_documents(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", S.text_transform(t, "length").cast("long").alias("n"),
                                                S.text_transform(t, "word_count").alias("words"))


@query("date_transform", """
    SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS d, (isodow(ts) - 1)::INT AS wd, quarter(ts)::INT AS q,
           floor(epoch_us(TIMESTAMP '2024-06-01 12:00:00' - ts) / 86400000000.0)::INT AS days,
           floor(epoch_us(TIMESTAMP '2024-06-01 12:00:00' - ts) / 86400000000.0) / 365.25 AS age,
           (isodow(ts) >= 6)::INT AS we, (month(ts) = 12 AND day(ts) = 25)::INT AS xmas FROM events""", "age")
def date_transform(spark, sf):
    ts, ref = F.col("ts"), "2024-06-01 12:00:00"
    d = S.date_transform
    return table(spark, sf, "events").select(
        "event_id", d(ts, "year").alias("y"), d(ts, "month").alias("m"), d(ts, "day").alias("d"), d(ts, "weekday").alias("wd"),
        d(ts, "quarter").alias("q"), d(ts, "days_since", ref).alias("days"), d(ts, "age_years", ref).alias("age"),
        d(ts, "is_weekend").alias("we"), d(ts, "is_christmas").alias("xmas"))


@query("bin_equal_width", """
    SELECT o_orderkey, CAST(GREATEST(0, LEAST(6, ceil((o_totalprice - lo) / ((hi - lo) / 7)) - 1)) AS INT) AS b
    FROM orders, (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders)""")
def bin_equal_width(spark, sf):
    return T.bin_equal_width(table(spark, sf, "orders"), "o_totalprice", 7, "b").select("o_orderkey", "b")


@query("bin_equal_width_labels", """
    SELECT p_partkey, CASE WHEN p_size <= lo + (hi - lo) / 3.0::DOUBLE THEN 'low' WHEN p_size <= lo + (hi - lo) * 2 / 3.0::DOUBLE THEN 'mid' ELSE 'high' END AS b
    FROM part, (SELECT MIN(p_size) AS lo, MAX(p_size) AS hi FROM part)""")
def bin_equal_width_labels(spark, sf):
    return T.bin_equal_width(table(spark, sf, "part"), "p_size", 3, "b", ["low", "mid", "high"]).select("p_partkey", "b")


@query("bin_equal_freq", f"""
    WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM lineitem)
    SELECT {LI}, len(list_filter(e[2:len(e) - 1], lambda x: x < l_quantity))::INT AS b FROM lineitem, e""")
def bin_equal_freq(spark, sf):
    return T.bin_equal_freq(table(spark, sf, "lineitem"), "l_quantity", 5, "b").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b")


@query("bin_custom", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN NULL WHEN c_acctbal <= 1000 THEN 0 WHEN c_acctbal <= 5000 THEN 1 ELSE 2 END AS b
    FROM customer""")
def bin_custom(spark, sf):
    return T.bin_custom(table(spark, sf, "customer"), "c_acctbal", [0, 1000, 5000, 9000], "b").select("c_custkey", "b")
