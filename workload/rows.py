"""Sources, filters, row selection, missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.conditions import Condition
from timberline.operators import missing as M
from timberline.operators import rows as R
from timberline.sources import readers, writers
from workload.base import CREDIT_NULL, credit_null, query, table

# --- filters -------------------------------------------------------------


@query("filter_compare", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_quantity >= 30 AND l_returnflag = 'R' AND l_linenumber <> 4
      AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount <= 0.05""")
def filter_compare(spark, sf):
    df = R.filter_rows(table(spark, sf, "lineitem"), [
        ("l_quantity", ">=", "30"), ("l_returnflag", "=", "R"), ("l_linenumber", "!=", 4),
        ("l_shipdate", "<", "1997-01-01"), ("l_discount", "<=", 0.05)])
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("filter_text", """
    SELECT p_partkey, p_name FROM part
    WHERE (regexp_matches(p_name, 'b[lo]') OR starts_with(p_name, 'red')) AND ends_with(p_name, 't')
      AND NOT regexp_matches(p_name, 'ring')""")
def filter_text(spark, sf):
    return R.filter_rows(table(spark, sf, "part"), [
        ("p_name", "contains", "b[lo]"), ("p_name", "starts_with", "red", "or"), ("p_name", "ends_with", "t"),
        ("p_name", "not contains", "ring")]).select("p_partkey", "p_name")


@query("filter_between", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_totalprice BETWEEN 100000 AND 200000 AND NOT (o_custkey BETWEEN 10 AND 400)""")
def filter_between(spark, sf):
    return R.filter_rows(table(spark, sf, "orders"), [
        ("o_totalprice", "between", (100000, 200000)), ("o_custkey", "not between", (10, 400))
    ]).select("o_orderkey", "o_totalprice")


@query("filter_in_list", """
    SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
    WHERE c_mktsegment IN ('MACHINERY', 'BUILDING') AND c_nationkey NOT IN (1, 2, 3)""")
def filter_in_list(spark, sf):
    return R.filter_rows(table(spark, sf, "customer"), [
        ("c_mktsegment", "in", "MACHINERY, BUILDING"), ("c_nationkey", "not in", [1, 2, 3])
    ]).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("filter_null_tests", f"""
    SELECT l_orderkey, l_linenumber, l_quantity FROM {CREDIT_NULL}
    WHERE l_quantity IS NULL OR l_linenumber IS NULL""")
def filter_null_tests(spark, sf):
    return R.filter_rows(credit_null(spark, sf), [
        ("l_quantity", "is_null"), ("l_linenumber", "=", "null", "or")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_left_to_right", """
    SELECT o_orderkey FROM orders
    WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 250000""")
def filter_left_to_right(spark, sf):
    return R.filter_rows(table(spark, sf, "orders"), [
        ("o_orderstatus", "=", "F"), ("o_orderpriority", "=", "1-URGENT", "or"), ("o_totalprice", ">", 250000)
    ]).select("o_orderkey")


@query("filter_sql_precedence", """
    SELECT o_orderkey FROM orders
    WHERE o_orderstatus = 'F' OR (o_orderpriority = '1-URGENT' AND o_totalprice > 250000)""")
def filter_sql_precedence(spark, sf):
    return R.filter_rows(table(spark, sf, "orders"), [
        Condition("o_orderstatus", "=", "F"), Condition("o_orderpriority", "=", "1-URGENT", "or"),
        Condition("o_totalprice", ">", 250000)], precedence="sql").select("o_orderkey")


@query("filter_expr", "SELECT event_id, value FROM events WHERE value * 2 > 30 AND event_type IN ('click', 'view')")
def filter_expr(spark, sf):
    return R.filter_expr(table(spark, sf, "events"), "value * 2 > 30 AND event_type IN ('click', 'view')").select("event_id", "value")


@query("filter_report", """
    SELECT COUNT(*) AS rows_before, COUNT(*) FILTER (value > 10) AS rows_after,
           COUNT(*) FILTER (value <= 10) AS rows_removed,
           COUNT(*) FILTER (value <= 10) * 100.0::DOUBLE / COUNT(*) AS removed_pct FROM events""", "removed_pct")
def filter_report(spark, sf):
    return R.filter_report(table(spark, sf, "events"), [("value", ">", 10)])


@query("drop_duplicates", "SELECT DISTINCT text FROM documents")
def drop_duplicates(spark, sf):
    return R.drop_duplicates(table(spark, sf, "documents").select("text"))


@query("drop_empty_rows", """
    SELECT l_linenumber, l_quantity FROM (
      SELECT NULLIF(l_linenumber, 3) AS l_linenumber, CASE WHEN l_quantity <= 45 THEN l_quantity END AS l_quantity FROM lineitem)
    WHERE l_linenumber IS NOT NULL OR l_quantity IS NOT NULL""")
def drop_empty_rows(spark, sf):
    return R.drop_empty_rows(credit_null(spark, sf).select("l_linenumber", "l_quantity"))


DRAWN = "md5(concat_ws('|', o_orderkey, '42'))"


@query("sample_rows_n", f"SELECT * FROM orders ORDER BY {DRAWN}, o_orderkey LIMIT 500")
def sample_rows_n(spark, sf):
    return R.sample_rows(table(spark, sf, "orders"), ["o_orderkey"], n=500)


@query("sample_rows_pct", f"""
    SELECT o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (ORDER BY {DRAWN}, o_orderkey) AS i FROM orders)
    WHERE i <= (SELECT round(COUNT(*) * 80 / 100.0) FROM orders)""")
def sample_rows_pct(spark, sf):
    return R.sample_rows(table(spark, sf, "orders"), ["o_orderkey"], pct=80).select("o_orderkey", "o_totalprice")


@query("remove_outliers_iqr", """
    WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS p1, quantile_cont(l_extendedprice, 0.75) AS p3,
                      quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b
    WHERE l_extendedprice BETWEEN p1 - 0.7 * (p3 - p1) AND p3 + 0.7 * (p3 - p1)
      AND l_quantity BETWEEN q1 - 0.7 * (q3 - q1) AND q3 + 0.7 * (q3 - q1)""")
def remove_outliers_iqr(spark, sf):
    return R.remove_outliers(table(spark, sf, "lineitem"), "iqr", 0.7, ["l_extendedprice", "l_quantity"]).select(
        "l_orderkey", "l_linenumber", "l_extendedprice")


@query("remove_outliers_zscore", """
    SELECT c_custkey, c_acctbal FROM customer, (SELECT AVG(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)
    WHERE ABS(c_acctbal - m) / s < 1.2""")
def remove_outliers_zscore(spark, sf):
    return R.remove_outliers(table(spark, sf, "customer"), "zscore", 1.2, ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("remove_outliers_modified_zscore", """
    WITH m AS (SELECT median(value) AS med FROM events),
         d AS (SELECT median(ABS(value - med)) AS mad FROM events, m)
    SELECT event_id, value FROM events, m, d WHERE 0.6745 * ABS(value - med) / mad < 2.0""")
def remove_outliers_modified_zscore(spark, sf):
    return R.remove_outliers(table(spark, sf, "events"), "modified_zscore", 2.0, ["value"]).select("event_id", "value")


@query("remove_outliers_sequential", """
    WITH a AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem),
    s AS (SELECT l.* FROM lineitem l, a WHERE l_quantity BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)),
    b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM s)
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM s, b
    WHERE l_extendedprice BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)""")
def remove_outliers_sequential(spark, sf):
    return R.remove_outliers(table(spark, sf, "lineitem"), "iqr", 0.3, ["l_quantity", "l_extendedprice"], sequential=True).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("select_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def select_columns(spark, sf):
    return R.select_columns(table(spark, sf, "supplier"), ["s_suppkey", "s_acctbal"])


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_rows(spark, sf):
    return R.top_rows(table(spark, sf, "orders"), "o_totalprice", n=100, then=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("limit_rows", """
    SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i,
                                                 COUNT(*) OVER () AS n FROM orders) WHERE i > 25 AND i <= n - 40""")
def limit_rows(spark, sf):
    return R.limit_rows(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], skip=25, skip_tail=40).select(
        "o_orderkey", "o_totalprice")


# --- missing values ------------------------------------------------------

NULLED = "(SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag FROM " + CREDIT_NULL + ")"


def nulled(spark, sf):
    return credit_null(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("drop_missing", f"SELECT * FROM {NULLED} WHERE l_quantity IS NOT NULL AND l_linenumber IS NOT NULL")
def drop_missing(spark, sf):
    return M.drop_missing(nulled(spark, sf), ["l_quantity", "l_linenumber"])


@query("fill_constant", f"SELECT * REPLACE (COALESCE(l_quantity, -1.5) AS l_quantity, COALESCE(l_linenumber, 99)::INT AS l_linenumber) FROM {NULLED}")
def fill_constant(spark, sf):
    return M.fill_constant(nulled(spark, sf), {"l_quantity": -1.5, "l_linenumber": 99})


@query("fill_mean", f"""
    SELECT * REPLACE (COALESCE(l_quantity, (SELECT AVG(l_quantity) FROM {NULLED})) AS l_quantity,
                      COALESCE(l_linenumber::DOUBLE, (SELECT AVG(l_linenumber) FROM {NULLED})) AS l_linenumber) FROM {NULLED}""",
       "l_quantity l_linenumber")
def fill_mean(spark, sf):
    return M.fill_mean(nulled(spark, sf), ["l_quantity", "l_linenumber"])


@query("fill_median", f"""
    SELECT * REPLACE (COALESCE(l_quantity, (SELECT median(l_quantity) FROM {NULLED})) AS l_quantity,
                      COALESCE(l_linenumber::DOUBLE, (SELECT median(l_linenumber) FROM {NULLED})) AS l_linenumber) FROM {NULLED}""",
       "l_quantity l_linenumber")
def fill_median(spark, sf):
    return M.fill_median(nulled(spark, sf), ["l_quantity", "l_linenumber"])


@query("fill_mode", f"""
    WITH q AS (SELECT l_quantity AS v FROM {NULLED} WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
         n AS (SELECT l_linenumber AS v FROM {NULLED} WHERE l_linenumber IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
    SELECT * REPLACE (COALESCE(l_quantity, (SELECT v FROM q)) AS l_quantity,
                      COALESCE(l_linenumber, (SELECT v FROM n)) AS l_linenumber) FROM {NULLED}""")
def fill_mode(spark, sf):
    return M.fill_mode(nulled(spark, sf), ["l_quantity", "l_linenumber"])


@query("impute_policy_median", f"""
    SELECT * REPLACE (COALESCE(l_quantity, (SELECT median(l_quantity) FROM {NULLED})) AS l_quantity) FROM {NULLED}""", "l_quantity")
def impute_policy_median(spark, sf):
    return M.impute(nulled(spark, sf), ["l_quantity", "l_returnflag"], "median")


@query("missing_as_category", f"SELECT * REPLACE (COALESCE(CAST(l_linenumber AS VARCHAR), 'Missing') AS l_linenumber) FROM {NULLED}")
def missing_as_category(spark, sf):
    return M.missing_as_category(nulled(spark, sf), ["l_linenumber"])


@query("missing_report", f"""
    SELECT 'l_quantity' AS feature, COUNT(*) FILTER (l_quantity IS NULL) AS missing,
           COUNT(*) FILTER (l_quantity IS NULL) * 100.0::DOUBLE / COUNT(*) AS missing_pct FROM {NULLED}
    UNION ALL SELECT 'l_linenumber', COUNT(*) FILTER (l_linenumber IS NULL),
           COUNT(*) FILTER (l_linenumber IS NULL) * 100.0::DOUBLE / COUNT(*) FROM {NULLED}
    UNION ALL SELECT 'l_returnflag', 0, 0.0""", "missing_pct")
def missing_report(spark, sf):
    return M.missing_report(nulled(spark, sf), ["l_quantity", "l_linenumber", "l_returnflag"])


@query("missing_change", f"""
    SELECT 'l_quantity' AS feature, COUNT(*) FILTER (l_quantity IS NULL) AS missing_before, 0::BIGINT AS missing_after,
           COUNT(*) FILTER (l_quantity IS NULL) AS handled FROM {NULLED}
    UNION ALL SELECT 'l_linenumber', COUNT(*) FILTER (l_linenumber IS NULL), COUNT(*) FILTER (l_linenumber IS NULL), 0 FROM {NULLED}""")
def missing_change(spark, sf):
    df = nulled(spark, sf)
    return M.missing_change(df, M.fill_median(df, ["l_quantity"]), ["l_quantity", "l_linenumber"])


# --- sources -------------------------------------------------------------

def scratch(spark, sf, name: str) -> str:
    """A fresh folder next to the session's checkpoints."""
    import uuid

    from timberline.core import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_csv", "SELECT o_orderkey, o_totalprice, NULLIF(o_orderstatus, 'P') AS o_orderstatus, o_orderdate FROM orders")
def read_csv(spark, sf):
    """Orders written as CSV with ; and decimal commas, read back with null tokens and dates."""
    path = scratch(spark, sf, "orders-csv")
    src = table(spark, sf, "orders").select(
        F.col("o_orderkey"), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("o_orderdate"))
    writers.write(src, path, "csv", sep=";")
    df = readers.read_csv(spark, path, sep=";", nulls=["N/A"], numeric=["o_totalprice"], decimal=",",
                          dates=["o_orderdate"], date_format="dd.MM.yyyy")
    return df.withColumns({
        "o_orderkey": F.col("o_orderkey").cast("long"), "o_orderdate": F.col("o_orderdate").cast("timestamp_ntz")})


@query("read_delimited", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def read_delimited(spark, sf):
    path = scratch(spark, sf, "nation-txt")
    writers.write(table(spark, sf, "nation"), path, "csv", sep="|")
    return readers.read_delimited(spark, path)


@query("read_parquet", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 10")
def read_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/part.parquet", ["p_partkey", "p_size"],
                                order_by=[F.col("p_size").desc(), F.col("p_partkey")], skip=10, n=50)


@query("read_json", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_json(spark, sf):
    path = scratch(spark, sf, "supplier-json")
    writers.write(table(spark, sf, "supplier"), path, "json")
    return readers.read_json(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("list_files", "SELECT 'lineitem.parquet' AS name, COUNT(*) AS n FROM lineitem")
def list_files(spark, sf):
    """The files of lineitem with the rows that come from each."""
    files = readers.list_files(spark, f"{sf}/lineitem.parquet").where("size > 0").select("name")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.join(table(spark, sf, "lineitem").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")), "name")


@query("parse_dates", """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('day', ts) END AS day FROM events""")
def parse_dates(spark, sf):
    text = F.when(F.col("event_type") == "error", "not a date").otherwise(F.date_format("ts", "yyyy/MM/dd"))
    df = table(spark, sf, "events").select("event_id", text.alias("day"))
    return readers.parse_dates(df, ["day"], "yyyy/MM/dd").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("dataset_fingerprint", """
    SELECT COUNT(*) AS rows, 6 AS columns FROM orders""")
def dataset_fingerprint(spark, sf):
    return writers.dataset_fingerprint(table(spark, sf, "orders")).select("rows", "columns")
