"""Conditions, row selection and missing values on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from timberline.functions.conditions import Condition, combine, condition
from timberline.operators import missing as M
from timberline.operators import ordering as O
from timberline.operators import rows as R


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        [(1, 1.0, "apple", True), (2, float("nan"), "Banana", False), (3, None, None, None), (4, 4.5, "cherry", True)],
        "id int, x double, s string, b boolean")


def ids(df):
    return [r[0] for r in df.orderBy("id").select("id").collect()]


@pytest.mark.parametrize("column, op, value, expected", [
    ("x", ">", 1, [4]), ("x", ">=", "1", [1, 4]), ("x", "=", 4.5, [4]), ("x", "==", 4.5, [4]),
    ("x", "!=", 1, [2, 3, 4]),           # NULL and NaN are not 1
    ("x", "is_null", None, [2, 3]), ("x", "not_null", None, [1, 4]), ("x", "=", "null", [2, 3]), ("x", "!=", "null", [1, 4]),
    ("x", "between", (1, 4), [1]), ("x", "not between", (1, 4), [2, 3, 4]),
    ("s", "contains", "an+a", [2]), ("s", "not contains", "an+a", [1, 3, 4]), ("s", "starts_with", "ch", [4]),
    ("s", "ends_with", "e", [1]), ("s", "in", "apple, cherry", [1, 4]), ("s", "not in", ["apple"], [2, 3, 4]),
    ("s", "<", "b", [1, 2]), ("b", "=", "yes", [1, 4]), ("b", "!=", True, [2, 3]), ("id", "in", [1, 3], [1, 3]),
])
def test_condition(frame, column, op, value, expected):
    assert ids(frame.where(condition(frame, column, op, value))) == expected


def test_condition_errors(frame):
    with pytest.raises(ValueError, match="unknown operator"):
        condition(frame, "x", "like", 1)
    with pytest.raises(ValueError, match="unknown column"):
        condition(frame, "nope", "=", 1)
    with pytest.raises(ValueError):
        condition(frame, "x", ">", "abc")


def test_left_to_right_and_sql_precedence(frame):
    conds = [("id", "=", 1), ("id", "=", 4, "or"), ("x", ">", 2, "and")]
    assert ids(frame.where(combine(frame, conds))) == [4]
    assert ids(frame.where(combine(frame, conds, "sql"))) == [1, 4]
    assert ids(frame.where(combine(frame, []))) == [1, 2, 3, 4]
    assert ids(frame.where(combine(frame, [Condition("id", "<", 3), {"column": "id", "op": ">", "value": 1}]))) == [2]


def test_report_counts(frame):
    assert rows(R.filter_report(frame, [("id", ">", 1)])) == [(4, 3, 1, 25.0)]


def test_fills(frame):
    assert [r[1] for r in rows(M.fill_mean(frame, ["x"]), "id")] == [1.0, 2.75, 2.75, 4.5]
    assert [r[1] for r in rows(M.fill_median(frame, ["x"]), "id")] == [1.0, 2.75, 2.75, 4.5]
    assert [r[1] for r in rows(M.fill_mode(frame, ["x"]), "id")] == [1.0, 1.0, 1.0, 4.5]      # smallest on ties
    assert [r[2] for r in rows(M.fill_constant(frame, {"s": "?"}), "id")][2] == "?"
    assert ids(M.drop_missing(frame, ["x"])) == [1, 4]
    assert [r[1] for r in rows(M.missing_as_category(frame, ["x"]), "id")] == ["1.0", "Missing", "Missing", "4.5"]
    assert rows(M.missing_report(frame, ["x", "s"]), "feature") == [("s", 1, 25.0), ("x", 2, 50.0)]


def test_impute_policies(frame):
    assert ids(M.impute(frame, ["x", "s"], "drop")) == [1, 4]
    assert [r[1] for r in rows(M.impute(frame, ["x"], "zero"), "id")] == [1.0, 0.0, 0.0, 4.5]
    with pytest.raises(ValueError):
        M.impute(frame, ["x"], "guess")


def test_all_null_column_is_left_alone(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, x double")
    assert [r[1] for r in rows(M.fill_median(df, ["x"]), "id")] == [None, None]
    assert R.remove_outliers(df, "iqr", cols=["x"]).count() == 2


def test_outlier_methods(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 3, 3, 3, 4, 4, 5, 100])], "id int, x double")
    for method, t in (("iqr", 1.5), ("zscore", 2.5), ("modified_zscore", 3.5)):
        assert R.remove_outliers(df, method, t, ["x"]).count() == 9, method


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(50_000)
    a = R.sample_rows(df, ["id"], n=12_345)
    assert a.count() == 12_345 and a.distinct().count() == 12_345
    b = R.sample_rows(df.repartition(7), ["id"], n=12_345)
    assert a.exceptAll(b).count() == 0
    assert R.sample_rows(df, ["id"], n=60_000).count() == 50_000


def test_global_index_on_copies(spark):
    """Half of the rows are equal; the index is still 0…n-1 and follows the order."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("v"))
    got = O.global_index(df.repartition(5), [F.col("v")], "i").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(20_000))
    assert all(a["v"] <= b["v"] for a, b in zip(got, got[1:]))


def test_limit_rows(spark):
    df = spark.range(100).repartition(4)
    assert [r[0] for r in R.limit_rows(df, ["id"], skip=10, skip_tail=5, n=200).orderBy("id").collect()] == list(range(10, 95))
    assert [r[0] for r in R.limit_rows(df, ["id"], skip=3, n=2).collect()] == [3, 4]


@pytest.mark.parametrize("limit", [10, 100, 10 ** 6])
def test_exact_quantiles_two_ways(spark, limit):
    import numpy as np
    values = [float((i * 7919) % 1000) / 3 for i in range(5000)] + [50.0] * 3000
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.1, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    got = O.exact_quantiles(df, {"x": probs}, group_values=limit)["x"]
    assert got == pytest.approx(list(np.quantile(np.array(values), probs)))


def test_average_rank_with_buckets_and_hot_value(spark):
    import pandas as pd
    values = [float(i % 97) for i in range(3000)] + [5.0] * 2000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(5000, None)], "id int, x double")
    got = {r["id"]: r["r"] for r in O.average_rank(df, "x", "r", group_values=10).collect()}
    want = pd.Series(values).rank()
    assert got.pop(5000) is None
    assert [got[i] for i in range(5000)] == list(want)


def test_lookup_splits_hot_keys(spark, monkeypatch):
    """A table too large to broadcast: hot keys are broadcast, the rest is shuffled."""
    monkeypatch.setattr(O, "small", lambda table, limit=0: False)
    df = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    table = df.groupBy("k").count().select("k", F.col("count").alias("n"), (F.col("k") * 2).alias("v"))
    out = O.lookup(df.unionByName(spark.createDataFrame([(99999, None)], "id long, k long")), table, "k", "n", 10_000)
    assert out.count() == 10_001
    assert out.where("k IS NOT NULL AND v <> k * 2").count() == 0
    assert out.where("v IS NULL").count() == 1


def test_running_sums_descending_buckets(spark):
    df = spark.createDataFrame([(float(i), i) for i in range(100)], "p double, n int")
    out = O.running_sums(df, "p", ["n"], [10.0, 50.0, 90.0], descending=True).orderBy(F.desc("p")).collect()
    total = 0
    for r in out:
        total += r["n"]
        assert r["cum_n"] == total


def test_duplicates_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, None)], "x int, s string")
    assert R.drop_duplicates(df).count() == 3
    assert R.drop_empty_rows(df).count() == 3


def test_columns_without_values(spark):
    """Named results instead of crashes."""
    from timberline.operators import binning, profiling, transforms
    df = spark.createDataFrame([(None, 1), (None, 0)], "x double, y int")
    for edges in (lambda: binning.edges_equal_width(df, "x", 3), lambda: binning.edges_equal_freq(df, "x", 3),
                  lambda: binning.edges_outlier(df, "x"), lambda: binning.optimal_bins(df, "x", "y")):
        with pytest.raises(ValueError, match="no values"):
            edges()
    assert [r["b"] for r in transforms.bin_custom(df, "x", [], "b").collect()] == [None, None]
    assert profiling.suggest_target_thresholds(df, "x").count() == 0
    assert profiling.correlations(df).count() == 0 and profiling.target_correlations(df, "y").count() == 0


def test_modes_of_many_types_in_two_jobs(spark):
    import datetime
    from timberline.operators.missing import modes
    day = datetime.date(2020, 2, 29)
    df = spark.createDataFrame([(10, "b", True, day, 1.5), (9, "a", True, day, 1.5), (9, "b", False, None, float("nan")), (10, "a", None, None, None)],
                               "i int, s string, b boolean, d date, x double")
    assert modes(df, df.columns) == {"i": 9, "s": "a", "b": True, "d": day, "x": 1.5}


def test_caches_are_released(spark):
    from timberline.operators import evaluation
    scored = spark.createDataFrame([(0.2, 0), (0.7, 1), (0.7, 0)], "p double, y int")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    for _ in range(3):
        evaluation.roc_auc(scored).collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_rules_in_the_column_type():
    from timberline.plans.tree import comparison_sql
    assert comparison_sql("d", "<=", 1_586_520_000.0, "date") == "d <= DATE '2020-04-10'"
    assert comparison_sql("d", "<", 1_586_520_000.0, "date") == "d < DATE '2020-04-11'"
    assert comparison_sql("t", ">", 1_586_520_000.5, "timestamp") == "t > TIMESTAMP '2020-04-10 12:00:00.500000Z'"
    assert comparison_sql("b", "<=", 0.5, "boolean") == "b IN (FALSE)" and comparison_sql("x", "<=", 0.5) == "x <= 0.5"
