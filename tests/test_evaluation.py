"""Metrics on small scored tables with known values."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from timberline.operators import binning as B
from timberline.operators import evaluation as V
from timberline.operators import grouping as GR
from timberline.operators import profiling as P
from timberline.operators.ordering import with_replicates


@pytest.fixture(scope="module")
def scored(spark):
    data = [(1, 0.9, 1), (2, 0.8, 1), (3, 0.8, 0), (4, 0.5, 1), (5, 0.4, 0), (6, 0.4, 0), (7, 0.1, 1), (8, 0.1, 0)]
    return spark.createDataFrame(data, "id int, p double, y int").withColumn("prediction", (F.col("p") >= 0.5).cast("int"))


def value(df):
    return df.first()[0]


def test_auc_ap_ks(scored):
    pairs = [(a, b) for _, a, y, _ in scored.collect() if y == 1 for _, b, z, _ in scored.collect() if z == 0]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert value(V.roc_auc(scored)) == pytest.approx(auc)
    # recall steps: .25 @1, .25 @2/3, .25 @3/4, .25 @4/8
    assert value(V.average_precision(scored)) == pytest.approx(0.25 * (1 + 2 / 3 + 3 / 4 + 1 / 2))
    ks = V.ks_statistic(scored).first()
    assert ks["ks"] == pytest.approx(0.5) and ks["threshold"] == 0.5
    assert value(V.roc_area(scored)) == pytest.approx(auc)


def test_auc_is_invariant_under_monotone_change(scored):
    squashed = scored.withColumn("p", F.exp(F.col("p") * 5))
    assert value(V.roc_auc(squashed)) == pytest.approx(value(V.roc_auc(scored)))


def test_one_class_only(scored):
    only = scored.where("y = 1")
    assert value(V.roc_auc(only)) is None
    assert value(V.average_precision(only)) == pytest.approx(1.0)
    none = scored.where("y = 0")
    assert value(V.average_precision(none)) is None or value(V.average_precision(none)) == 0
    assert V.lift_curve(none).where("lift IS NOT NULL AND lift <> 0").count() == 0


def test_binary_metrics(scored):
    m = {r["metric"]: r["value"] for r in V.classification_metrics(scored, positive="1").collect()}
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (3, 1, 3, 1)
    assert m["accuracy"] == 0.75 and m["tpr"] == 0.75 and m["fpr"] == 0.25 and m["ppv"] == 0.75
    assert m["mcc"] == pytest.approx(0.5) and m["f1"] == pytest.approx(0.75)


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1.0, 0), (0.5, 1)], "p double, y int")
    assert value(V.log_loss(df)) == pytest.approx((-math.log(1e-15) + math.log(2)) / 2, rel=1e-2)


def test_lift_table(spark):
    df = spark.createDataFrame([(i, i / 100, int(i >= 80)) for i in range(100)], "id int, p double, y int")
    t = rows(V.lift_table(df, ["id"], 5), "bin")
    assert [(r[0], r[2]) for r in t] == [(0, 20), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert t[0][4] == pytest.approx(5.0)


def test_stability_of_a_perfect_model(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "id int, y int, prediction int")
    s = V.model_stability(df, ["id"], n=8).first()
    assert s["accuracy_mean"] == 1.0 and s["stability"] == 1.0


def test_poisson_weights_have_mean_one(spark):
    m = with_replicates(spark.range(20_000), ["id"], 8, 42).agg(*[F.avg(f"w{i}") for i in range(8)]).first()
    assert all(abs(x - 1) < 0.03 for x in m)


# --- bins ----------------------------------------------------------------

@pytest.fixture(scope="module")
def bins(spark):
    return spark.createDataFrame([(float(v), v >= 5) for v in range(10)] + [(None, True)], "x double, y boolean")


def test_bins_and_nulls(bins):
    t = {r["bin"]: r for r in B.bin_stats(bins, "x", [0, 3, 5, 9], "y").collect()}
    assert [t[i]["n"] for i in range(3)] == [3, 2, 6]      # NULL joins the largest bin
    assert t[2]["class_counts"] == {"false": 0, "true": 6} and t[2]["gini"] == 0
    q = B.quality(B.bin_counts(bins.dropna(), "x", [0, 5, 9], "y"))
    assert q["impurity_before"] == 0.5 and q["gain_ratio"] == 1.0
    assert B.rated(B.quality_table(bins.sparkSession, {"x": q})).first()["label"] == "good"
    empty = B.bin_stats(bins, "x", [0, 9, 20, 30], "y").where("bin = 2").first()
    assert empty["n"] == 0 and empty["gini"] == 0


def test_merge_and_validate(bins):
    assert B.merge_small_bins(bins, "x", [0, 1, 5, 8, 9], "y", min_n=3) == [0.0, 5.0, 9.0]
    ok = lambda b: B.validate_bins(bins, "x", b).first()["problems"]
    assert ok([(0, 5), (5, 9)]) == "" and ok([(0, 5), (4, 9)]) == "overlap" and ok([(0, 3), (5, 9)]) == "gap"
    assert ok([(3, 3), (3, 9)]) == "empty_interval,range_not_covered"


def test_edges_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    assert B.edges_equal_freq(df, "x", 4) == [1.0, 2.0]
    const = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert B.edges_equal_width(const, "x", 2)[0] < 5 < B.edges_equal_width(const, "x", 2)[-1]


def test_grouping_of_few_categories(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "c string, y int")
    assert {r["grp"] for r in GR.group_categories(df, "c", "y", "entropy").collect()} == {"3"}
    assert sorted(r["grp"] for r in GR.group_categories(df, "c", method="frequency").collect()) == ["1", "2"]
    with pytest.raises(ValueError):
        GR.group_categories(df, "c", method="entropy")


# --- profiles ------------------------------------------------------------

def test_profiles_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (300, 1.5, "y"), (2, float("nan"), None)], "a long, b double, c string")
    t = {r["feature"]: r for r in P.suggest_schema(df).collect()}
    assert t["a"]["suggested"] == "smallint" and t["b"]["suggested"] == "float" and t["b"]["nulls"] == 2
    s = P.dataset_summary(df.unionByName(df)).first()
    assert (s["rows"], s["duplicate_rows"], s["missing_cells"]) == (6, 3, 6)
    d = {r["feature"]: r for r in P.describe_numeric(df).collect()}
    assert d["b"]["n"] == 1 and d["b"]["q50"] == 1.5 and d["a"]["q50"] == 2.0


def test_all_null_profile(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string")
    assert P.describe_numeric(df).first()["q50"] is None
    assert P.outlier_summary(df).first()["outliers"] == 0
    assert P.feature_profile(df).first()["suggested_bins"] == 2
    assert P.infer_string_types(df.select("s")).first()["inferred"] == "category"


def test_approximate_counts_are_offered(spark):
    df = spark.range(1000)
    assert abs(P.analyze_columns(df, exact=False).first()["distinct_values"] - 1000) < 100


def test_target_validation(spark):
    df = spark.createDataFrame([("a",)] * 20 + [("b",)] + [(None,)], "t string")
    r = P.validate_target(df, "t").first()
    assert r["is_valid"] and r["balance"] == "severe" and r["nulls"] == 1
