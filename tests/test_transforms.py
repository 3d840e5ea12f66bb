import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from timberline.functions import scalar as S
from timberline.operators import transforms as T
from timberline.plans.recipe import Step, apply_recipe, recipe_report


def col(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ["id"])).collect()]


@pytest.fixture(scope="module")
def nums(spark):
    return spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0), (4, None)], "id int, x double")


def test_equal_width_is_right_closed(nums):
    assert col(T.bin_equal_width(nums, "x", 2, "b"), "b") == [0, 0, 1, None]
    assert col(T.bin_equal_width(nums, "x", 2, "b", ["lo", "hi"]), "b") == ["lo", "lo", "hi", None]


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, x double")
    assert col(T.minmax_scale(df, "x", "y"), "y") == [0.0, 0.0]
    assert col(T.standardize(df, "x", "y"), "y") == [0.0, 0.0]
    assert len(set(col(T.bin_equal_width(df, "x", 4, "y"), "y"))) == 1
    assert col(T.bin_equal_freq(df, "x", 4, "y"), "y") == [0, 0]


def test_custom_bins_outside_is_null(nums):
    assert col(T.bin_custom(nums, "x", [0, 5, 9], "b"), "b") == [0, 0, None, None]


def test_log_and_sqrt_offsets(spark):
    df = spark.createDataFrame([(1, -4.0), (2, 0.0), (3, 5.0)], "id int, x double")
    assert col(T.log_transform(df, "x", "y"), "y") == pytest.approx([0.0, math.log(5), math.log(10)])
    assert col(T.sqrt_transform(df, "x", "y"), "y") == pytest.approx([0.0, 2.0, 3.0])
    assert col(T.log_transform(df, "x", "y", "null_zero").where("id > 1"), "y")[0] is None
    assert col(T.log_transform(df, "x", "y", "log1p_clip"), "y") == pytest.approx([0.0, 0.0, math.log(6)])


def test_ratio_and_interaction_by_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 6.0, 3.0)], "id int, a double, b double")
    assert col(df.withColumn("r", S.ratio(F.col("a"), F.col("b"))), "r") == [None, 2.0]
    assert col(df.withColumn("r", S.interaction(df, ["a", "b"], "divide")), "r") == [None, 2.0]
    with pytest.raises(ValueError):
        S.interaction(df, ["a"])


def test_sum_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, None)], "id int, a int, b int")
    a, b = F.col("a"), F.col("b")
    assert col(df.withColumn("s", S.add_up(a, b)), "s") == [1, 0]
    assert col(df.withColumn("s", S.add_up(a, b, skipna=False)), "s") == [None, None]
    assert col(df.withColumn("m", S.row_mean(a, b)), "m") == [1.0, None]


def test_text_cases(spark):
    df = spark.createDataFrame([(1, "Café  d'été, 12.5 km!"), (2, ""), (3, None)], "id int, s string")
    s = F.col("s")
    get = lambda kind: col(df.select("id", S.text_transform(s, kind).alias("v")), "v")
    assert get("length") == [21, 0, None]
    assert get("word_count") == [4, 0, None] or get("word_count")[:2] == [4, 0]
    assert get("strip_punctuation") == ["Café  dété 125 km", "", None]
    assert get("extract_number") == [12.5, None, None]
    assert get("upper")[0] == "CAFÉ  D'ÉTÉ, 12.5 KM!"


def test_date_cases(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-02-29 23:00:00'), (2, TIMESTAMP_NTZ '2023-12-25 00:00:00'),
                      (3, TIMESTAMP_NTZ '2024-03-02 06:00:00') t(id, ts)""")
    ts, ref = F.col("ts"), "2024-03-01 12:00:00"
    get = lambda kind, **kw: col(df.select("id", S.date_transform(ts, kind, **kw).alias("v")), "v")
    assert get("days_since", ref=ref) == [0, 67, -1]        # whole days, floored
    assert get("weekday") == [3, 0, 5]
    assert get("is_weekend") == [0, 0, 1]
    assert get("is_christmas") == [0, 1, 0]
    with pytest.raises(ValueError):
        S.date_transform(ts, "age_years")


def test_encodings(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id int, s string")
    assert col(T.label_encode(df, "s", "k"), "k") == [1, 0, -1, 2]
    assert col(T.label_encode(df, "s", "k", literal_cap=2), "k") == [1, 0, -1, 2]
    hot = T.one_hot(df, "s")
    assert col(hot, "s_b") == [1, 0, 0, 0]
    with pytest.raises(ValueError, match="more than 2"):
        T.one_hot(df, "s", cap=2)
    with pytest.raises(ValueError):
        T.binary_encode(df, "s", "k")


def test_formula_bad_cast_is_null(spark):
    df = spark.createDataFrame([(1, "12"), (2, "x")], "id int, s string")
    assert col(S.formula_column(df, "s", "v", "int"), "v") == [12, None]


def test_recipe(spark, nums):
    steps = [Step("drop_missing", {"cols": ["x"]}), ("filter", {"conditions": [("x", ">", 1)]}),
             ("math", {"name": "sq", "col": "x", "kind": "square"})]
    assert col(apply_recipe(nums, steps), "sq") == [25.0, 100.0]
    assert [(r["rows_before"], r["rows_after"]) for r in recipe_report(nums, steps).orderBy("step").collect()] == [(4, 3), (3, 2), (2, 2)]
    with pytest.raises(ValueError, match="unknown recipe"):
        apply_recipe(nums, [("explode", {})])
