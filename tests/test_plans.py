"""What the plans must and must not contain; sources and streams."""

import pytest
from pyspark.sql import functions as F

from conftest import plan
from timberline.functions.conditions import condition
from timberline.operators import edit as E
from timberline.operators import grow as G
from timberline.operators import ordering as O
from timberline.operators import profiling as P
from timberline.operators import reports as N
from timberline.operators import rows as R
from timberline.operators import scoring as S
from timberline.operators import splits as SP
from timberline.sources import readers, writers
from timberline.streaming import scoring as ST
from workload.base import credit
from workload.trees import fixed_tree


def test_node_rows_reach_the_scan(spark, sf):
    p = plan(E.node_rows(credit(spark, sf), fixed_tree(spark, sf), 6).select("l_orderkey"))
    assert "GreaterThanOrEqual(l_extendedprice,40000.0)" in p and "LessThan(l_extendedprice,70000.0)" in p
    assert "l_tax" not in p.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    p = plan(df.where(condition(df, "o_custkey", ">", 100)).select("o_orderkey"))
    assert "GreaterThan(o_custkey,100)" in p
    p = plan(df.where(condition(df, "o_totalprice", ">", 100) & condition(df, "o_orderstatus", "!=", "F")))
    assert "GreaterThan(o_totalprice,100.0)" in p and "Or(IsNull(o_orderstatus),Not(EqualTo(o_orderstatus,F)))" in p


def test_scoring_has_no_shuffle_and_no_python(spark, sf):
    p = plan(S.predict(credit(spark, sf), fixed_tree(spark, sf), 0.5))
    assert "Exchange hashpartitioning" not in p and "Python" not in p and "BroadcastHashJoin" in p


def test_reports_count_before_joining(spark, sf):
    p = plan(N.node_report(credit(spark, sf), fixed_tree(spark, sf)))
    assert "partial_count(1)" in p and "Python" not in p


def _searched(spark, sf, buckets):
    df = credit(spark, sf)
    p = G.TreeParams(bucket_values=20 if buckets else 10 ** 9, buckets=buckets or 1)
    kinds = G.feature_kinds(df, ["l_quantity", "l_extendedprice"])
    data, classes, _, counts = G.prepare(df, kinds, "y", p)
    data, layout = G.lay_out(data, kinds, p)
    data = data.withColumn(SP.GROUP, F.lit(0)).persist()
    features = [(0, F.col("l_quantity")), (1, F.col("l_extendedprice"))]
    totals = G.group_totals(data, [counts], True)
    if buckets:
        return data, features, totals
    return SP.best_numeric(SP.numeric_candidates(data, features, 2, totals, "gini", 1, nulls=False), 2)


def test_split_search_combines_before_the_shuffle(spark, sf):
    p = plan(_searched(spark, sf, None))
    assert "partial_sum" in p and "Python" not in p and "CartesianProduct" not in p and "BroadcastNestedLoop" not in p
    assert "RowFrame, unboundedpreceding" in p and "RangeFrame" not in p


def test_bucketed_search_windows_inside_buckets(spark, sf):
    data, features, totals = _searched(spark, sf, 200)
    p = plan(SP.best_numeric_bucketed(data, features, 2, totals, "gini", 1)[0])
    line = p.split("Window [lead(v")[1].split("\n")[0]
    assert "windowspecdefinition(_g" in line and ", b#" in line
    assert "LeftSemi" in p and "CartesianProduct" not in p and "Python" not in p


def test_level_search_has_no_nested_loop_join(spark, sf):
    df = credit(spark, sf)
    kinds = G.feature_kinds(df, ["l_quantity", "l_extendedprice"])
    p = G.TreeParams(bucket_values=20, buckets=100)
    with G.laid_out(df, kinds, "y", p) as (data, layout, classes, pos, counts):
        root = G.fit(df, ["l_quantity", "l_extendedprice"], "y", growth="manual")
        rows = G._grouped(data, {0: root}, [(0, 0)], None)
        totals = G.group_totals(data, [counts], True)
        features = [(0, F.col("l_quantity")), (1, F.col("l_extendedprice"))]
        plans = [plan(SP.best_numeric_bucketed(rows, features, 2, totals, "gini", 1)[0]),
                 plan(SP.numeric_candidates(rows, features, 2, totals, "gini", 1))]
    assert all("NestedLoop" not in p and "Cartesian" not in p for p in plans)


def test_bounds_close_most_buckets_and_hold(spark, sf):
    """No gain inside a bucket exceeds its bound, and few buckets stay open."""
    data, features, totals = _searched(spark, sf, 200)
    long = SP._melted(data, features, None, bucketed=True)
    table = SP.bucket_table(long, 2, totals, "gini", 1, [SP.GROUP]).persist()
    wide = table.where("bound IS NOT NULL").count()
    still = table.where("bound >= best").count()
    assert 0 < still < wide / 3
    every = SP.numeric_candidates(data, features, 2, totals, "gini", 1, nulls=False)
    inside = every.join(table.select(SP.GROUP, SP.FEATURE, "lo", "hi", "bound"), [SP.GROUP, SP.FEATURE]).where(
        "threshold > lo AND threshold < hi")
    assert inside.where("gain > bound + 1e-12").count() == 0 and inside.count() > 1000


def test_top_categories_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(P.top_categories(spark.read.parquet(f"{sf}/part.parquet"), ["p_name"], 3))


def test_top_rows_is_a_top_k(spark, sf):
    p = plan(R.top_rows(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", n=10))
    assert "TakeOrderedAndProject" in p


def test_global_index_has_no_window(spark):
    p = plan(O.global_index(spark.range(100), [F.col("id")], "i"))
    assert "Window" not in p and "Exchange" not in p      # positions are read off the sorted checkpoint


def test_checkpoint_folder_comes_from_the_session(spark):
    from timberline.core import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("id;amount;day;name\n1;1.234,50;03/02/2024;'a;b'\n2;n/a;bad;c\n3;-7,25;04/02/2024;n/a\n")
    df = readers.read_csv(spark, path, sep=";", quote="'", nulls=["n/a"], numeric=["amount"], decimal=",", thousands=".",
                          dates=["day"], date_format="dd/MM/yyyy")
    got = [tuple(r) for r in df.orderBy("id").select("amount", F.date_format("day", "yyyy-MM-dd"), "name").collect()]
    assert got == [(1234.5, "2024-02-03", "a;b"), (None, None, "c"), (-7.25, "2024-02-04", None)]
    assert readers.sniff_delimiter(spark, path) == ";"
    assert [r["id"] for r in readers.read_csv(spark, path, sep=";", order_by=["id"], skip=1, skip_tail=1).collect()] == ["2"]
    with pytest.raises(ValueError, match="order_by"):
        readers.read_csv(spark, path, sep=";", n=1)


def test_delimiter_falls_back_to_tab(spark, tmp_path):
    path = tmp_path / "one.txt"
    path.write_text("a\nb\n")
    assert readers.sniff_delimiter(spark, str(path)) == "\t"


def test_formats_and_listing(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 1.5)
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / f"d.{fmt}")
        writers.write(df, path, fmt)
        assert readers.read_any(spark, path).count() == 10
    files = readers.list_files(spark, str(tmp_path / "d.parquet"), "*.parquet")
    assert files.count() >= 1 and "content" not in files.columns
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path / "x"), "feather")
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.sas")


def test_jdbc_needs_one_source(spark):
    with pytest.raises(ValueError, match="either table or query"):
        readers.read_jdbc(spark, "jdbc:none:x")


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(1000).withColumn("s", F.col("id").cast("string"))
    a, b = (writers.dataset_fingerprint(d).first() for d in (df, df.orderBy(F.rand(1)).repartition(3)))
    assert a == b
    assert writers.dataset_fingerprint(df.withColumn("s", F.lit("x"))).first()["checksum"] != a["checksum"]


def test_stream_scoring(spark, sf, tmp_path):
    model = fixed_tree(spark, sf)
    df = credit(spark, sf)
    src = str(tmp_path / "in")
    df.drop("y").repartition(4).write.parquet(src)
    stream = ST.read_stream(spark, src, df.drop("y").schema, max_files=1)
    done = ST.score_stream(stream, model, [("l_tax", ">", 0.02)], 0.334)
    ST.write_stream(done, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = S.predict(df.where("l_tax > 0.02"), model, 0.334).select(got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
