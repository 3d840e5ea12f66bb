"""Split search against exhaustive plain Python, growing, editing, pruning."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from timberline.functions.impurity import impurity_of
from timberline.operators import edit as E
from timberline.operators import evaluation as V
from timberline.operators import grow as G
from timberline.operators import pruning as P
from timberline.operators import scoring as S
from timberline.plans.tree import Split, TreeModel, positive_class
from timberline.sources import writers


# --- plain Python search -------------------------------------------------

def counts(items, classes):
    return [sum(w for y, w in items if y == c) for c in classes]


def gain_of(left, right, classes, criterion):
    l, r = counts(left, classes), counts(right, classes)
    n = sum(l) + sum(r)
    parent = impurity_of([a + b for a, b in zip(l, r)], criterion)
    return parent - sum(l) / n * impurity_of(l, criterion) - sum(r) / n * impurity_of(r, criterion)


def brute_numeric(data, classes, criterion, min_leaf=1):
    known = [(x, y, w) for x, y, w in data if x is not None and not math.isnan(x)]
    best = None
    values = sorted({x for x, _, _ in known})
    for a, b in zip(values, values[1:]):
        t = (a + b) / 2
        left = [(y, w) for x, y, w in known if x <= t]
        right = [(y, w) for x, y, w in known if x > t]
        if sum(w for _, w in left) < min_leaf or sum(w for _, w in right) < min_leaf:
            continue
        g = gain_of(left, right, classes, criterion)
        if best is None or round(g, 12) > round(best[0], 12):
            best = (g, t)
    return best


def brute_categorical(data, classes, criterion):
    known = [(x, y, w) for x, y, w in data if x is not None]
    cats = sorted({x for x, _, _ in known})
    best = -1.0
    for k in range(1, len(cats)):
        for part in itertools.combinations(cats, k):
            g = gain_of([(y, w) for x, y, w in known if x in part], [(y, w) for x, y, w in known if x not in part], classes, criterion)
            best = max(best, g)
    return best


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(5)
    out = []
    for i in range(200):
        a = rng.choice([None, float("nan")]) if rng.random() < 0.1 else round(rng.gauss(0, 2), 1)
        b = float(rng.randrange(40))
        c = None if rng.random() < 0.1 else rng.choice("pqrstu")
        d = rng.choice(["x", "y", "z"])
        score = (a if a is not None and not math.isnan(a) else 0) + b / 10 + (c in ("p", "q", "t")) * 2 + rng.gauss(0, 1)
        out.append((i, a, b, c, d, "hi" if score > 4 else "mid" if score > 2 else "lo", int(score > 3), rng.randrange(1, 4)))
    return out


@pytest.fixture(scope="module")
def random_200(spark, random_rows):
    return spark.createDataFrame(random_rows, "id int, a double, b double, c string, d string, y3 string, y int, w int").persist()


@pytest.mark.parametrize("target, pos", [("y", 6), ("y3", 5)])
@pytest.mark.parametrize("criterion", ["gini", "entropy", "misclassification"])
def test_numeric_search_equals_brute_force(random_200, random_rows, target, pos, criterion):
    classes = sorted({str(r[pos]) for r in random_rows})
    for bucket_values, buckets in ((10 ** 6, 1), (7, 4), (7, 100)):
        _, found = G.best_splits(random_200, ["a", "b"], target, criterion=criterion, min_samples_leaf=5,
                                 bucket_values=bucket_values, buckets=buckets)
        for f in found:
            i = {"a": 1, "b": 2}[f.split.feature]
            g, t = brute_numeric([(r[i], str(r[pos]), 1) for r in random_rows], classes, criterion, 5)
            assert f.gain == pytest.approx(g) and f.split.value == pytest.approx(t)


def test_weighted_search(random_200, random_rows):
    _, found = G.best_splits(random_200, ["a"], "y", criterion="gini", weight_col="w")
    g, t = brute_numeric([(r[1], str(r[6]), r[7]) for r in random_rows], ["0", "1"], "gini")
    assert found[0].gain == pytest.approx(g) and found[0].split.value == pytest.approx(t)


@pytest.mark.parametrize("target, pos", [("y", 6), ("y3", 5)])
def test_categorical_search_equals_brute_force(random_200, random_rows, target, pos):
    classes = sorted({str(r[pos]) for r in random_rows})
    _, found = G.best_splits(random_200, ["c", "d"], target, criterion="entropy")
    for f in found:
        i = {"c": 3, "d": 4}[f.split.feature]
        assert f.gain == pytest.approx(brute_categorical([(r[i], str(r[pos]), 1) for r in random_rows], classes, "entropy"))
        nulls = sum(r[i] is None for r in random_rows)
        assert sum(f.nulls) == nulls and sum(f.left) + sum(f.right) + nulls == 200


def test_missing_child_is_the_larger_side(random_200):
    _, found = G.best_splits(random_200, ["a", "c"], "y")
    for f in found:
        assert f.split.missing_child == (0 if sum(f.left) >= sum(f.right) else 1)


# --- growing -------------------------------------------------------------

def brute_tree(data, depth, features, classes, criterion, min_leaf):
    """Recursive growth on rows of (x tuple, y); returns the leaf class counts in order."""
    own = counts([(y, 1) for _, y in data], classes)
    if depth == 0 or len(data) < 2 or impurity_of(own, criterion) <= 1e-4:
        return [tuple(own)]
    best = None
    for i in range(features):
        found = brute_numeric([(x[i], y, 1) for x, y in data], classes, criterion, min_leaf)
        if found and found[0] > 0 and (best is None or round(found[0], 12) > round(best[0], 12)):
            best = (*found, i)
    if best is None:
        return [tuple(own)]
    _, t, i = best
    null = lambda v: v is None or math.isnan(v)
    left = [r for r in data if not null(r[0][i]) and r[0][i] <= t]
    right = [r for r in data if not null(r[0][i]) and r[0][i] > t]
    (left if len(left) >= len(right) else right).extend(r for r in data if null(r[0][i]))
    return (brute_tree(left, depth - 1, features, classes, criterion, min_leaf)
            + brute_tree(right, depth - 1, features, classes, criterion, min_leaf))


def leaf_counts(model: TreeModel):
    def walk(i):
        kids = model.children(i)
        return [c for k in kids for c in walk(k.node_id)] if kids else [model.nodes[i].counts]
    return walk(0)


@pytest.mark.parametrize("bucket_values", [10 ** 6, 9])
def test_grown_tree_equals_brute_force(random_200, random_rows, bucket_values):
    m = G.fit(random_200, ["a", "b"], "y3", criterion="gini", max_depth=4, min_samples_leaf=3, bucket_values=bucket_values, buckets=8)
    want = brute_tree([((r[1], r[2]), r[5]) for r in random_rows], 4, 2, ["hi", "lo", "mid"], "gini", 3)
    assert leaf_counts(m) == [tuple(map(float, c)) for c in want]


def test_partitioning_does_not_change_the_tree(random_200):
    args = dict(criterion="entropy", max_depth=4, min_samples_leaf=2)
    base = G.fit(random_200, ["a", "b", "c", "d"], "y", **args).rows()
    for n in (1, 7, 64):
        assert G.fit(random_200.orderBy(F.rand(3)).repartition(n), ["a", "b", "c", "d"], "y", **args).rows() == base


def test_routing_by_case_and_by_level_agree(random_200, monkeypatch):
    args = dict(max_depth=5, criterion="gini")
    m = G.fit(random_200, ["a", "b", "c", "d"], "y3", **args)
    both = S.assign_leaf(S.assign_leaf(random_200, m, "p"), m, "q", case_leaves=1)
    assert both.where("p <> q OR p IS NULL").count() == 0
    assert {r["p"]: r["count"] for r in both.groupBy("p").count().collect()} == {n.node_id: n.n for n in m.leaves()}
    monkeypatch.setattr(G, "CASE_LEAVES", 2)
    assert G.fit(random_200, ["a", "b", "c", "d"], "y3", **args).rows() == m.rows()
    assert all(m.nodes[n.parent_id].depth == n.depth - 1 for n in m.nodes.values() if n.parent_id is not None)


def test_rules_select_the_rows_of_the_leaf(random_200):
    m = G.fit(random_200, ["a", "b", "c"], "y", max_depth=3, min_samples_leaf=5)
    for leaf in m.leaves():
        assert E.node_rows(random_200, m, leaf.node_id).count() == leaf.n


def test_stop_rules(random_200):
    assert len(G.fit(random_200, ["b"], "y", growth="manual").nodes) == 1
    assert G.fit(random_200, ["a", "b"], "y", max_depth=6, growth="hybrid").depth <= 3
    assert len(G.fit(random_200, ["a", "b"], "y", max_leaf_nodes=5).leaves()) == 5
    assert all(n.n >= 20 for n in G.fit(random_200, ["a", "b", "c"], "y", min_samples_leaf=20).leaves())
    assert len(G.fit(random_200, ["a"], "y", min_impurity_decrease=0.9).nodes) == 1
    m = G.fit(random_200, ["a", "b"], "y", min_samples_split=60, max_depth=8)
    assert all(n.n >= 60 for n in m.internal())


def test_class_weight_and_positive_class(random_200):
    m = G.fit(random_200, ["a"], "y", growth="manual", class_weight="balanced")
    assert m.nodes[0].counts[0] == pytest.approx(m.nodes[0].counts[1])
    assert m.positive == "1"
    assert positive_class(["N", "Y"]) == "Y" and positive_class(["a", "b", "c"]) == "c" and positive_class(["no", "maybe"], "no") == "no"
    with pytest.raises(ValueError):
        positive_class(["a", "b"], "z")


def test_missing_policies(random_200):
    n = random_200.where("a IS NOT NULL AND NOT isnan(a) AND c IS NOT NULL").count()
    assert G.fit(random_200, ["a", "c"], "y", growth="manual", missing="drop").nodes[0].n == n
    m = G.fit(random_200, ["c"], "y", missing="category", max_depth=1)
    assert "Missing" in dict(m.nodes[0].split.categories)
    assert S.assign_leaf(random_200, m).groupBy("leaf_id").count().count() == 2
    assert G.fit(random_200, ["a"], "y", missing="median", max_depth=1).nodes[0].n == 200


def test_max_features_is_seeded(random_200):
    args = dict(max_features=1, max_depth=3, min_samples_leaf=5)
    assert G.fit(random_200, ["a", "b", "c"], "y", seed=1, **args).rows() == G.fit(random_200, ["a", "b", "c"], "y", seed=1, **args).rows()


def test_degenerate_inputs(spark, random_200):
    one = spark.createDataFrame([(1.0, "a")] * 5, "x double, y string")
    assert len(G.fit(one, ["x"], "y").nodes) == 1
    flat = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (None, "a")], "x double, y string")
    assert len(G.fit(flat, ["x"], "y").nodes) == 1
    empty = spark.createDataFrame([(None, "a"), (None, "b")], "x double, y string")
    assert len(G.fit(empty, ["x"], "y").nodes) == 1
    with pytest.raises(ValueError, match="no rows"):
        G.fit(one.where("x > 5"), ["x"], "y")
    with pytest.raises(ValueError, match="over max_categories"):
        G.fit(random_200, ["c"], "y", max_categories=3)
    with pytest.raises(ValueError, match="more than 2 classes"):
        G.fit(random_200, ["a"], "y3", max_classes=2)
    with pytest.raises(ValueError, match="unknown criterion"):
        G.fit(random_200, ["a"], "y", criterion="chaos")


def test_feature_batches_give_the_same_split(random_200):
    one = G.fit(random_200, ["a", "b", "c", "d"], "y", max_depth=2, feature_batch=1)
    assert one.nodes == G.fit(random_200, ["a", "b", "c", "d"], "y", max_depth=2).nodes


def test_approximate_candidates_are_valid(random_200):
    m = G.fit(random_200, ["a", "b"], "y", candidates="approx", max_depth=2)
    assert E.validate_tree(m, random_200).where("NOT (counts_match AND children_add_up AND depth_ok AND children_ok)").count() == 0


# --- manual trees --------------------------------------------------------

@pytest.fixture(scope="module")
def demo(spark):
    """1000 people: income <= 50000 for 600, of the others 250 with credit score <= 700."""
    rows = [(30000.0 + i, 650.0, int(i < 200)) for i in range(600)]
    rows += [(60000.0 + i, 690.0 if i < 250 else 750.0, int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "income double, credit double, y int")


@pytest.fixture(scope="module")
def demo_tree(demo):
    m = G.fit(demo, ["income", "credit"], "y", criterion="gini", growth="manual")
    m = E.apply_split(m, demo, 0, Split("income", "numeric", "<=", 50000.0))
    return E.apply_split(m, demo, 2, Split("credit", "numeric", "<=", 700.0))


def test_demo_counts(demo_tree):
    assert [demo_tree.nodes[i].n for i in range(5)] == [1000, 600, 400, 250, 150]
    assert demo_tree.path(4) == "x/2/2" and demo_tree.path(0) == "x0"
    assert demo_tree.nodes[1].counts == (400.0, 200.0)


def test_manual_split_errors(demo, demo_tree):
    with pytest.raises(ValueError, match="already split"):
        E.apply_split(demo_tree, demo, 0, Split("credit", "numeric", "<=", 1.0))
    with pytest.raises(ValueError, match="fewer than"):
        E.apply_split(demo_tree, demo, 1, Split("income", "numeric", "<=", 1.0))
    with pytest.raises(ValueError):
        Split("income", "numeric", "=", 1.0)
    with pytest.raises(ValueError, match="ascend"):
        Split("income", "numeric_multi_bin", thresholds=(2.0, 1.0))


def test_nulls_and_unseen_categories(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("c", 1), (None, 0), ("c", 0)], "c string, y int")
    root = G.fit(df, ["c"], "y", growth="manual")
    m = E.apply_split(root, df, 0, Split("c", "categorical", categories=(("a", 0), ("b", 1))))
    assert [n.n for n in m.children(0)] == [2, 4]       # unlisted and NULL go right
    wide = E.apply_split(root, df, 0, Split("c", "categorical_multi_bin", categories=(("a", 0), ("b", 1), ("c", 2))))
    assert [n.n for n in wide.children(0)] == [3, 1, 2]  # NULL goes to the first largest child
    assert S.assign_leaf(spark.createDataFrame([("zzz",), (None,)], "c string"), m).select("leaf_id").distinct().collect()[0][0] == 2


def test_multi_bin_is_left_closed(spark):
    df = spark.createDataFrame([(float(v), v % 2) for v in range(6)], "x double, y int")
    m = E.apply_split(G.fit(df, ["x"], "y", growth="manual"), df, 0, Split("x", "numeric_multi_bin", thresholds=(2.0, 4.0)))
    assert [n.n for n in m.children(0)] == [2, 2, 2]
    assert m.rule(2) == "x >= 2.0 AND x < 4.0"


def test_prune_folds(demo, demo_tree):
    path = P.prune_path(demo_tree)
    assert [len(t.leaves()) for _, t in path] == [3, 2]
    assert len(P.prune_cc(demo_tree, demo, alpha=1.0).leaves()) == 2
    assert len(P.prune_cc(demo_tree, demo, alpha=0.0).leaves()) == 3
    small = P.prune_reduced_error(demo_tree, demo)
    assert set(small.nodes) <= set(demo_tree.nodes) and len(small.leaves()) == 2     # both sides predict 0
    assert len(P.prune_error_based(demo_tree, demo, 0.95).leaves()) == 2
    best, trials = P.prune_cc_search(demo_tree, demo)
    assert trials.count() == 20 and len(best.leaves()) in (2, 3)


def test_save_and_load(spark, demo, demo_tree, tmp_path):
    writers.save_model(demo_tree, spark, str(tmp_path / "m"))
    again = writers.load_model(spark, str(tmp_path / "m"))
    assert again.rows() == demo_tree.rows() and again.positive == demo_tree.positive
    cats = G.fit(demo.withColumn("k", F.when(F.col("credit") > 700, "hi").otherwise("lo")), ["k"], "y", max_depth=1)
    writers.save_model(cats, spark, str(tmp_path / "n"))
    assert writers.load_model(spark, str(tmp_path / "n")).rows() == cats.rows()
    writers.save_node_table(demo_tree, spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_cross_validation_equals_separate_fits(random_200):
    args = dict(criterion="gini", max_depth=2, min_samples_leaf=3)
    got = {r["fold"]: r["correct"] for r in V.cross_validate(random_200, ["a", "b", "c"], "y", ["id"], k=3, **args).collect()}
    folds = V.assign_folds(random_200, "y", ["id"], 3).persist()
    for f in range(3):
        m = G.fit(folds.where(F.col("fold") != f), ["a", "b", "c"], "y", **args)
        scored = S.predict(folds.where(F.col("fold") == f), m)
        assert scored.where(F.col("prediction") == F.col("y").cast("string")).count() == got[f]
    sizes = [r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 2


def test_a_large_wide_table_is_neither_dealt_nor_kept(spark, monkeypatch):
    """Split search over many features of a table that is not small: the same rows, no exchange of them, none persisted."""
    from timberline import core
    df = spark.range(4000).selectExpr("CAST(id % 3 = 0 AS int) AS y", *[f"CAST((id + {i}) % ({i} + 2) != 0 AS int) AS f{i}" for i in range(20)],
                                      "IF(id % 7 = 0, NULL, id * 37 % 1009) AS many")
    features = [*[f"f{i}" for i in range(20)], "many"]
    kw = {"criterion": "gini", "bucket_values": 100, "buckets": 16}
    want = sorted(map(str, G.best_numeric_split(df, features, "y", **kw).collect()))
    assert core.SPREAD_BYTES <= 1 << 26
    dealt, kept = [], []
    frame = type(df)
    monkeypatch.setattr(G, "is_small", lambda d: False)
    monkeypatch.setattr(core, "is_small", lambda *a: False)
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(self) or self)
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a: kept.append(self.columns) or persist(self, *a))
    assert sorted(map(str, G.best_numeric_split(df, features, "y", **kw).collect())) == want
    assert not dealt and not [c for c in kept if "f0" in c]
