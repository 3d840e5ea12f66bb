"""Split search, growing, manual splits, pruning, scoring."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.core import checkpoint_dir, local_table
from timberline.operators import edit as E
from timberline.operators import grow as G
from timberline.operators import pruning as P
from timberline.operators import reports as N
from timberline.operators import scoring as S
from timberline.plans.tree import Split, TreeModel
from timberline.sources import writers
from workload.base import CREDIT, CREDIT_NULL, DOCS, PARTS, credit, credit_null, docs, parts, query, table

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def gini(*c: str) -> str:
    n = "(" + " + ".join(c) + ")"
    return f"(1 - ({' + '.join(f'power({x}, 2)' for x in c)}) / power({n}, 2))"


def entropy(*c: str) -> str:
    n = "(" + " + ".join(c) + ")"
    return "(" + " + ".join(f"CASE WHEN {x} > 0 THEN -{x} / {n} * log2({x} / {n}) ELSE 0 END" for x in c) + ")"


def misclassification(*c: str) -> str:
    return f"(1 - GREATEST({', '.join(c)}) / ({' + '.join(c)}))"


def gain_sql(k: int, imp) -> str:
    l, r, t = ([f"{s}{i}" for i in range(k)] for s in "lrt")
    nl, nr = " + ".join(l), " + ".join(r)
    return f"{imp(*t)} - ({nl}) / ({nl} + {nr}) * {imp(*l)} - ({nr}) / ({nl} + {nr}) * {imp(*r)}"


def numeric_sql(f: str, t: str, classes=("y = 0", "y = 1"), imp=gini, weight: str = "1", min_leaf: float = 1) -> str:
    """Best threshold of one feature by trying the midpoint of every two neighbours."""
    k = len(classes)
    sums = ", ".join(f"SUM(CASE WHEN {c} THEN {weight} ELSE 0 END)::DOUBLE AS c{i}" for i, c in enumerate(classes))
    run = ", ".join(f"SUM(c{i}) OVER w AS l{i}, SUM(c{i}) OVER () AS t{i}" for i in range(k))
    right = ", ".join(f"t{i} - l{i} AS r{i}" for i in range(k))
    nl, nr = " + ".join(f"l{i}" for i in range(k)), " + ".join(f"r{i}" for i in range(k))
    return f"""(SELECT '{f}' AS feature, threshold, {nl} AS n_left, {nr} AS n_right, {gain_sql(k, imp)} AS gain, {nl} AS _nl, {nr} AS _nr
    FROM (SELECT *, (v + nv) / 2 AS threshold, {right} FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nv, {run}
      FROM (SELECT {f} AS v, {sums} FROM {t} WHERE {f} IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)))
    WHERE nv IS NOT NULL AND {nl} >= {min_leaf} AND {nr} >= {min_leaf} ORDER BY ROUND(gain, 12) DESC, threshold LIMIT 1)"""


SPLIT_COLS = "feature, threshold, n_left, n_right, gain"


def numeric_union(features, *a, **kw) -> str:
    return " UNION ALL ".join(f"SELECT {SPLIT_COLS} FROM {numeric_sql(f, *a, **kw)}" for f in features)


def splits_of(df: DataFrame, features, target, **kw) -> DataFrame:
    return G.split_table(df, list(features), target, **kw).select("feature", "threshold", "n_left", "n_right", "gain")


@query("best_numeric_split", numeric_union(FEATURES, CREDIT), "threshold gain", digits=10)
def best_numeric_split(spark, sf):
    return splits_of(credit(spark, sf), FEATURES, "y", criterion="gini")


@query("best_numeric_split_entropy", numeric_union(FEATURES, CREDIT, imp=entropy), "threshold gain", digits=10)
def best_numeric_split_entropy(spark, sf):
    return splits_of(credit(spark, sf), FEATURES, "y", criterion="entropy")


@query("best_numeric_split_misclassification", numeric_union(("n_chars",), DOCS, ("toxic = 0", "toxic = 1"), misclassification), "threshold gain", digits=10)
def best_numeric_split_misclassification(spark, sf):
    return splits_of(docs(spark, sf), ("n_chars",), "toxic", criterion="misclassification")


@query("best_numeric_split_multiclass", numeric_union(FEATURES, "lineitem", tuple(f"l_returnflag = '{c}'" for c in "ANR"), entropy), "threshold gain", digits=10)
def best_numeric_split_multiclass(spark, sf):
    return splits_of(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")


@query("best_numeric_split_nulls", numeric_union(("l_quantity", "l_linenumber", "l_tax"), CREDIT_NULL), "threshold gain", digits=10)
def best_numeric_split_nulls(spark, sf):
    return splits_of(credit_null(spark, sf), ("l_quantity", "l_linenumber", "l_tax"), "y", criterion="gini")


@query("best_numeric_split_min_leaf", numeric_union(FEATURES, CREDIT, min_leaf=5000), "threshold gain", digits=10)
def best_numeric_split_min_leaf(spark, sf):
    return splits_of(credit(spark, sf), FEATURES, "y", criterion="gini", min_samples_leaf=5000)


@query("best_numeric_split_weighted", numeric_union(FEATURES, CREDIT, weight="l_linenumber"), "threshold gain", digits=10)
def best_numeric_split_weighted(spark, sf):
    return splits_of(credit(spark, sf), FEATURES, "y", criterion="gini", weight_col="l_linenumber")


@query("best_numeric_split_bucketed", numeric_union(FEATURES, CREDIT), "threshold gain", digits=10)
def best_numeric_split_bucketed(spark, sf):
    """The same search by value buckets with gain bounds (the path for features with many values)."""
    return splits_of(credit(spark, sf), FEATURES, "y", criterion="gini", bucket_values=20, buckets=300)


DIMS = tuple(f"d{i}" for i in range(64))


@query("best_numeric_split_embeddings", numeric_union(DIMS, f"(SELECT label, {', '.join(f'embedding[{i + 1}]::DOUBLE AS {d}' for i, d in enumerate(DIMS))} FROM embeddings)",
                                                      tuple(f"label = {c}" for c in range(10)), gini), "threshold gain", digits=9)
def best_numeric_split_embeddings(spark, sf):
    df = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])
    return splits_of(df, DIMS, "label", criterion="gini")


BALANCED = f"(SELECT COUNT(*) / (2.0::DOUBLE * COUNT(*) FILTER (toxic = 1)) AS w1, COUNT(*) / (2.0::DOUBLE * COUNT(*) FILTER (toxic = 0)) AS w0 FROM {DOCS})"


@query("best_numeric_split_balanced", f"SELECT feature, threshold, gain FROM {numeric_sql('n_chars', f'(SELECT * FROM {DOCS}, {BALANCED})', ('toxic = 0', 'toxic = 1'), gini, 'CASE toxic WHEN 1 THEN w1 ELSE w0 END')}", "gain")
def best_numeric_split_balanced(spark, sf):
    return splits_of(docs(spark, sf), ("n_chars",), "toxic", criterion="gini", class_weight="balanced").select("feature", "threshold", "gain")


def approx_sql(f: str, t: str) -> str:
    """At most 50 midpoints, evenly spaced over the distinct values."""
    grid = f"""(SELECT (v + nv) / 2 AS threshold FROM (SELECT {f} AS v, lead({f}) OVER (ORDER BY {f}) AS nv, row_number() OVER (ORDER BY {f}) - 1 AS i, COUNT(*) OVER () AS d
      FROM (SELECT DISTINCT {f} FROM {t})) WHERE i IN (SELECT CAST(trunc(j * (d - 2) / (LEAST(50, d - 1) - 1)) AS BIGINT) FROM
      (SELECT unnest(range(50)) AS j, (SELECT COUNT(DISTINCT {f}) FROM {t}) AS d) WHERE j < LEAST(50, d - 1)))"""
    return f"""(SELECT '{f}' AS feature, threshold, n_left, n_right, gain FROM (SELECT *, l0 + l1 AS n_left, r0 + r1 AS n_right, {gain_sql(2, gini)} AS gain FROM (
      SELECT threshold, COUNT(*) FILTER ({f} <= threshold AND y = 0)::DOUBLE AS l0, COUNT(*) FILTER ({f} <= threshold AND y = 1)::DOUBLE AS l1,
             COUNT(*) FILTER ({f} > threshold AND y = 0)::DOUBLE AS r0, COUNT(*) FILTER ({f} > threshold AND y = 1)::DOUBLE AS r1,
             COUNT(*) FILTER (y = 0)::DOUBLE AS t0, COUNT(*) FILTER (y = 1)::DOUBLE AS t1
      FROM {t}, {grid} GROUP BY threshold)) ORDER BY ROUND(gain, 12) DESC, threshold LIMIT 1)"""


@query("best_numeric_split_approx", " UNION ALL ".join(f"SELECT * FROM {approx_sql(f, CREDIT)}" for f in ("l_extendedprice", "l_discount")), "threshold gain", digits=9)
def best_numeric_split_approx(spark, sf):
    return splits_of(credit(spark, sf), ("l_extendedprice", "l_discount"), "y", criterion="gini", candidates="approx")


def categorical_sql(f: str, t: str, y: str = "y", single: bool = False) -> str:
    """Every prefix of the categories by positive share (and every single one)."""
    extra = f"UNION ALL SELECT [v] AS cats, c0 AS l0, c1 AS l1, t0, t1, 1 AS how, rn FROM o" if single else ""
    return f"""(WITH h AS (SELECT {f} AS v, COUNT(*) FILTER ({y} = 0)::DOUBLE AS c0, COUNT(*) FILTER ({y} = 1)::DOUBLE AS c1 FROM {t} GROUP BY 1),
    o AS (SELECT *, row_number() OVER w AS rn, COUNT(*) OVER () AS k, SUM(c0) OVER () AS t0, SUM(c1) OVER () AS t1,
                 SUM(c0) OVER w AS l0, SUM(c1) OVER w AS l1, list(v) OVER w AS cats FROM h WINDOW w AS (ORDER BY c1 / (c0 + c1), v ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT cats, l0, l1, t0, t1, 0 AS how, rn FROM o WHERE rn < k {extra})
    SELECT '{f}' AS feature, array_to_string(list_sort(cats), ',') AS left_side, l0 + l1 AS n_left, r0 + r1 AS n_right, {gain_sql(2, gini)} AS gain
    FROM (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM p) ORDER BY ROUND(gain, 12) DESC, how, rn LIMIT 1)"""


def category_splits(df, features, target, **kw):
    return G.best_categorical_split(df, list(features), target, criterion="gini", **kw).select(
        "feature", F.array_join("left_categories", ",").alias("left_side"), "n_left", "n_right", "gain")


@query("best_categorical_split", f"SELECT * FROM {categorical_sql('p_brand', PARTS)} UNION ALL SELECT * FROM {categorical_sql('p_type', PARTS)}", "gain", digits=10)
def best_categorical_split(spark, sf):
    return category_splits(parts(spark, sf), ("p_brand", "p_type"), "y")


@query("best_categorical_split_one_vs_rest", f"SELECT * FROM {categorical_sql('p_brand', PARTS, single=True)}", "gain", digits=10)
def best_categorical_split_one_vs_rest(spark, sf):
    return category_splits(parts(spark, sf), ("p_brand",), "y", category_search="one_vs_rest")


K4 = "(SELECT event_type, CAST(user_id % 4 AS INT) AS y FROM events)"


@query("best_categorical_split_exhaustive", f"""
    WITH h AS (SELECT event_type AS v, {', '.join(f'COUNT(*) FILTER (y = {i})::DOUBLE AS c{i}' for i in range(4))} FROM {K4} GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS i FROM h), m AS (SELECT unnest(range(1, 16)) AS mask),
    s AS (SELECT mask, {', '.join(f'SUM(CASE WHEN (mask >> i) & 1 = 1 THEN c{i_} ELSE 0 END) AS l{i_}' for i_ in range(4))},
                 {', '.join(f'SUM(c{i_}) AS t{i_}' for i_ in range(4))} FROM o, m GROUP BY mask),
    r AS (SELECT *, {', '.join(f't{i} - l{i} AS r{i}' for i in range(4))} FROM s)
    SELECT 'event_type' AS feature, MAX({gain_sql(4, gini)}) AS gain FROM r""", "gain", digits=10)
def best_categorical_split_exhaustive(spark, sf):
    df = table(spark, sf, "events").select("event_type", (F.col("user_id") % 4).cast("int").alias("y"))
    return G.best_categorical_split(df, ["event_type"], "y", criterion="gini").select("feature", "gain")


@query("split_candidates", f"""
    SELECT * FROM ({numeric_union(FEATURES, f"(SELECT * FROM {CREDIT} WHERE l_quantity > 24.5)")}) ORDER BY ROUND(gain, 12) DESC LIMIT 3""", "threshold gain", digits=10)
def split_candidates(spark, sf):
    """Ranked splits at one node of a model: the rows with more than 24.5 pieces."""
    df = credit(spark, sf)
    model = fixed_tree(spark, sf)
    return G.split_candidates(df, TreeModel(model.nodes, model.classes, model.positive, "y", tuple((f, "numeric") for f in FEATURES), "gini"),
                              2, top=3).select("feature", "threshold", "n_left", "n_right", "gain")


@query("suggest_splits", """
    SELECT 'o_totalprice' AS feature, 'numeric' AS split_type, m AS threshold, NULL::VARCHAR AS category,
           COUNT(*) FILTER (o_totalprice <= m) AS n_left, COUNT(*) FILTER (o_totalprice > m) AS n_right
    FROM orders, (SELECT median(o_totalprice) AS m FROM orders) GROUP BY m
    UNION ALL SELECT 'o_orderpriority', 'categorical', NULL, c, COUNT(*) FILTER (o_orderpriority = c), COUNT(*) FILTER (o_orderpriority <> c)
    FROM orders, (SELECT o_orderpriority AS c FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) GROUP BY c""", "threshold")
def suggest_splits(spark, sf):
    return G.suggest_splits(table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority"], "o_orderstatus")


def screen_sql(f: str, left: str, thr: str) -> str:
    return f"""SELECT '{f}' AS feature, {thr} AS threshold, (l0 + l1)::BIGINT AS n_left, (r0 + r1)::BIGINT AS n_right, {gain_sql(2, gini)} AS gain FROM
      (SELECT *, l0 + r0 AS t0, l1 + r1 AS t1 FROM (SELECT COUNT(*) FILTER ({left} AND y = 0)::DOUBLE AS l0, COUNT(*) FILTER ({left} AND y = 1)::DOUBLE AS l1,
       COUNT(*) FILTER (NOT ({left}) AND y = 0)::DOUBLE AS r0, COUNT(*) FILTER (NOT ({left}) AND y = 1)::DOUBLE AS r1 FROM {PARTS}))"""


@query("quick_screen", f"""
    SELECT * FROM ({screen_sql('p_size', 'p_size <= (SELECT median(p_size) FROM part)', '(SELECT median(p_size) FROM part)')}
    UNION ALL {screen_sql('p_brand', 'p_brand IN (SELECT p_brand FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS i FROM (SELECT DISTINCT p_brand FROM part)) WHERE i <= (SELECT COUNT(DISTINCT p_brand) // 2 FROM part))', 'NULL')}
    UNION ALL {screen_sql('p_type', 'p_type IN (SELECT p_type FROM (SELECT p_type, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part)) WHERE i <= (SELECT COUNT(DISTINCT p_type) // 2 FROM part))', 'NULL')})
    WHERE gain > 0""", "threshold gain", digits=10)
def quick_screen(spark, sf):
    return G.quick_screen(parts(spark, sf), ["p_size", "p_brand", "p_type"], "y")


# --- growing -------------------------------------------------------------

def grow_sql(base: str, features, depth: int, imp=gini, min_leaf: int = 1, drawn: str | None = None) -> str:
    """Level by level in SQL: histogram, prefix sums, best split, next assignment.

    ``drawn`` lists the features (by position) each of the nodes 0, 1, 2 may use.
    """
    only = f" AND (CASE path WHEN 'x' THEN 0 WHEN 'x/1' THEN 1 ELSE 2 END, f) IN {drawn}" if drawn else ""
    unpivot = " UNION ALL ".join(f"SELECT rid, {i} AS f, {f}::DOUBLE AS v FROM base" for i, f in enumerate(features))
    ctes = [f"base AS (SELECT row_number() OVER () AS rid, * FROM {base})", f"long AS ({unpivot})",
            "n0 AS (SELECT rid, y, 'x' AS path FROM base)"]
    for d in range(depth):
        ctes += [
            f"h{d} AS (SELECT path, f, v, SUM(1 - y)::DOUBLE AS c0, SUM(y)::DOUBLE AS c1 FROM n{d} JOIN long USING (rid) GROUP BY ALL)",
            f"""p{d} AS (SELECT *, (v + lead(v) OVER w) / 2 AS thr, SUM(c0) OVER w AS l0, SUM(c1) OVER w AS l1,
                SUM(c0) OVER (PARTITION BY path, f) AS t0, SUM(c1) OVER (PARTITION BY path, f) AS t1 FROM h{d}
                WINDOW w AS (PARTITION BY path, f ORDER BY v ROWS UNBOUNDED PRECEDING))""",
            f"""g{d} AS (SELECT *, {gain_sql(2, imp)} AS gain FROM (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM p{d})
                WHERE thr IS NOT NULL AND l0 + l1 >= {min_leaf} AND r0 + r1 >= {min_leaf}{only})""",
            f"""b{d} AS (SELECT path, f, thr, t0 + t1 AS n FROM g{d} WHERE gain > 0
                QUALIFY row_number() OVER (PARTITION BY path ORDER BY ROUND(gain, 12) DESC, f, thr) = 1)""",
            f"""n{d + 1} AS (SELECT a.rid, a.y, a.path || CASE WHEN l.v <= b.thr THEN '/1' ELSE '/2' END AS path
                FROM n{d} a JOIN b{d} b USING (path) JOIN long l ON l.rid = a.rid AND l.f = b.f)"""]
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    out = " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(depth))
    return f"WITH {', '.join(ctes)} SELECT CASE WHEN path = 'x' THEN 'x0' ELSE path END AS path, {names}[f + 1] AS split_feature, thr AS split_value, n FROM ({out})"


def internal(model: TreeModel, spark) -> DataFrame:
    return model.to_df(spark).where("NOT is_terminal").select("path", "split_feature", "split_value", "n")


@query("grow_depth3", grow_sql(CREDIT, FEATURES, 3, min_leaf=200), "split_value", digits=9)
def grow_depth3(spark, sf):
    return internal(G.fit(credit(spark, sf), FEATURES, "y", criterion="gini", max_depth=3, min_samples_leaf=200), spark)


@query("grow_depth2_entropy", grow_sql(PARTS, ("p_size", "p_partkey"), 2, entropy, 50), "split_value", digits=9)
def grow_depth2_entropy(spark, sf):
    return internal(G.fit(parts(spark, sf), ("p_size", "p_partkey"), "y", max_depth=2, min_samples_leaf=50), spark)


@query("grow_hybrid", grow_sql(CREDIT, FEATURES, 1), "split_value", digits=9)
def grow_hybrid(spark, sf):
    """Half of max_depth automatically, the rest left for manual splits."""
    return internal(G.fit(credit(spark, sf), FEATURES, "y", criterion="gini", max_depth=2, growth="hybrid"), spark)


@query("grow_max_leaf_nodes", f"SELECT 4::BIGINT AS leaves, COUNT(*)::DOUBLE AS n FROM {CREDIT}")
def grow_max_leaf_nodes(spark, sf):
    m = G.fit(credit(spark, sf), FEATURES, "y", criterion="gini", max_depth=3, min_samples_leaf=100, max_leaf_nodes=4)
    return m.to_df(spark).where("is_terminal").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("n"))


@query("grow_mixed_features", f"SELECT COUNT(*)::DOUBLE AS n, SUM(toxic)::DOUBLE AS positives FROM {DOCS}")
def grow_mixed_features(spark, sf):
    """Numeric and categorical features, unequal classes: leaves hold every row once."""
    m = G.fit(docs(spark, sf), ["n_chars", "lang", "source"], "toxic", max_depth=3, min_samples_leaf=5)
    return m.to_df(spark).where("is_terminal").agg(
        F.sum("n").alias("n"), F.sum(F.element_at("class_counts", F.lit("1"))).alias("positives"))


DRAWN = "(SELECT nid, f FROM (SELECT nid, f, row_number() OVER (PARTITION BY nid ORDER BY md5(concat_ws('|', 42, 0, nid, f))) AS i FROM (SELECT unnest(range(3)) AS nid), (SELECT unnest(range(4)) AS f)) WHERE i <= 2)"


@query("grow_max_features", grow_sql(CREDIT, FEATURES, 2, min_leaf=200, drawn=DRAWN), "split_value", digits=9)
def grow_max_features(spark, sf):
    """Two features drawn per node (seeded, so the tree is reproducible)."""
    return internal(G.fit(credit(spark, sf), FEATURES, "y", criterion="gini", max_depth=2, max_features=2, min_samples_leaf=200), spark)


# --- the fixed tree ------------------------------------------------------

_TREES: dict[tuple, TreeModel] = {}

LEAF = """CAST(CASE WHEN l_quantity <= 24.5 THEN CASE WHEN l_linestatus = 'O' THEN 3 ELSE 4 END
  WHEN l_extendedprice < 40000 THEN 5 WHEN l_extendedprice < 70000 THEN 6 ELSE 7 END AS BIGINT)"""


def fixed_tree(spark: SparkSession, sf: str, target: str = "y") -> TreeModel:
    """Quantity, then line status or price in three bins — split by hand, counted on the data."""
    key = (spark.sparkContext.applicationId, sf, target)
    if key not in _TREES:
        df = credit(spark, sf)
        m = G.fit(df, ["l_quantity", "l_linestatus", "l_extendedprice", "l_discount"], target, criterion="gini", growth="manual")
        m = E.apply_split(m, df, 0, Split("l_quantity", "numeric", "<=", 24.5))
        m = E.apply_split(m, df, 1, Split("l_linestatus", "categorical", categories=(("O", 0), ("F", 1))))
        _TREES[key] = E.apply_split(m, df, 2, Split("l_extendedprice", "numeric_multi_bin", thresholds=(40000.0, 70000.0)))
    return _TREES[key]


@query("apply_split_tree", f"""
    WITH r AS (SELECT *, {LEAF} AS leaf FROM {CREDIT}),
    a AS (SELECT leaf AS node_id, y FROM r UNION ALL SELECT 0, y FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END, y FROM r)
    SELECT node_id, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE / COUNT(*) AS p_positive, 2.0::DOUBLE * SUM(y) / COUNT(*) * (1 - SUM(y)::DOUBLE / COUNT(*)) AS impurity
    FROM a GROUP BY 1""", "p_positive impurity")
def apply_split_tree(spark, sf):
    return fixed_tree(spark, sf).to_df(spark).select("node_id", "n", "p_positive", "impurity")


@query("save_and_load_model", f"SELECT {LEAF} AS leaf_id, COUNT(*) AS n, SUM(y)::BIGINT AS positives FROM {CREDIT} GROUP BY 1")
def save_and_load_model(spark, sf):
    """The tree written as JSON, read back and used to route every row."""
    path = f"{checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    writers.save_model(fixed_tree(spark, sf), spark, path)
    routed = S.assign_leaf(credit(spark, sf), writers.load_model(spark, path))
    return routed.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("apply_split_operators", """
    SELECT op, SUM(CASE WHEN hit THEN 1 ELSE 0 END)::DOUBLE AS n_left, SUM(CASE WHEN hit THEN 0 ELSE 1 END)::DOUBLE AS n_right FROM (
      SELECT '<=' AS op, l_quantity <= 10 AS hit FROM lineitem UNION ALL SELECT '<', l_quantity < 10 FROM lineitem
      UNION ALL SELECT '>', l_quantity > 10 FROM lineitem UNION ALL SELECT '>=', l_quantity >= 10 FROM lineitem) GROUP BY op""")
def apply_split_operators(spark, sf):
    df = credit(spark, sf)
    root = G.fit(df, ["l_quantity"], "y", growth="manual")
    rows = []
    for op in ("<=", "<", ">", ">="):
        kids = E.apply_split(root, df, 0, Split("l_quantity", "numeric", op, 10.0)).children(0)
        rows.append({"op": op, "n_left": kids[0].n, "n_right": kids[1].n})
    return local_table(spark, rows, pa.schema([("op", pa.string()), ("n_left", pa.float64()), ("n_right", pa.float64())]))


@query("apply_split_nulls", f"""
    WITH b AS (SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 35 THEN 1 WHEN l_quantity IS NOT NULL THEN 2 END AS b FROM {CREDIT_NULL}),
    k AS (SELECT b, COUNT(*) AS n FROM b WHERE b IS NOT NULL GROUP BY b)
    SELECT COALESCE(b, (SELECT b FROM k ORDER BY n DESC, b LIMIT 1))::INT AS child_index, COUNT(*)::DOUBLE AS n FROM b GROUP BY 1""")
def apply_split_nulls(spark, sf):
    """Three-way numeric split: rows without a value join the largest child."""
    df = credit_null(spark, sf)
    root = G.fit(df, ["l_quantity"], "y", growth="manual")
    m = E.apply_split(root, df, 0, Split("l_quantity", "numeric_multi_bin", thresholds=(10.0, 35.0)))
    return m.to_df(spark).where("node_id > 0").select("child_index", "n")


@query("apply_split_categorical_multiway", """
    SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 0 WHEN p_type IN ('LARGE') THEN 1 ELSE 2 END AS child_index, COUNT(*)::DOUBLE AS n FROM part GROUP BY 1""")
def apply_split_categorical_multiway(spark, sf):
    df = parts(spark, sf)
    root = G.fit(df, ["p_type"], "y", growth="manual")
    cats = {"ECONOMY": 0, "SMALL": 0, "LARGE": 1, "MEDIUM": 2, "PROMO": 2, "STANDARD": 2}
    m = E.apply_split(root, df, 0, Split("p_type", "categorical_multi_bin", categories=tuple(cats.items())))
    return m.to_df(spark).where("node_id > 0").select("child_index", "n")


@query("validate_split", """
    SELECT 'l_quantity' AS feature, MIN(l_quantity) <= 24.5 AND MAX(l_quantity) >= 24.5 AS valid, '' AS problems FROM lineitem
    UNION ALL SELECT 'l_tax', FALSE, 'threshold_out_of_range'
    UNION ALL SELECT 'l_returnflag', FALSE, 'unlisted_categories'""")
def validate_split(spark, sf):
    df = credit(spark, sf)
    checks = [Split("l_quantity", "numeric", "<=", 24.5), Split("l_tax", "numeric", "<=", 7.0),
              Split("l_returnflag", "categorical", categories=(("R", 0), ("A", 1)))]
    return reduce(DataFrame.unionByName, [E.validate_split(df, s) for s in checks])


@query("validate_tree", f"""
    WITH r AS (SELECT {LEAF} AS leaf FROM lineitem), a AS (SELECT leaf AS node_id FROM r UNION ALL SELECT 0 FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END FROM r)
    SELECT node_id, COUNT(*)::DOUBLE AS stored_n, COUNT(*)::DOUBLE AS counted_n, TRUE AS counts_match, TRUE AS children_add_up, TRUE AS depth_ok,
           TRUE AS children_ok, FALSE AS is_empty FROM a GROUP BY 1""")
def validate_tree(spark, sf):
    return E.validate_tree(fixed_tree(spark, sf), credit(spark, sf))


@query("node_rows", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 24.5 AND l_extendedprice >= 40000 AND l_extendedprice < 70000")
def node_rows(spark, sf):
    return E.node_rows(credit(spark, sf), fixed_tree(spark, sf), 6).select("l_orderkey", "l_partkey", "l_linenumber")


@query("split_analysis", f"""
    WITH r AS (SELECT *, CASE WHEN l_extendedprice < 40000 THEN 0 WHEN l_extendedprice < 70000 THEN 1 ELSE 2 END AS child FROM {CREDIT} WHERE l_quantity > 24.5),
    c AS (SELECT child, COUNT(*) AS n, AVG(y) AS mean, stddev_samp(y) AS std, MIN(y)::DOUBLE AS min, MAX(y)::DOUBLE AS max, var_samp(y) AS v FROM r GROUP BY child)
    SELECT child, n, n * 100.0::DOUBLE / SUM(n) OVER () AS pct, (MIN(n) OVER ())::DOUBLE / MAX(n) OVER () AS balance, 2 * mean * (1 - mean) AS impurity,
           mean, std, min, max, (SELECT var_samp(y) FROM r) - (SELECT SUM(n * v) / SUM(n) FROM c) AS variance_reduction FROM c""",
       "pct balance impurity mean std min max variance_reduction")
def split_analysis(spark, sf):
    return E.split_analysis(credit(spark, sf), fixed_tree(spark, sf), 2).drop("class_counts")


# --- pruning -------------------------------------------------------------

NODES = f"""
    r AS (SELECT {LEAF} AS leaf, y FROM {CREDIT}), a AS (SELECT leaf AS node_id, y FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END, y FROM r UNION ALL SELECT 0, y FROM r),
    k AS (SELECT node_id, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p, 2 * AVG(y) * (1 - AVG(y)) AS imp FROM a GROUP BY 1),
    s AS (SELECT g AS node_id, ((SELECT imp FROM k WHERE node_id = g) - SUM(n * imp) / SUM(n)) / (COUNT(*) - 1) AS strength
          FROM (SELECT *, CASE WHEN node_id IN (3, 4) THEN 1 ELSE 2 END AS g FROM k WHERE node_id >= 3) GROUP BY g)"""


def leaves_of(model: TreeModel, spark) -> DataFrame:
    return model.to_df(spark).where("is_terminal").select("node_id", "n")


@query("prune_cc", f"""
    WITH {NODES}, m AS (SELECT (MIN(strength) + MAX(strength)) / 2 AS alpha FROM s)
    SELECT node_id, n FROM k WHERE node_id IN (SELECT node_id FROM s, m WHERE strength < alpha)
      OR (node_id >= 3 AND CASE WHEN node_id IN (3, 4) THEN 1 ELSE 2 END IN (SELECT node_id FROM s, m WHERE strength >= alpha))""")
def prune_cc(spark, sf):
    model = fixed_tree(spark, sf)
    alpha = (P.link_strength(model, 1) + P.link_strength(model, 2)) / 2
    return leaves_of(P.prune_cc(model, credit(spark, sf), alpha), spark)


@query("prune_path", f"""
    WITH {NODES}, o AS (SELECT *, row_number() OVER (ORDER BY strength) AS step FROM s)
    SELECT 0 AS step, 0.0::DOUBLE AS alpha, 5::BIGINT AS leaves, 8::BIGINT AS nodes
    UNION ALL SELECT step::INT, strength, CASE WHEN step = 2 THEN 2 WHEN node_id = 1 THEN 4 ELSE 3 END, CASE WHEN step = 2 THEN 3 WHEN node_id = 1 THEN 6 ELSE 5 END FROM o""",
       "alpha", digits=10)
def prune_path(spark, sf):
    return P.path_table(spark, P.prune_path(fixed_tree(spark, sf), credit(spark, sf)))


ALPHAS = "(SELECT power(10, -10 + 10.0::DOUBLE * i / 19) AS alpha FROM (SELECT unnest(range(20)) AS i))"


@query("prune_cc_search", f"""
    WITH {NODES}, hits AS (SELECT node_id, GREATEST(p, n - p) AS h FROM k)
    SELECT alpha, (CASE WHEN a1 THEN 1 ELSE 2 END + CASE WHEN a2 THEN 1 ELSE 3 END)::BIGINT AS leaves,
      ((CASE WHEN a1 THEN (SELECT h FROM hits WHERE node_id = 1) ELSE (SELECT SUM(h) FROM hits WHERE node_id IN (3, 4)) END)
       + (CASE WHEN a2 THEN (SELECT h FROM hits WHERE node_id = 2) ELSE (SELECT SUM(h) FROM hits WHERE node_id IN (5, 6, 7)) END)) / (SELECT n FROM k WHERE node_id = 0) AS accuracy
    FROM (SELECT alpha, (SELECT strength FROM s WHERE node_id = 1) < alpha AS a1, (SELECT strength FROM s WHERE node_id = 2) < alpha AS a2 FROM {ALPHAS})""",
       "alpha accuracy", digits=10)
def prune_cc_search(spark, sf):
    return P.prune_cc_search(fixed_tree(spark, sf), credit(spark, sf))[1]


TRAIN3 = f"""
    r AS (SELECT {LEAF} AS leaf, l_returnflag AS y, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, '7')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM lineitem),
    a AS (SELECT leaf AS node_id, * FROM r UNION ALL SELECT CASE WHEN leaf IN (3, 4) THEN 1 ELSE 2 END, * FROM r),
    k AS (SELECT node_id, y, COUNT(*)::DOUBLE AS n, COUNT(*) FILTER (u < 0.3)::DOUBLE AS v FROM a GROUP BY ALL),
    f AS (SELECT node_id, SUM(n) AS n, MAX(n) AS top, arg_min(y, (-n, y)) AS guess, SUM(v) AS v FROM k GROUP BY 1),
    w AS (SELECT f.*, COALESCE((SELECT k.v FROM k WHERE k.node_id = f.node_id AND k.y = f.guess), 0) AS vhit, CASE WHEN node_id IN (3, 4) THEN 1 WHEN node_id >= 5 THEN 2 END AS up FROM f)"""
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("prune_reduced_error", f"""
    WITH {TRAIN3}, c AS (SELECT p.node_id FROM w p WHERE p.node_id IN (1, 2) AND p.vhit >= (SELECT SUM(q.vhit) FROM w q WHERE q.up = p.node_id))
    SELECT node_id, n FROM w WHERE node_id IN (SELECT node_id FROM c) OR (up IS NOT NULL AND up NOT IN (SELECT node_id FROM c))""")
def prune_reduced_error(spark, sf):
    _, valid = P.holdout(credit(spark, sf), KEY, 0.3, 7)
    return leaves_of(P.prune_reduced_error(fixed_tree(spark, sf, "l_returnflag"), valid), spark)


@query("prune_error_based", f"""
    WITH {TRAIN3}, c AS (SELECT p.node_id FROM w p WHERE p.node_id IN (1, 2) AND 1 - p.top / p.n + 0.674 * sqrt(0.25 / p.n)
      <= (SELECT SUM(q.v * (1 - q.vhit / q.v + 0.674 * sqrt(0.25 / q.v))) / SUM(q.v) FROM w q WHERE q.up = p.node_id))
    SELECT node_id, n FROM w WHERE node_id IN (SELECT node_id FROM c) OR (up IS NOT NULL AND up NOT IN (SELECT node_id FROM c))""")
def prune_error_based(spark, sf):
    _, valid = P.holdout(credit(spark, sf), KEY, 0.3, 7)
    return leaves_of(P.prune_error_based(fixed_tree(spark, sf, "l_returnflag"), valid, 0.5), spark)


# --- scoring -------------------------------------------------------------

@query("assign_leaf", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {LEAF} AS leaf_id FROM lineitem")
def assign_leaf(spark, sf):
    return S.assign_leaf(credit(spark, sf), fixed_tree(spark, sf)).select(*KEY, "leaf_id")


@query("assign_leaf_by_level", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {LEAF} AS leaf_id FROM lineitem")
def assign_leaf_by_level(spark, sf):
    """The route for trees with many leaves: one broadcast join per level."""
    return S.assign_leaf(credit(spark, sf), fixed_tree(spark, sf), case_leaves=1).select(*KEY, "leaf_id")


@query("predict_class", f"""
    WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, {LEAF} AS leaf FROM lineitem),
    m AS (SELECT leaf, arg_min(y, (-n, y)) AS prediction FROM (SELECT leaf, l_returnflag AS y, COUNT(*) AS n FROM r GROUP BY ALL) GROUP BY leaf)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, prediction FROM r JOIN m USING (leaf)""")
def predict_class(spark, sf):
    return S.predict(credit(spark, sf), fixed_tree(spark, sf, "l_returnflag")).select(*KEY, "prediction")


@query("predict_threshold", f"""
    WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y, {LEAF} AS leaf FROM {CREDIT}),
    m AS (SELECT leaf, AVG(y) AS p FROM r GROUP BY leaf)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p, CASE WHEN p >= 0.334 THEN '1' ELSE '0' END AS prediction FROM r JOIN m USING (leaf)""", "p")
def predict_threshold(spark, sf):
    return S.predict(credit(spark, sf), fixed_tree(spark, sf), 0.334).select(*KEY, "p", "prediction")


@query("predict_proba", f"""
    WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS y, {LEAF} AS leaf FROM lineitem),
    m AS (SELECT leaf, AVG((y = 'A')::INT) AS "p_A", AVG((y = 'N')::INT) AS "p_N", AVG((y = 'R')::INT) AS "p_R" FROM r GROUP BY leaf)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "p_A", "p_N", "p_R" FROM r JOIN m USING (leaf)""", "p_A p_N p_R")
def predict_proba(spark, sf):
    return S.predict_proba(credit(spark, sf), fixed_tree(spark, sf, "l_returnflag")).select(*KEY, "p_A", "p_N", "p_R")


@query("score", f"""
    WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, y, {LEAF} AS leaf_id FROM {CREDIT}), m AS (SELECT leaf_id, AVG(y) AS p FROM r GROUP BY 1),
    t AS (SELECT * FROM (VALUES (3, 'x/1/1', 'l_quantity <= 24.5 AND l_linestatus IN (''O'')'), (4, 'x/1/2', 'l_quantity <= 24.5 AND (l_linestatus NOT IN (''O'') OR l_linestatus IS NULL)'),
      (5, 'x/2/1', '(l_quantity > 24.5 OR l_quantity IS NULL) AND l_extendedprice < 40000.0'),
      (6, 'x/2/2', '(l_quantity > 24.5 OR l_quantity IS NULL) AND l_extendedprice >= 40000.0 AND l_extendedprice < 70000.0'),
      (7, 'x/2/3', '(l_quantity > 24.5 OR l_quantity IS NULL) AND l_extendedprice >= 70000.0')) v(leaf_id, path, base)),
    big AS (SELECT leaf_id AS b FROM r WHERE leaf_id >= 5 GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, leaf_id, path, p, CASE WHEN p > 0.5 THEN '1' ELSE '0' END AS prediction,
      CASE WHEN leaf_id = b THEN '(l_quantity > 24.5 OR l_quantity IS NULL) AND (' || substr(base, 47) || ' OR l_extendedprice IS NULL)' ELSE base END AS rule
    FROM r JOIN m USING (leaf_id) JOIN t USING (leaf_id), big""", "p")
def score(spark, sf):
    return S.score(credit(spark, sf), fixed_tree(spark, sf)).select(*KEY, "leaf_id", "path", "p", "prediction", "rule")


# --- typed features, many features, unseen classes -----------------------

def dated(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a date, a timestamp and a boolean feature; the target follows them."""
    return table(spark, sf, "lineitem").select(
        *KEY, F.col("l_shipdate").cast("date").alias("day"), F.col("l_shipdate").alias("moment"), (F.col("l_quantity") > 25).alias("big"),
        (F.col("l_shipdate") > F.lit("1997-03-01").cast("timestamp")).cast("int").alias("y"))


DATED = """(SELECT l_shipdate::DATE AS day, l_shipdate AS moment, l_quantity > 25 AS big, (l_shipdate > TIMESTAMP '1997-03-01')::INT AS y FROM lineitem)"""


def dated_tree(spark: SparkSession, sf: str) -> TreeModel:
    df = dated(spark, sf)
    m = G.fit(df, ["day", "moment", "big"], "y", criterion="gini", growth="manual")
    m = E.apply_split(m, df, 0, Split("day", "numeric", "<=", 852_076_800.0 + 43_200.0))  # noon of 1997-01-01
    m = E.apply_split(m, df, 1, Split("big", "numeric", "<=", 0.5))
    return E.apply_split(m, df, 2, Split("moment", "numeric_multi_bin", thresholds=(867_715_200.0, 883_612_800.0)))


DATED_LEAF = """CAST(CASE WHEN day <= DATE '1997-01-01' THEN CASE WHEN NOT big THEN 3 ELSE 4 END
  WHEN moment < TIMESTAMP '1997-07-01' THEN 5 WHEN moment < TIMESTAMP '1998-01-01' THEN 6 ELSE 7 END AS BIGINT)"""


@query("node_rows_date", f"SELECT leaf AS node_id, COUNT(*) AS n, SUM(y)::BIGINT AS positives FROM (SELECT {DATED_LEAF} AS leaf, y FROM {DATED}) GROUP BY 1")
def node_rows_date(spark, sf):
    """Rows of every leaf below date, boolean and timestamp splits, by predicate."""
    df, m = dated(spark, sf), dated_tree(spark, sf)
    return reduce(DataFrame.unionByName, [E.node_rows(df, m, n.node_id).groupBy(F.lit(n.node_id).cast("long").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")) for n in m.leaves()])


@query("score_date_rule", f"SELECT {DATED_LEAF} AS leaf_id, {DATED_LEAF} AS by_rule, COUNT(*) AS n FROM {DATED} GROUP BY ALL")
def score_date_rule(spark, sf):
    """The written rules, run as SQL, lead to the leaf that the row is routed to."""
    df, m = dated(spark, sf), dated_tree(spark, sf)
    by_rule = F.coalesce(*[F.when(F.expr(m.rule(n.node_id)), F.lit(n.node_id)) for n in m.leaves()]).cast("long")
    return S.assign_leaf(df, m).groupBy("leaf_id", by_rule.alias("by_rule")).agg(F.count(F.lit(1)).alias("n"))


@query("split_candidates_date", f"""
    WITH g AS (SELECT big, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS p FROM {DATED} WHERE moment >= TIMESTAMP '1997-01-02' AND moment < TIMESTAMP '1997-07-01' GROUP BY big),
    t AS (SELECT SUM(n) AS tn, SUM(p) AS tp FROM g)
    SELECT 'big' AS feature, MAX(n) FILTER (NOT big) AS n_left, MAX(n) FILTER (big) AS n_right,
      MAX(2 * tp / tn * (1 - tp / tn)) - SUM(n / tn * 2 * p / n * (1 - p / n)) AS gain FROM g, t""", "gain", digits=9)
def split_candidates_date(spark, sf):
    """Candidates below a date and a timestamp split."""
    t = G.split_candidates(dated(spark, sf), dated_tree(spark, sf), 5)
    return t.where("feature = 'big'").select("feature", "n_left", "n_right", "gain")


WIDE = 60


@query("best_numeric_split_wide", "SELECT 'f' || i AS feature, 0.5::DOUBLE AS threshold, COUNT(*) FILTER ((l_orderkey + i) % (i + 2) = 0)::DOUBLE AS n_left, "
       f"COUNT(*) FILTER ((l_orderkey + i) % (i + 2) <> 0)::DOUBLE AS n_right FROM {CREDIT}, (SELECT unnest(range({WIDE})) AS i) GROUP BY i")
def best_numeric_split_wide(spark, sf):
    """More than fifty features: each has its row."""
    df = credit(spark, sf).select("y", *[((F.col("l_orderkey") + i) % (i + 2) != 0).cast("int").alias(f"f{i}") for i in range(WIDE)])
    t = G.best_numeric_split(df, [f"f{i}" for i in range(WIDE)], "y", criterion="gini")
    return t.select("feature", "threshold", "n_left", "n_right")


def unseen(spark: SparkSession, sf: str) -> DataFrame:
    """credit with rows of a class that the tree was not fitted on."""
    return credit(spark, sf).withColumn("y", F.when(F.col("l_tax") > 0.06, 2).otherwise(F.col("y")))


UNSEEN = "(SELECT * REPLACE (CASE WHEN l_tax > 0.06 THEN 2 ELSE y END AS y) FROM " + CREDIT + ")"
UNSEEN_NODES = f"""r AS (SELECT {LEAF} AS leaf, y FROM {UNSEEN}), o AS (SELECT {LEAF} AS leaf, y FROM {CREDIT}),
    e(leaf, node_id) AS (SELECT unnest([3, 4, 5, 6, 7]), unnest([3, 4, 5, 6, 7]) UNION ALL SELECT unnest([3, 4, 5, 6, 7]), unnest([1, 1, 2, 2, 2]) UNION ALL SELECT unnest([3, 4, 5, 6, 7]), 0),
    g AS (SELECT node_id::BIGINT AS node_id, AVG(y) > 0.5 AS yes, COUNT(*) AS stored FROM o JOIN e USING (leaf) GROUP BY 1),
    k AS (SELECT node_id::BIGINT AS node_id, COUNT(*) AS n, COUNT(*) FILTER (y = 0) AS c0, COUNT(*) FILTER (y = 1) AS c1 FROM r JOIN e USING (leaf) GROUP BY 1)"""


@query("evaluate_nodes_unseen_class", f"WITH {UNSEEN_NODES} SELECT node_id, n, CASE WHEN yes THEN c1 ELSE c0 END / n::DOUBLE AS accuracy FROM k JOIN g USING (node_id)", "accuracy")
def evaluate_nodes_unseen_class(spark, sf):
    """Rows of an unseen class are wrong predictions, not missing rows."""
    return N.evaluate_nodes(unseen(spark, sf), fixed_tree(spark, sf)).select("node_id", "n", "accuracy")


@query("node_report_unseen_class", f"WITH {UNSEEN_NODES} SELECT node_id, n AS node_size, c1 AS target_count, c1 * 100.0::DOUBLE / n AS target_rate FROM k WHERE node_id >= 3", "target_rate")
def node_report_unseen_class(spark, sf):
    return N.node_report(unseen(spark, sf), fixed_tree(spark, sf)).select("node_id", "node_size", "target_count", "target_rate")


@query("validate_tree_unseen_class", f"""WITH {UNSEEN_NODES} SELECT node_id, stored::DOUBLE AS stored_n, n::DOUBLE AS counted_n, c0 + c1 = n AS counts_match, TRUE AS children_add_up
    FROM k JOIN g USING (node_id)""")
def validate_tree_unseen_class(spark, sf):
    return E.validate_tree(fixed_tree(spark, sf), unseen(spark, sf)).select("node_id", "stored_n", "counted_n", "counts_match", "children_add_up")
