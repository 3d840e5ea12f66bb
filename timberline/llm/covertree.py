"""Near copies among vectors by dual traversal of cover trees.

For unit vectors cosine >= c means chord distance <= t = sqrt(2 - 2c), so a
metric tree gives exact answers. Vectors with equal label and dimension form a
group. A large group is first cut into cells around pivots drawn by seeded hash;
a vector also visits a later cell when the cell's covering radius and the
bisector of the two pivots allow a partner there. In each cell nested nets with
halving radii form a tree, and two trees are walked together: a node pair
farther apart than t plus both covering radii is dropped, one that lies within t
as a whole is counted without looking inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import saved, table
from timberline.llm.components import components

CELL_ROWS = 2048  # vectors of a cell, on average
MAX_PIVOTS = 16_384  # pivots of all groups; beyond it cells grow instead
LEAF, CHUNK, TRIES = 128, 512, 64
SLACK = 1e-9
BORDER = 1e-12


# --- one cell ------------------------------------------------------------

@dataclass
class Node:
    """``radius`` covers all points below; ``singles`` are points, ``kids`` smaller nodes."""

    center: int
    radius: float
    points: np.ndarray
    singles: np.ndarray
    kids: list[Node] = field(default_factory=list)

    def below(self) -> tuple[np.ndarray, np.ndarray]:
        """Centres of the kids, then the single points, and their covering radii."""
        at = np.concatenate([np.array([k.center for k in self.kids], np.int64), self.singles])
        return at, np.concatenate([np.array([k.radius for k in self.kids]), np.zeros(len(self.singles))])

    def child(self, i: int) -> Node:
        if i < len(self.kids):
            return self.kids[i]
        p = self.singles[i - len(self.kids):i - len(self.kids) + 1]
        return Node(int(p[0]), 0.0, p, p)


def _distance(x: np.ndarray, at: np.ndarray, center: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x[at] @ x[center])))


def build(x: np.ndarray, points: np.ndarray, center: int, level: float, floor: float) -> Node:
    """Nested nets: the centres of a level are ``level`` apart, the next level halves it."""
    d = _distance(x, points, center)
    radius = float(d.max()) if len(d) else 0.0
    if len(points) <= LEAF or radius <= floor:
        return Node(center, radius, points, points)
    while level >= radius:
        level /= 2
    node, left = Node(center, radius, points, points[:0]), points
    nearest, covered, centers = center, 0, 0
    while len(left):
        near = _distance(x, left, nearest) <= level
        near |= left == nearest
        group, left = left[near], left[~near]
        if len(group) == 1:
            node.singles = np.append(node.singles, group)
        else:
            node.kids.append(build(x, group, nearest, level / 2, floor))
        centers, covered = centers + 1, covered + len(group)
        if centers == TRIES and covered < 2 * TRIES:  # points without neighbours at this level: each is its own centre
            node.singles = np.concatenate([node.singles, left])
            break
        nearest = int(left[0]) if len(left) else center
    return node


class Links:
    """Weighted link counts per point and components, gathered block by block."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.weight, self.cosine = x, weight, cosine
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self.count = np.zeros(len(x), np.int64)
        self.root = np.arange(len(x))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def whole(self, a: Node, b: Node) -> None:
        """All points of two different nodes are linked."""
        self.count[a.points] += self.weight[b.points].sum()
        self.count[b.points] += self.weight[a.points].sum()
        self.join(a.points, np.full(len(a.points), b.center))
        self.join(b.points, np.full(len(b.points), a.center))

    def inside(self, a: Node) -> None:
        self.count[a.points] += self.weight[a.points].sum() - self.weight[a.points]
        self.join(a.points, np.full(len(a.points), a.center))

    def walk(self, first: Node, second: Node) -> None:
        stack = [(first, second)]
        while stack:
            a, b = stack.pop()
            same = a is b
            if same and 2 * a.radius <= self.reach - SLACK:
                self.inside(a)
                continue
            (ia, ra), (ib, rb) = a.below(), b.below()
            for s in range(0, len(ia), CHUNK):
                rows = slice(s, s + CHUNK)
                dot = self.x[ia[rows]] @ self.x[ib].T
                gap = np.sqrt(np.maximum(0.0, 2 - 2 * dot))
                span = ra[rows][:, None] + rb[None, :]
                open_ = gap <= self.reach + span + SLACK
                if same:  # each pair once; a node with itself only when it holds several points
                    place = np.arange(s, s + len(dot))[:, None]
                    open_ &= place <= np.arange(len(ib))[None, :]
                    single = np.arange(len(ib)) >= len(a.kids)
                    open_[np.arange(len(dot)), np.arange(s, s + len(dot))] &= ~single[rows]
                points = (np.arange(s, s + len(dot))[:, None] >= len(a.kids)) & (np.arange(len(ib))[None, :] >= len(b.kids))
                self._points(ia[rows], ib, dot, open_ & points)
                self._nodes(a, b, s, same, open_ & ~points, gap + span <= self.reach - SLACK, stack)

    def _nodes(self, a: Node, b: Node, s: int, same: bool, open_: np.ndarray, full: np.ndarray, stack: list) -> None:
        """Queue the pairs with a kid in them; single points open to one kid go together."""
        for i, j in zip(*np.nonzero(open_ & full)):
            p, q = a.child(s + int(i)), b.child(int(j))
            if not (same and s + int(i) == int(j)):
                self.whole(p, q)
                open_[i, j] = False
        ka, kb = len(a.kids), len(b.kids)
        for i, j in zip(*np.nonzero(open_[:max(0, ka - s), :kb])):
            stack.append((a.kids[s + int(i)], b.kids[int(j)]))
        for i in range(max(0, min(len(open_), ka - s))):
            some = b.singles[open_[i, kb:]]
            if len(some):
                stack.append((a.kids[s + i], Node(int(some[0]), 0.0, some, some)))
        for j in range(kb):
            rows = np.flatnonzero(open_[max(0, ka - s):, j]) + max(s, ka) - ka
            if len(rows):
                some = a.singles[rows]
                stack.append((Node(int(some[0]), 0.0, some, some), b.kids[j]))

    def _points(self, i: np.ndarray, j: np.ndarray, dot: np.ndarray, open_: np.ndarray) -> None:
        link = open_ & (dot >= self.cosine - BORDER)
        for p, q in zip(*np.nonzero(link & (np.abs(dot - self.cosine) <= BORDER))):
            link[p, q] = float(np.dot(self.x[i[p]], self.x[j[q]])) >= self.cosine
        if link.any():
            self.count += np.bincount(i, link @ self.weight[j], len(self.x)).astype(np.int64)
            self.count += np.bincount(j, link.T @ self.weight[i], len(self.x)).astype(np.int64)
            p, q = np.nonzero(link)
            self.join(i[p], j[q])


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cell(cosine: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["visits", "rep"], ignore_index=True)
        x, rep = unit(g["embedding"]), g["rep"].to_numpy(np.int64)
        links = Links(x, g["m"].to_numpy(np.int64), cosine)
        at, visits = np.arange(len(g)), g["visits"].to_numpy(bool)
        home, guests = at[~visits], at[visits]
        if len(home):
            tree = build(x, home, int(home[0]), 2.0, links.reach / 8)
            links.walk(tree, tree)
            if len(guests):
                links.walk(build(x, guests, int(guests[0]), 2.0, links.reach / 8), tree)
        hit = links.count > 0
        return pd.DataFrame({"rep": rep[hit], "links": links.count[hit], "root": rep[links.root[hit]]})
    return run


# --- the Spark job -------------------------------------------------------

@dataclass
class Pivots:
    """Pivots of the large groups and, once known, the covering radii of their cells."""

    at: dict[tuple[int, int], np.ndarray]
    radius: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def homes(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            g["cell"], g["far"] = 0, 0.0
            for key, part in g.groupby(["label", "dim"]):
                if key in self.at:
                    dot = unit(part["embedding"]) @ self.at[key].T
                    g.loc[part.index, "cell"] = dot.argmax(axis=1)
                    g.loc[part.index, "far"] = np.sqrt(np.maximum(0.0, 2 - 2 * dot.max(axis=1)))
            yield g

    def visits(self, reach: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                g = g.assign(visits=False)
                yield g.drop(columns="far")
                for key, part in g.groupby(["label", "dim"]):
                    if key not in self.at:
                        continue
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (unit(part["embedding"]) @ self.at[key].T)))
                    home, far = part["cell"].to_numpy(), part["far"].to_numpy()
                    near = (d <= self.radius[key][None, :] + reach + SLACK) & (d <= far[:, None] + 2 * reach + SLACK)
                    near &= np.arange(d.shape[1])[None, :] > home[:, None]  # each pair meets once, in the later cell
                    for cell in np.flatnonzero(near.any(axis=0)):
                        yield part[near[:, cell]].assign(cell=int(cell), visits=True).drop(columns="far")
        return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, label, embedding``.

    Rows with equal, non-NULL labels are linked when their cosine, in double precision, is at least ``cosine``.
    NULL, zero or empty vectors, those with NULL or non-finite components, and rows with a NULL id link with nothing;
    vectors of unequal dimension do not link. Equal vectors of a label are one weighted point; repeated rows count
    each. The pivots are the only vectors on the driver: about one per ``cell_rows``, at most about ``max_pivots``.
    """
    e = F.col("embedding")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, fine) & F.exists(e, lambda v: v != 0))
    base = vectors.select("vec_id", "label", "embedding").withColumn("sound", F.coalesce(sound, F.lit(False)))
    points = saved(base.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("m"))
                   .withColumn("dim", F.size("embedding")), "vector-points")
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = points.count()
    rows = max(cell_rows, -(-total // max_pivots))
    large = sizes.where(F.col("n") > rows)
    drawn = points.join(large, ["label", "dim"]).where(
        F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col("n")) < F.ceil(F.col("n") / rows)).select("label", "dim", "rep", "embedding").toPandas()
    pivots = Pivots({k: unit(g.sort_values("rep")["embedding"]) for k, g in drawn.groupby(["label", "dim"])} if len(drawn) else {})
    label = points.schema["label"].dataType.simpleString()
    held = f"label {label}, embedding {points.schema['embedding'].dataType.simpleString()}, rep long, m long, dim int, cell long"
    homes = saved(points.mapInPandas(pivots.homes, held + ", far double"), "vector-homes")
    far = homes.where("far > 0").groupBy("label", "dim", "cell").agg(F.max("far").alias("far")).collect()
    pivots.radius = {k: np.zeros(len(p)) for k, p in pivots.at.items()}
    for r in far:
        pivots.radius[(r["label"], r["dim"])][r["cell"]] = r["far"]
    reach = float(np.sqrt(2 - 2 * cosine))
    met = homes.mapInPandas(pivots.visits(reach), held + ", visits boolean")
    found = saved(met.groupBy("label", "dim", "cell").applyInPandas(_cell(cosine), "rep long, links long, root long"), "vector-links")
    whole = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    per = found.groupBy("rep").agg(F.sum("links").alias("links")).join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    of_point = points.join(per, "rep", "left").select("label", "embedding", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                                     F.coalesce("component", "rep").alias("component_id"))
    linked = base.where("sound").join(of_point, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = base.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All ``embeddings``, linked within their label at cosine 0.98."""
    return near_vectors(table(spark, sf, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.r AS a, y.r AS b, x.vec_id AS i, y.vec_id AS j FROM g x JOIN g y ON x.label = y.label AND x.r <> y.r AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS o FROM v UNION SELECT r.vec_id, l.j FROM r JOIN l ON r.o = l.i),
c AS (SELECT vec_id, min(o) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, true) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) k ON k.a = v.r LEFT JOIN c ON c.vec_id IS NOT DISTINCT FROM v.vec_id
"""
