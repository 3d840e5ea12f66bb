"""The tree model: a small table of nodes whose splits compile to Columns."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.core import FLOATING, clean_double, field_type, local_table
from timberline.functions.impurity import impurity_of
from timberline.operators.missing import MISSING
from timberline.operators.ordering import bucket_of

ROOT = 0

# Labels taken as the positive class, in order of preference.
POSITIVE_LABELS = ("1", "true", "yes", "y", "positive")

NUMERIC_OPS = ("<=", "<", ">", ">=")

# Features of these types are split by number (0 and 1, seconds since 1970) and written in their own type.
TYPED = ("boolean", "date", "timestamp", "timestamp_ntz")


def comparison_sql(f: str, op: str, value: float, kind: str = "") -> str:
    """``f op value`` as SQL, with the literal in the type of the column."""
    if kind == "boolean":
        holds = {"<=": lambda x: x <= value, "<": lambda x: x < value, ">": lambda x: x > value, ">=": lambda x: x >= value}[op]
        hit = [name for name, x in (("FALSE", 0.0), ("TRUE", 1.0)) if holds(x)]
        return f"{f} IN ({', '.join(hit)})" if hit else "FALSE"
    if kind not in TYPED:
        return f"{f} {op} {value!r}"
    # the nearest day or microsecond on the side that keeps the comparison
    per_second = 1 / 86_400 if kind == "date" else 1_000_000
    n = (math.floor if op in ("<=", ">") else math.ceil)(round(value * per_second, 6))
    start = datetime(1970, 1, 1, tzinfo=UTC)
    if kind == "date":
        return f"{f} {op} DATE '{(start + timedelta(days=n)).date()}'"
    literal = f"TIMESTAMP '{(start + timedelta(microseconds=n)).strftime('%Y-%m-%d %H:%M:%S.%f')}Z'"
    return f"{f} {op} {literal if kind == 'timestamp' else f'CAST({literal} AS TIMESTAMP_NTZ)'}"

SPLIT_KINDS = ("numeric", "numeric_multi_bin", "categorical", "categorical_multi_bin")


def positive_class(classes: Sequence[str], wanted: object = None) -> str:
    """The explicit class if present, else a usual positive label, else the last one."""
    if wanted is not None:
        if str(wanted) not in classes:
            raise ValueError(f"positive class {wanted!r} not among {list(classes)}")
        return str(wanted)
    if len(classes) == 2:
        for label in POSITIVE_LABELS:
            for c in classes:
                if c.lower() == label:
                    return c
    return sorted(classes)[-1]


def name_sql(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else f"`{name}`"


@dataclass(frozen=True)
class Split:
    """How a node sends rows to its children.

    numeric: child 0 where ``x op value``, else child 1. numeric_multi_bin:
    child i for ``[t[i-1], t[i])``. categorical and categorical_multi_bin: child
    by category; an unlisted category goes where NULL goes.
    """
    feature: str
    kind: str
    op: str = "<="
    value: float | None = None
    thresholds: tuple[float, ...] = ()
    categories: tuple[tuple[str, int], ...] = ()
    missing_child: int = 1

    def __post_init__(self):
        if self.kind not in SPLIT_KINDS:
            raise ValueError(f"unknown split kind {self.kind!r}")
        if self.kind == "numeric" and (self.op not in NUMERIC_OPS or self.value is None):
            raise ValueError("a numeric split needs a value and one of <= < > >=")
        if self.kind == "numeric_multi_bin" and list(self.thresholds) != sorted(set(self.thresholds)):
            raise ValueError("thresholds must ascend")
        if self.is_categorical and not self.categories:
            raise ValueError("a categorical split needs categories")

    @property
    def is_categorical(self) -> bool:
        return self.kind.startswith("categorical")

    @property
    def width(self) -> int:
        if self.kind == "numeric":
            return 2
        if self.kind == "numeric_multi_bin":
            return len(self.thresholds) + 1
        return max(2, max(i for _, i in self.categories) + 1)

    def members(self, child: int) -> list[str]:
        return sorted(c for c, i in self.categories if i == child)

    def test(self, x: Column) -> Column:
        v = F.lit(float(self.value))
        return {"<=": x <= v, "<": x < v, ">": x > v, ">=": x >= v}[self.op]

    def prepared(self, x: Column) -> Column:
        """NULL as its own category where the split lists one."""
        if self.is_categorical and any(c == MISSING for c, _ in self.categories):
            return F.coalesce(x, F.lit(MISSING))
        return x

    def child(self, x: Column, unknown: int | None = None) -> Column:
        """Child index; ``unknown`` replaces ``missing_child`` for NULL and unlisted values."""
        rest = F.lit(self.missing_child if unknown is None else unknown)
        if self.kind == "numeric":
            hit = self.test(x)
            return F.when(hit, 0).when(~hit, 1).otherwise(rest)
        if self.kind == "numeric_multi_bin":
            return F.coalesce(bucket_of(x, self.thresholds, right=False), rest)
        x = self.prepared(x)
        out = None
        for i in range(self.width):
            if self.members(i):
                hit = x.isin(self.members(i))
                out = F.when(hit, i) if out is None else out.when(hit, i)
        return out.otherwise(rest)

    def branch(self, x: Column, results: Sequence[Column]) -> Column:
        """The result of the child a row goes to — one comparison per binary split."""
        if self.kind == "numeric":
            first, second = results
            if self.missing_child == 1:
                return F.when(self.test(x), first).otherwise(second)
            return F.when(~self.test(x), second).otherwise(first)
        if self.kind == "categorical" or self.kind == "categorical_multi_bin":
            x = self.prepared(x)
            rest = results[self.missing_child]
            out = None
            for i in range(self.width):
                if i != self.missing_child and self.members(i):
                    hit = x.isin(self.members(i))
                    out = F.when(hit, results[i]) if out is None else out.when(hit, results[i])
            return rest if out is None else out.otherwise(rest)
        out = F.when(x.isNull(), results[self.missing_child])
        for t, r in zip(self.thresholds, results):
            out = out.when(x < F.lit(float(t)), r)
        return out.otherwise(results[-1])

    def sql(self, child: int, kind: str = "") -> str:
        """The rows of one child as a Spark SQL predicate; ``kind`` is the feature's type if it is one of ``TYPED``."""
        f = name_sql(self.feature)
        if self.kind == "numeric":
            flip = {"<=": ">", "<": ">=", ">": "<=", ">=": "<"}
            text = comparison_sql(f, self.op if child == 0 else flip[self.op], self.value, kind)
        elif self.kind == "numeric_multi_bin":
            parts = []
            if child > 0:
                parts.append(comparison_sql(f, ">=", self.thresholds[child - 1], kind))
            if child < len(self.thresholds):
                parts.append(comparison_sql(f, "<", self.thresholds[child], kind))
            text = " AND ".join(parts)
        else:
            if child == self.missing_child:
                # everything that no other child lists, NULL included
                others = [c for c, i in self.categories if i != child]
                if not others:
                    return "TRUE"
                null_listed = MISSING in others
                quoted = ", ".join(_quote(c) for c in sorted(others))
                if null_listed:
                    return f"coalesce({f}, '{MISSING}') NOT IN ({quoted})"
                return f"({f} NOT IN ({quoted}) OR {f} IS NULL)"
            members = self.members(child)
            if not members:
                return "FALSE"
            quoted = ", ".join(_quote(c) for c in members)
            return (f"coalesce({f}, '{MISSING}') IN ({quoted})" if MISSING in members
                    else f"{f} IN ({quoted})")
        return f"({text} OR {f} IS NULL)" if child == self.missing_child else text


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Node:
    node_id: int
    parent_id: int | None
    child_index: int
    depth: int
    counts: tuple[float, ...]
    split: Split | None = None

    @property
    def n(self) -> float:
        return float(sum(self.counts))


@dataclass(frozen=True)
class TreeModel:
    """Nodes, class list and parameters; holds no data and is never changed in place."""
    nodes: dict[int, Node]
    classes: tuple[str, ...]
    positive: str
    target: str
    features: tuple[tuple[str, str], ...]      # (name, "numeric" | "categorical")
    criterion: str = "gini"
    params: dict = field(default_factory=dict)

    # --- structure ---
    def children(self, node_id: int) -> list[Node]:
        return sorted((n for n in self.nodes.values() if n.parent_id == node_id), key=lambda n: n.child_index)

    def child_map(self) -> dict[int, list[Node]]:
        out: dict[int, list[Node]] = {}
        for n in sorted(self.nodes.values(), key=lambda n: n.child_index):
            if n.parent_id is not None:
                out.setdefault(n.parent_id, []).append(n)
        return out

    def leaves(self) -> list[Node]:
        return [n for _, n in sorted(self.nodes.items()) if n.split is None]

    def internal(self) -> list[Node]:
        return [n for _, n in sorted(self.nodes.items()) if n.split is not None]

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes.values())

    def ancestors(self, node_id: int) -> list[int]:
        """The node itself and everything above it."""
        out, at = [], node_id
        while at is not None:
            out.append(at)
            at = self.nodes[at].parent_id
        return out

    def descendants(self, node_id: int) -> list[int]:
        kids = self.child_map()
        out, todo = [], [node_id]
        while todo:
            for c in kids.get(todo.pop(), []):
                out.append(c.node_id)
                todo.append(c.node_id)
        return out

    def steps(self, node_id: int) -> list[tuple[Node, int]]:
        """(split node, child taken) from the root down to the node."""
        out, at = [], self.nodes[node_id]
        while at.parent_id is not None:
            out.append((self.nodes[at.parent_id], at.child_index))
            at = self.nodes[at.parent_id]
        return out[::-1]

    def path(self, node_id: int) -> str:
        steps = self.steps(node_id)
        return "/".join(["x", *[str(i + 1) for _, i in steps]]) if steps else "x0"

    def rule(self, node_id: int) -> str:
        types = self.params.get("types", {})
        return " AND ".join(p.split.sql(i, types.get(p.split.feature, "")) for p, i in self.steps(node_id)) or "TRUE"

    # --- node values ---
    def impurity(self, node_id: int) -> float:
        return impurity_of(self.nodes[node_id].counts, self.criterion)

    def prediction(self, node_id: int) -> str:
        """Majority class, the first class on ties."""
        counts = self.nodes[node_id].counts
        return self.classes[max(range(len(counts)), key=lambda i: (counts[i], -i))]

    def share(self, node_id: int, cls: str | None = None) -> float:
        node = self.nodes[node_id]
        cls = self.positive if cls is None else cls
        return node.counts[self.classes.index(cls)] / node.n if node.n else 0.0

    # --- changes (new models) ---
    def with_split(self, node_id: int, split: Split, child_counts: Sequence[Sequence[float]]) -> "TreeModel":
        nodes = dict(self.nodes)
        parent = nodes[node_id]
        nodes[node_id] = replace(parent, split=split)
        start = max(nodes) + 1
        for i, counts in enumerate(child_counts):
            nodes[start + i] = Node(start + i, node_id, i, parent.depth + 1, tuple(float(c) for c in counts))
        return replace(self, nodes=nodes)

    def collapsed(self, node_ids: Iterable[int]) -> "TreeModel":
        """Turn nodes into leaves, dropping what is below them."""
        nodes = dict(self.nodes)
        for i in node_ids:
            if i in nodes:
                for d in self.descendants(i):
                    nodes.pop(d, None)
                nodes[i] = replace(nodes[i], split=None)
        return replace(self, nodes=nodes)

    def with_counts(self, counts: dict[int, Sequence[float]]) -> "TreeModel":
        zero = tuple(0.0 for _ in self.classes)
        return replace(self, nodes={i: replace(n, counts=tuple(counts.get(i, zero))) for i, n in self.nodes.items()})

    # --- columns ---
    def input(self, df: DataFrame, split: Split) -> Column:
        if split.is_categorical:
            return F.col(f"`{split.feature}`").cast("string")
        return clean_double(df, split.feature)

    def route(self, inputs: dict[str, Column], result=None) -> Column:
        """Nested CASE from the root; ``result(node)`` is the value at a leaf (its id by default)."""
        result = result or (lambda n: F.lit(n.node_id).cast("long"))
        kids = self.child_map()

        def at(node: Node) -> Column:
            if node.split is None:
                return result(node)
            return node.split.branch(inputs[node.split.feature], [at(c) for c in kids[node.node_id]])

        return at(self.nodes[ROOT])

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        return {n.split.feature: self.input(df, n.split) for n in self.internal()}

    def where(self, df: DataFrame, node_id: int) -> Column:
        """Membership in a node as plain comparisons, which reach the file scan."""
        out = F.lit(True)
        for parent, i in self.steps(node_id):
            s = parent.split
            hit = F.expr(s.sql(i, "" if s.is_categorical else field_type(df, s.feature).simpleString()))
            if not s.is_categorical and isinstance(field_type(df, s.feature), FLOATING):
                nan = F.isnan(F.col(f"`{s.feature}`"))
                hit = (hit | nan) if i == s.missing_child else (hit & ~nan)
            out = out & hit
        return out

    # --- tables ---
    def rows(self) -> list[dict]:
        out = []
        for i, n in sorted(self.nodes.items()):
            s = n.split
            out.append({
                "node_id": i, "parent_id": n.parent_id, "child_index": n.child_index, "depth": n.depth,
                "is_terminal": s is None, "split_feature": s.feature if s else None,
                "split_type": s.kind if s else None, "split_op": s.op if s and s.kind == "numeric" else None,
                "split_value": s.value if s else None,
                "split_thresholds": list(s.thresholds) if s and s.thresholds else None,
                "split_categories": list(s.categories) if s and s.categories else None,
                "missing_child": s.missing_child if s else None, "n": n.n,
                "class_counts": list(zip(self.classes, n.counts)), "impurity": self.impurity(i),
                "prediction": self.prediction(i), "probability": self.share(i, self.prediction(i)),
                "p_positive": self.share(i), "path": self.path(i), "rule": self.rule(i)})
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        return local_table(spark, self.rows(), NODE_SCHEMA)

    def ancestor_table(self, spark: SparkSession) -> DataFrame:
        """``(leaf_id, node_id, depth)`` for every leaf and each node on its path."""
        rows = [{"leaf_id": l.node_id, "node_id": a, "depth": self.nodes[a].depth}
                for l in self.leaves() for a in self.ancestors(l.node_id)]
        return local_table(spark, rows, pa.schema(
            [("leaf_id", pa.int64()), ("node_id", pa.int64()), ("depth", pa.int32())]))

    @staticmethod
    def from_rows(rows: Iterable[dict], classes: Sequence[str], positive: str, target: str,
                  features: Sequence[tuple[str, str]], criterion: str, params: dict | None = None) -> "TreeModel":
        nodes = {}
        for r in rows:
            split = None
            if not r["is_terminal"]:
                cats = r["split_categories"] or {}
                cats = cats.items() if isinstance(cats, dict) else cats
                split = Split(r["split_feature"], r["split_type"], r["split_op"] or "<=", r["split_value"],
                              tuple(r["split_thresholds"] or ()), tuple(sorted((c, i) for c, i in cats)),
                              r["missing_child"])
            counts = dict(r["class_counts"])
            nodes[r["node_id"]] = Node(r["node_id"], r["parent_id"], r["child_index"], r["depth"],
                                       tuple(float(counts.get(c, 0.0)) for c in classes), split)
        return TreeModel(nodes, tuple(classes), positive, target, tuple(map(tuple, features)), criterion, params or {})


NODE_SCHEMA = pa.schema([
    ("node_id", pa.int64()), ("parent_id", pa.int64()), ("child_index", pa.int32()), ("depth", pa.int32()),
    ("is_terminal", pa.bool_()), ("split_feature", pa.string()), ("split_type", pa.string()),
    ("split_op", pa.string()), ("split_value", pa.float64()), ("split_thresholds", pa.list_(pa.float64())),
    ("split_categories", pa.map_(pa.string(), pa.int32())), ("missing_child", pa.int32()), ("n", pa.float64()),
    ("class_counts", pa.map_(pa.string(), pa.float64())), ("impurity", pa.float64()), ("prediction", pa.string()),
    ("probability", pa.float64()), ("p_positive", pa.float64()), ("path", pa.string()), ("rule", pa.string())])
