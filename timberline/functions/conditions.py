"""Type-aware row conditions and their strict left-to-right combination.

A positive operator does not hold on NULL; a negated operator (``!=``,
``not_contains``, ``not_in``, ``not_between``) is the exact complement of the
positive one, so it holds on NULL. NaN counts as NULL. The Columns keep plain
comparisons on the outside, so that Parquet filters are pushed down; a positive
operator may therefore be NULL instead of false (see :func:`holds`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.core import FLOATING, field_type

# Operator aliases.
ALIASES = {
    "=": "==", "==": "==", "equals": "==",
    "!=": "!=", "<>": "!=", "not_equals": "!=",
    ">": ">", ">=": ">=", "<": "<", "<=": "<=",
    "contains": "contains", "not_contains": "not_contains", "not contains": "not_contains",
    "starts_with": "starts_with", "ends_with": "ends_with",
    "is_null": "is_null", "is_not_null": "is_not_null", "not_null": "is_not_null",
    "between": "between", "not_between": "not_between", "not between": "not_between",
    "in": "in", "in list": "in", "not_in": "not_in", "not in": "not_in", "not in list": "not_in",
}

NEGATED = {"!=": "==", "not_contains": "contains", "not_in": "in", "not_between": "between"}


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any = None
    logic: str = "and"  # how it joins the conditions before it


def _literal(dtype: T.DataType, value: Any) -> Column:
    """The comparison value in the column's own type; a bad value raises."""
    if isinstance(dtype, T.BooleanType):
        text = str(value).strip().lower()
        if text in ("true", "1", "yes", "y"):
            return F.lit(True)
        if text in ("false", "0", "no", "n"):
            return F.lit(False)
        raise ValueError(f"not a boolean: {value!r}")
    if isinstance(dtype, T.IntegralType):
        number = float(value)
        return F.lit(int(number)) if number.is_integer() else F.lit(number)
    if isinstance(dtype, T.NumericType):
        return F.lit(float(value))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(str(value)).cast(dtype)
    return F.lit(str(value))


def condition(df: DataFrame, column: str, op: str, value: Any = None) -> Column:
    """One comparison as a boolean Column for ``where``."""
    if op not in ALIASES:
        raise ValueError(f"unknown operator {op!r}")
    op = ALIASES[op]
    dtype = field_type(df, column)
    c = F.col(f"`{column}`")
    floating = isinstance(dtype, FLOATING)
    null_word = value is None or (isinstance(value, str) and value.lower() == "null")
    if op == "is_null" or (op == "==" and null_word):
        return c.isNull() | F.isnan(c) if floating else c.isNull()
    if op == "is_not_null" or (op == "!=" and null_word):
        return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()
    if op in NEGATED:
        return c.isNull() | ~condition(df, column, NEGATED[op], value)
    if op in ("contains", "starts_with", "ends_with"):
        text = c.cast("string")
        return {"contains": text.rlike, "starts_with": text.startswith, "ends_with": text.endswith}[op](str(value))
    if op == "between":
        low, high = value
        return c.between(_literal(dtype, low), _literal(dtype, high))
    if op == "in":
        items = value.split(",") if isinstance(value, str) else list(value)
        items = [v.strip() if isinstance(v, str) else v for v in items]
        return c.isin([_literal(dtype, v) for v in items])
    right = _literal(dtype, value)
    if op in (">", ">="):
        test = c > right if op == ">" else c >= right
        return test & ~F.isnan(c) if floating else test     # NaN sorts above every number
    return {"==": c == right, "<": c < right, "<=": c <= right}[op]


def holds(test: Column) -> Column:
    """The condition as true or false, for use outside ``where``."""
    return F.coalesce(test, F.lit(False))


def combine(df: DataFrame, conditions: Sequence[Condition | tuple | dict],
            precedence: str = "left") -> Column:
    """Join conditions with AND/OR.

    ``precedence="left"`` groups strictly left to right, so
    ``a OR b AND c`` is ``(a OR b) AND c``; ``"sql"`` lets AND bind tighter.
    """
    if not conditions:
        return F.lit(True)
    items = [c if isinstance(c, Condition) else Condition(**c) if isinstance(c, dict) else Condition(*c)
             for c in conditions]
    columns = [condition(df, c.column, c.op, c.value) for c in items]
    logics = [c.logic.lower() for c in items]
    if any(x not in ("and", "or") for x in logics):
        raise ValueError(f"logic must be AND or OR, got {logics}")
    if precedence == "left":
        out = columns[0]
        for col, logic in zip(columns[1:], logics[1:]):
            out = (out & col) if logic == "and" else (out | col)
        return out
    if precedence != "sql":
        raise ValueError(f"unknown precedence {precedence!r}")
    terms = [columns[0]]
    for col, logic in zip(columns[1:], logics[1:]):
        if logic == "and":
            terms[-1] = terms[-1] & col
        else:
            terms.append(col)
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out
