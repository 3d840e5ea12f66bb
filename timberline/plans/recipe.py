"""Recipes: an ordered list of filter, cleaning, derive and bin steps on one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.functions import scalar
from timberline.operators import missing, rows, transforms


def _column(build: Callable) -> Callable:
    """A step that adds one column built from existing ones."""
    def step(df: DataFrame, name: str, **kw) -> DataFrame:
        return df.withColumn(name, build(df, **kw))
    return step


# Step names and the operators they stand for.
STEPS: dict[str, Callable[..., DataFrame]] = {
    "filter": rows.filter_rows, "filter_expr": rows.filter_expr, "drop_duplicates": rows.drop_duplicates,
    "drop_empty_rows": rows.drop_empty_rows, "remove_outliers": rows.remove_outliers, "select": rows.select_columns,
    "drop_missing": missing.drop_missing, "fill_constant": missing.fill_constant, "fill_mean": missing.fill_mean,
    "fill_median": missing.fill_median, "fill_mode": missing.fill_mode,
    "missing_as_category": missing.missing_as_category,
    "formula": scalar.formula_column,
    "ratio": _column(lambda df, a, b: scalar.ratio(F.col(a), F.col(b))),
    "difference": _column(lambda df, a, b: scalar.difference(F.col(a), F.col(b))),
    "sum": _column(lambda df, cols, skipna=True: scalar.add_up(*map(F.col, cols), skipna=skipna)),
    "interaction": _column(scalar.interaction), "flag": _column(scalar.binary_flag),
    "math": _column(lambda df, col, kind: scalar.math_transform(F.col(col), kind)),
    "text": _column(lambda df, col, kind: scalar.text_transform(F.col(col), kind)),
    "date": _column(lambda df, col, kind, ref=None: scalar.date_transform(F.col(col), kind, ref)),
    "log": transforms.log_transform, "sqrt": transforms.sqrt_transform, "rank": transforms.rank_transform,
    "minmax": transforms.minmax_scale, "standardize": transforms.standardize, "one_hot": transforms.one_hot,
    "label_encode": transforms.label_encode, "binary_encode": transforms.binary_encode,
    "bin_equal_width": transforms.bin_equal_width, "bin_equal_freq": transforms.bin_equal_freq,
    "bin_custom": transforms.bin_custom,
}


@dataclass(frozen=True)
class Step:
    kind: str
    args: dict[str, Any] = field(default_factory=dict)


def apply_recipe(df: DataFrame, steps: Sequence[Step | tuple[str, dict]]) -> DataFrame:
    """Fold the steps into one lazy plan (steps with whole-column statistics read them first)."""
    for step in _steps(steps):
        df = STEPS[step.kind](df, **step.args)
    return df


def _steps(steps: Sequence[Step | tuple[str, dict]]) -> list[Step]:
    out = [s if isinstance(s, Step) else Step(*s) for s in steps]
    unknown = [s.kind for s in out if s.kind not in STEPS]
    if unknown:
        raise ValueError(f"unknown recipe steps {unknown}; have {sorted(STEPS)}")
    return out


def recipe_report(df: DataFrame, steps: Sequence[Step | tuple[str, dict]]) -> DataFrame:
    """Rows and columns before and after every step, observed while the plan runs once."""
    seen = [Observation("rows_0")]
    widths = [len(df.columns)]
    df = df.observe(seen[0], F.count(F.lit(1)).alias("rows"))
    names = []
    for i, step in enumerate(_steps(steps), 1):
        df = STEPS[step.kind](df, **step.args)
        seen.append(Observation(f"rows_{i}"))
        widths.append(len(df.columns))
        names.append(step.kind)
        df = df.observe(seen[-1], F.count(F.lit(1)).alias("rows"))
    df.write.format("noop").mode("overwrite").save()
    counts = [o.get["rows"] for o in seen]
    out = [{"step": i + 1, "kind": k, "rows_before": counts[i], "rows_after": counts[i + 1],
            "rows_removed": counts[i] - counts[i + 1], "columns_after": widths[i + 1]} for i, k in enumerate(names)]
    return local_table(df.sparkSession, out, pa.schema([
        ("step", pa.int32()), ("kind", pa.string()), ("rows_before", pa.int64()), ("rows_after", pa.int64()),
        ("rows_removed", pa.int64()), ("columns_after", pa.int64())]))
