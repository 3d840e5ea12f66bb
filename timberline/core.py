"""Shared helpers: column typing, null normalisation, checkpoints, small tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A single aggregate with more expressions than this is split into several,
# which keeps generated code under the JVM method limits.
AGG_WIDTH = 300

# From this many aggregates on, a small table is spread over all cores first.
# The planner's estimate of files is compressed, their rows may be many times
# larger; tables beyond it are read in enough splits anyway.
HEAVY_AGG = 24
SPREAD_BYTES = 1 << 26

# Lookup tables up to this many rows may be broadcast; the count is always
# taken before the hint is given.
BROADCAST_ROWS = 500_000

FLOATING = (T.FloatType, T.DoubleType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"unknown column {name!r}; have {df.columns}")
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.NumericType)


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [c for c in (cols or df.columns) if is_numeric(df, c)]


def string_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    return [c for c in (cols or df.columns)
            if isinstance(field_type(df, c), T.StringType)]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns with a primitive type (the data model has no nested types)."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = F.col(f"`{name}`")
    if isinstance(field_type(df, name), FLOATING):
        return F.when(F.isnan(c), None).otherwise(c)
    return c


def clean_double(df: DataFrame, name: str) -> Column:
    """Any numeric, boolean or time column as a double without NaN."""
    t = field_type(df, name)
    if isinstance(t, T.BooleanType):
        return F.col(f"`{name}`").cast("int").cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(F.col(f"`{name}`")).cast("double") * 86_400.0
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp")).cast("double") / 1e6
    return clean(df, name).cast("double")


def one_row(df: DataFrame, exprs: dict[str, Column]) -> dict[str, object]:
    """Evaluate many aggregates in as few passes as the width limit allows."""
    out: dict[str, object] = {}
    items = list(exprs.items())
    if len(items) >= HEAVY_AGG:
        df = spread(df)
    for i in range(0, len(items), AGG_WIDTH):
        part = items[i:i + AGG_WIDTH]
        row = df.agg(*[e.alias(f"a{j}") for j, (_, e) in enumerate(part)]).first()
        out.update({name: row[j] for j, (name, _) in enumerate(part)})
    return out


def local_table(spark: SparkSession, rows: Iterable[dict], schema: pa.Schema) -> DataFrame:
    """A driver-held table as a JVM local relation (no Python tasks)."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=schema))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is taken when the cluster names one. A temporary
    folder is used only in local mode, where driver and executors share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="timberline-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def frozen(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: rows, partitions and their order are fixed."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, limit: int = SPREAD_BYTES) -> bool:
    """The planner's size estimate of a table is at most ``limit`` bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """Give a small table one partition per core before heavy work on it.

    A small file is often a single row group and would keep one core busy. The
    planner's size estimate is checked first; larger tables stay as they are.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df, limit) else df


def melt(df: DataFrame, values: dict[str, Column], keep: Sequence[str | Column] = (),
         name: str = "feature", value: str = "value") -> DataFrame:
    """Long form ``(keep…, name, value)`` of several columns of one type."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()])
    return df.select(*keep, F.inline(pairs))


def long_stats(df: DataFrame, per_column: dict[str, dict[str, Column]], name: str = "feature",
               cast: dict[str, str] | None = None) -> DataFrame:
    """One aggregation over the table, reshaped to one row per column.

    ``per_column`` maps a column to ``{statistic: aggregate}``; every column
    must carry the same statistics.
    """
    cast = cast or {}
    cols = list(per_column)
    stats = list(next(iter(per_column.values())))
    frames = []
    if len(cols) * len(stats) >= HEAVY_AGG:
        df = spread(df)
    width = max(1, AGG_WIDTH // max(1, len(stats)))
    for i in range(0, len(cols), width):
        part = cols[i:i + width]
        wide = df.agg(*[
            F.struct(F.lit(c).alias(name), *[
                per_column[c][s].cast(cast[s]).alias(s) if s in cast else per_column[c][s].alias(s)
                for s in stats
            ]).alias(f"s{j}") for j, c in enumerate(part)
        ])
        frames.append(wide.select(F.inline(F.array(*[f"s{j}" for j in range(len(part))]))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
