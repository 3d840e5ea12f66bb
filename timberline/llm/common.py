"""Shared folder tables and words, used by all operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.core import checkpoint_dir
from timberline.llm.tokens import encoder

# Java and Python spelling of one word: anything but the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of a file of a narrow table. An executor starts processes for each file that it creates (the local file system sets
# its mode that way), so tables of a few numbers a row are not written as one file per shuffle partition.
FILE_ROWS = 32_768


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, rows: int, per_file: int = FILE_ROWS, dealt: bool = False) -> DataFrame:
    """``df`` in no more partitions than files of ``per_file`` rows need; ``rows`` is a bound on its rows.

    What comes after the last exchange runs in that many tasks; with ``dealt`` it keeps its own, and its rows are dealt anew.
    """
    files = max(1, -(-rows // per_file))
    return df.repartition(files) if dealt else df.coalesce(files)


def give_back() -> None:
    """Return freed memory of this process to the system. Workers are used again; what they keep counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library only
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator], words: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, which leaves no freed memory behind; without ``words`` also no encoder of an earlier step."""
    def batches_of(batches: Iterator) -> Iterator:
        if not words:
            encoder.cache_clear()
        yield from run(batches)
        give_back()
    return batches_of


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def boxed(df: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``df`` in one struct ``row``, so that helper columns cannot clash with them; then ``more``."""
    return df.select(F.struct(*columns(df)).alias("row"), *more)


def unboxed(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The boxed columns ``names`` and the columns ``more``, which replace boxed ones of their name."""
    taken = {m.lower() for m in more}
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c.lower() not in taken], *more)


def empty_if_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    """Number of words of a text column; 0 for NULL."""
    return F.regexp_count(empty_if_null(text), F.lit(WORD)).cast("long")
