"""Readers. Any Hadoop path works: local, ``s3a://``, ``gs://``, ``abfss://``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.operators.rows import limit_rows

# Delimiters that are tried, and how much text is looked at.
DELIMITERS = (",", "\t", ";", "|", " ")
SNIFF_CHARS = 10_000


def _clean_text(c: Column, nulls: Sequence[str]) -> Column:
    return F.when(F.trim(c).isin(list(nulls)), None).otherwise(c) if nulls else c


def number(c: Column, decimal: str = ".", thousands: str | None = None) -> Column:
    """Text with decimal and thousands marks as a double; bad text gives NULL."""
    if thousands:
        c = F.replace(c, F.lit(thousands), F.lit(""))
    if decimal != ".":
        c = F.replace(c, F.lit(decimal), F.lit("."))
    return c.try_cast("double")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8",
             quote: str = '"', escape: str = "\\", columns: Sequence[str] | None = None, nulls: Sequence[str] = (),
             decimal: str = ".", thousands: str | None = None, numeric: Sequence[str] = (), dates: Sequence[str] = (),
             date_format: str | None = None, schema: T.StructType | str | None = None, infer: bool = False,
             multiline: bool = False, order_by: Sequence[str] = (), skip: int = 0, skip_tail: int = 0,
             n: int | None = None) -> DataFrame:
    """CSV with null tokens, number marks, date columns and row limits.

    ``nulls`` are extra null tokens. ``numeric`` columns are parsed with the
    given marks. Row limits need ``order_by``, because a distributed file has
    no row order.
    """
    reader = (spark.read.option("sep", sep).option("header", header).option("encoding", encoding)
              .option("quote", quote).option("escape", escape).option("multiLine", multiline))
    raw_numbers = bool(numeric) and (decimal != "." or thousands is not None or bool(nulls))
    if schema is not None:
        reader = reader.schema(schema)
    elif infer and not raw_numbers and not nulls:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    if columns is not None:
        df = df.select(*columns)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if nulls:
        df = df.withColumns({c: _clean_text(F.col(f"`{c}`"), nulls) for c in text})
    if numeric:
        df = df.withColumns({c: number(F.col(f"`{c}`").cast("string"), decimal, thousands) for c in numeric})
    if dates:
        df = parse_dates(df, dates, date_format)
    if skip or skip_tail or n is not None:
        if not order_by:
            raise ValueError("row limits need order_by")
        df = limit_rows(df, list(order_by), skip, skip_tail, n)
    return df


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent candidate in the first 10,000 characters; tab when none occurs."""
    lines = spark.read.text(path).select(F.substring("value", 1, SNIFF_CHARS).alias("value"))
    text, n = "", 100
    while True:  # short lines: look at more of them
        got = lines.limit(n).collect()
        text = "".join(r["value"] + "\n" for r in got)
        if len(text) >= SNIFF_CHARS or len(got) < n:
            break
        n = min(10 * n, SNIFF_CHARS)
    text = text[:SNIFF_CHARS]
    counts = {d: text.count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else "\t"


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, **opts) -> DataFrame:
    return read_csv(spark, path, sep=sep or sniff_delimiter(spark, path), **opts)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                 order_by: Sequence[str] = (), skip: int = 0, n: int | None = None) -> DataFrame:
    """Parquet; only the selected columns are read."""
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    if skip or n is not None:
        if not order_by:
            raise ValueError("row limits need order_by")
        df = limit_rows(df, list(order_by), skip, 0, n)
    return df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_any(spark: SparkSession, path: str, **opts) -> DataFrame:
    """Pick the reader by file ending: csv, txt/tsv, json, parquet."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "txt": read_delimited, "tsv": read_delimited, "json": read_json, "parquet": read_parquet}
    if ending not in readers:
        raise ValueError(f"unsupported file ending {ending!r}")
    return readers[ending](spark, path, **opts)


def list_files(spark: SparkSession, prefix: str, pattern: str | None = None, n: int | None = None) -> DataFrame:
    """Files (the first ``n``, if given) under a prefix by path: name, size, modification time (contents are not read)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(prefix).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")
    return files.orderBy("path").limit(n) if n is not None else files


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              partition_column: str | None = None, lower: object = None, upper: object = None, partitions: int = 8,
              fetch_size: int = 10_000, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table or query over JDBC, read in parallel ranges when a partition column is named."""
    if (table is None) == (query is None):
        raise ValueError("give either table or query")
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    source = table if table is not None else f"({query}) q"
    if partition_column is None:
        return reader.option("dbtable", source).load()
    if lower is None or upper is None:
        ends = (reader.option("dbtable", f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi "
                                         f"FROM {source}) b" if table else
                              f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {source}) b")
                .load().first())
        lower, upper = ends[0], ends[1]
    if lower is None:
        return reader.option("dbtable", source).load()
    return (reader.option("dbtable", source).option("partitionColumn", partition_column)
            .option("lowerBound", str(lower)).option("upperBound", str(upper))
            .option("numPartitions", partitions).load())


def parse_dates(df: DataFrame, cols: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Text to timestamps; values that do not match become NULL."""
    form = F.lit(fmt) if fmt else None
    return df.withColumns({
        c: F.try_to_timestamp(F.col(f"`{c}`").cast("string"), form) if form is not None
        else F.try_to_timestamp(F.col(f"`{c}`").cast("string")) for c in cols})
