"""Registry of queries and oracles, and the views both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles}) if doubles else df


def query(name: str, sql: str | None = None, floats: str = "", digits: int = DIGITS):
    """Register a query; ``floats`` names the columns the SQL side rounds."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None:
            cols = ", ".join(f"ROUND({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in floats.split())
            ORACLES[name] = f"SELECT * REPLACE ({cols}) FROM ({sql}) _q" if cols else sql
        return fn
    return register


# --- shared views --------------------------------------------------------

def credit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


def credit_null(spark: SparkSession, sf: str) -> DataFrame:
    """credit with NULLs put into two columns."""
    return credit(spark, sf).withColumns({
        "l_linenumber": F.nullif("l_linenumber", F.lit(3)),
        "l_quantity": F.when(F.col("l_quantity") <= 45, F.col("l_quantity"))})


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").drop("text").join(table(spark, sf, "labels"), "doc_id")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumn("y", (F.col("p_retailprice") > 950).cast("int"))


CREDIT = "(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"
CREDIT_NULL = ("(SELECT * REPLACE (NULLIF(l_linenumber, 3) AS l_linenumber, "
               "CASE WHEN l_quantity <= 45 THEN l_quantity END AS l_quantity), "
               "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)")
DOCS = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
PARTS = "(SELECT *, CASE WHEN p_retailprice > 950 THEN 1 ELSE 0 END AS y FROM part)"
