"""Writers, saved models and dataset fingerprints."""

from __future__ import annotations

import json
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.core import local_table
from timberline.operators.grow import TreeParams
from timberline.plans.tree import NODE_SCHEMA, TreeModel


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write a table as csv (with header), parquet or json."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r}")
    writer = df.write.mode(mode).options(**options)
    if fmt == "csv":
        writer = writer.option("header", options.get("header", True))
    writer.format(fmt).save(path)


def save_model(model: TreeModel, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """One JSON document with the header and the node rows."""
    params = model.params.get("params")
    document = {
        "classes": list(model.classes), "positive": model.positive, "target": model.target,
        "features": [list(f) for f in model.features], "criterion": model.criterion,
        "params": asdict(params) if params is not None else None, "types": model.params.get("types", {}),
        "nodes": model.rows()}
    table = local_table(spark, [{"value": json.dumps(document)}], pa.schema([("value", pa.string())]))
    table.coalesce(1).write.mode(mode).text(path)


def load_model(spark: SparkSession, path: str) -> TreeModel:
    document = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    params = {"params": TreeParams(**document["params"])} if document["params"] else {}
    if document.get("types"):
        params["types"] = document["types"]
    return TreeModel.from_rows(document["nodes"], document["classes"], document["positive"], document["target"],
                               document["features"], document["criterion"], params)


def save_node_table(model: TreeModel, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """The node rows as Parquet, for reading with other tools."""
    spark.createDataFrame(pa.Table.from_pylist(model.rows(), schema=NODE_SCHEMA)).write.mode(mode).parquet(path)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Rows, columns, schema and an order-free content checksum."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).cast("string").alias("checksum")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)).alias("schema"), "checksum")
