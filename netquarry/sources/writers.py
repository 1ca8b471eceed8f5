"""Sinks for flows and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.schema import UNIFIED_COLUMNS, UNIFIED_TYPES


def unified(df: DataFrame) -> DataFrame:
    """Exactly the unified columns, in order, with defaults for absent ones."""
    have = set(df.columns)
    defaults = {
        "SubLabel": F.lit(""), "DatasetSource": F.lit("CTU-13"),
        "Label": F.col("is_malicious") if "is_malicious" in have else F.lit(0),
    }
    cols = [F.col(c) if c in have else defaults.get(c, F.lit(None)).cast(UNIFIED_TYPES[c]).alias(c) for c in UNIFIED_COLUMNS]
    return df.select(*cols)


def write_flows(df: DataFrame, path: str, csv_path: str | None = None, mode: str = "overwrite") -> None:
    """Parquet partitioned by source and day, plus an optional wide CSV mirror.

    The rebalance hint gives each partition folder few files and lets AQE split
    a folder that holds most of the rows.
    """
    dated = unified(df).withColumn("flow_date", F.to_date("StartTime"))
    dated.hint("rebalance", "DatasetSource", "flow_date").write.mode(mode).partitionBy("DatasetSource", "flow_date").parquet(path)
    if csv_path:
        exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        df.write.mode(mode).option("header", True).option("timestampNTZFormat", exact).csv(csv_path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows as JSON lines."""
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias(name))


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link form as JSON lines: one row per node or link."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("document"))
    link = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation")
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(link).alias("document")))
