"""Threat-intelligence dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.schema import INTEL_ENTRY_TYPE


def read_intel_map(spark: SparkSession, paths: str, per_line: bool = True) -> DataFrame:
    """JSON objects 'address -> fields' as one row per address.

    One object per line, so that files split; with ``per_line`` off one per file,
    which puts a whole file into one row.
    """
    whole = spark.read.text(paths, wholetext=not per_line)
    return explode_intel(whole, "value")


def explode_intel(df: DataFrame, column: str) -> DataFrame:
    parsed = df.select(F.from_json(column, INTEL_ENTRY_TYPE).alias("m"))
    return parsed.select(F.explode("m").alias("ip", "e")).select("ip", "e.*")
