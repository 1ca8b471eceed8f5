import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def flow_rows(spark, rows, columns):
    """Flows from tuples; StartTime is given as text or as seconds after noon."""
    df = spark.createDataFrame(rows, columns)
    if "StartTime" in columns:
        kind = dict(df.dtypes)["StartTime"]
        base = "TIMESTAMP_NTZ'2024-01-01 12:00:00'"
        expr = "CAST(StartTime AS TIMESTAMP_NTZ)" if kind == "string" else f"timestampadd(SECOND, CAST(StartTime AS INT), {base})"
        df = df.selectExpr(f"{expr} AS StartTime", *[c for c in columns if c != "StartTime"])
    return df


@pytest.fixture(scope="session")
def make_flows(spark):
    return lambda rows, columns: flow_rows(spark, rows, columns)
