"""Cleaning of unified flows and the dataset profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions import network as N
from netquarry.schema import OTHER_PROTOCOL_CODE, PROTOCOL_CODES, UNIFIED_TYPES

def parse_time(value: Column, day_first: bool = False) -> Column:
    """Text to a zone-free timestamp; unreadable text becomes null.

    Year-first dates with '-' or '/', 'T' or blank, and any fraction are cast
    directly. Dates that start with a month (or, on request, a day) are put in
    year-first order before the cast; an AM/PM suffix is honoured.
    """
    text = F.trim(value)
    plain = F.translate(text, "/", "-").try_cast("timestamp_ntz")
    order = "$3-$2-$1 $4" if day_first else "$3-$1-$2 $4"
    core = F.regexp_replace(text, r"(?i)\s*[ap]m$", "")
    moved = F.trim(F.regexp_replace(core, r"^(\d{1,2})/(\d{1,2})/(\d{4})\s*(.*)$", order)).try_cast("timestamp_ntz")
    half = F.upper(F.regexp_extract(text, r"(?i)([ap])m$", 1))
    shift = F.when((half == "P") & (F.hour(moved) < 12), 12).when((half == "A") & (F.hour(moved) == 12), -12).otherwise(0)
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), F.timestamp_add("HOUR", shift, moved)).otherwise(plain)


def number(df: DataFrame, name: str, type_name: str = "double") -> Column:
    """Numeric coercion of a column; anything missing or unreadable is 0.

    Text goes through double, so '12.0' is 12 and '0x0303' is 0. A column that
    is numeric already only needs its nulls filled.
    """
    c, zero = F.col(name), F.lit(0).cast(type_name)
    source = df.schema[name].dataType
    if isinstance(source, T.IntegralType) or (isinstance(source, T.NumericType) and type_name == "double"):
        filled = F.coalesce(c.cast(type_name), zero)
        return F.nanvl(filled, zero) if isinstance(source, T.FractionalType) else filled
    d = c.try_cast("double")
    return F.coalesce(F.nanvl(d, F.lit(0.0)).try_cast(type_name), zero)


def with_total_bytes(df: DataFrame) -> DataFrame:
    """Add TotBytes as source plus destination bytes when the input has none."""
    if "TotBytes" in df.columns or not {"SrcBytes", "DstBytes"} <= set(df.columns):
        return df
    return df.withColumn("TotBytes", number(df, "SrcBytes", "bigint") + number(df, "DstBytes", "bigint"))


def label_flag(df: DataFrame) -> Column:
    """Numeric label of one source: numbers, also as text, as they are; other text by keyword."""
    if "Label" not in df.columns:
        return F.lit(0)
    if isinstance(df.schema["Label"].dataType, T.NumericType):
        return F.coalesce(F.col("Label"), F.lit(0)).cast("int")
    return F.coalesce(F.trim("Label").try_cast("double").try_cast("int"), N.malicious_text("Label"))


def typed(df: DataFrame) -> DataFrame:
    """Flows of one source in the types every source shares.

    Times become zone-free timestamps, ports and counts numbers (0 where they
    can't be read), and the label a number by this source's rule, its text kept
    in Label_raw. Other columns stay as they are.
    """
    columns: dict[str, Column] = {}
    for name, kind in UNIFIED_TYPES.items():
        if name not in df.columns or name == "Label":
            continue
        if name == "StartTime":
            text = isinstance(df.schema[name].dataType, T.StringType)
            columns[name] = parse_time(F.col(name)) if text else F.col(name).cast(kind)
        else:
            columns[name] = F.col(name).cast("string") if kind == "string" else number(df, name, kind)
    if "TotBytes" in df.columns:
        columns["TotBytes"] = number(df, "TotBytes", "bigint")
    if "Label" in df.columns:
        if isinstance(df.schema["Label"].dataType, T.StringType):
            columns["Label_raw"] = F.col("Label")
        columns["Label"] = label_flag(df)
    return df.withColumns(columns)


def clean(df: DataFrame, deduplicate: bool = True, parts: int | None = None) -> DataFrame:
    """Unified, typed and de-duplicated flows.

    De-duplication runs on the normalised source columns only; columns that
    follow from them are added after it, so they are not shuffled. Nearly all
    rows differ, so they are exchanged as they are: folding them first would keep
    all rows of an input split in memory and spill them. Rows of one time, both
    addresses and both ports meet in a task. ``parts`` sets the number of
    partitions, else it is the session's.
    """
    cols = set(df.columns)
    out = df
    if "StartTime" in cols:
        start = F.col("StartTime")
        if isinstance(df.schema["StartTime"].dataType, T.StringType):
            start = parse_time(start)
        out = out.withColumn("StartTime", start.cast("timestamp_ntz"))
    out = out.dropna(subset=[c for c in ("StartTime", "SrcAddr", "DstAddr", "Proto") if c in cols])
    base: dict[str, Column] = {}
    if "Proto" in cols:
        base["Proto"] = F.lower(F.trim(F.col("Proto")))
    if "Dur" in cols:
        base["Dur"] = number(df, "Dur")
    for c in ("TotPkts", "TotBytes", "SrcBytes", "DstBytes"):
        if c in cols:
            base[c] = number(df, c, "bigint")
    for c in ("Sport", "Dport"):
        if c in cols:
            base[c] = number(df, c, "int")
    base["SubLabel"] = F.coalesce(F.col("SubLabel").cast("string"), F.lit("")) if "SubLabel" in cols else F.lit("")
    if "DatasetSource" not in cols:
        base["DatasetSource"] = F.lit("CTU-13")
    out = out.withColumns(base)
    if deduplicate:
        ends = [c for c in ("StartTime", "SrcAddr", "Sport", "DstAddr", "Dport") if c in cols]  # never constants, which Spark would exchange again
        if ends:
            out = out.repartition(parts, *ends) if parts else out.repartition(*ends)
        out = out.dropDuplicates()
    out = with_total_bytes(out)
    derived: dict[str, Column] = {"is_malicious": label_flag(out)}
    if "Proto" in cols:
        derived["ProtoCode"] = N.protocol_code("Proto", PROTOCOL_CODES, OTHER_PROTOCOL_CODE)
    if "Label" in cols and isinstance(out.schema["Label"].dataType, T.StringType):
        derived["Label_raw"] = F.col("Label")
    return out.withColumns(derived).withColumn("Label", F.col("is_malicious"))


def per_ip_rows(df: DataFrame) -> DataFrame:
    """Row preparation of the per-address profile, with its own defaults.

    Empty addresses and unreadable times are dropped, text columns default to
    '', and a packet count that is missing or 0 counts as 1.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    def num(name: str) -> Column:
        return number(df, name) if name in df.columns else F.lit(0.0)

    start = F.col("StartTime")
    if isinstance(df.schema["StartTime"].dataType, T.StringType):
        start = parse_time(start)
    pkts = num("TotPkts")
    raw_label = "Label_raw" if "Label_raw" in df.columns else "Label"
    total = num("TotBytes") if "TotBytes" in df.columns else num("SrcBytes") + num("DstBytes")
    out = df.select(
        start.cast("timestamp_ntz").alias("StartTime"),
        F.trim(text("SrcAddr")).alias("SrcAddr"),
        F.trim(text("DstAddr")).alias("DstAddr"),
        F.lower(text("Proto")).alias("Proto"),
        text("Sport").alias("Sport"),
        text("Dport").alias("Dport"),
        text("State").alias("State"),
        text(raw_label).alias("Label"),
        num("Dur").alias("Dur"),
        F.when(pkts == 0, F.lit(1.0)).otherwise(pkts).alias("TotPkts"),
        total.alias("TotBytes"),
        num("SrcBytes").alias("SrcBytes"),
        F.greatest(F.lit(0.0), total - num("SrcBytes")).alias("DstBytes"),
    )
    return out.filter(F.col("StartTime").isNotNull() & (F.col("SrcAddr") != "") & (F.col("DstAddr") != ""))


def dataset_profile(flows: DataFrame) -> DataFrame:
    """One row: size, time range, distinct addresses, hostile share."""
    n = F.count(F.lit(1))
    return flows.agg(
        n.alias("total_flows"),
        F.min("StartTime").alias("first_seen"),
        F.max("StartTime").alias("last_seen"),
        F.countDistinct("SrcAddr").alias("unique_src"),
        F.countDistinct("DstAddr").alias("unique_dst"),
        F.coalesce(F.sum("is_malicious"), F.lit(0)).alias("malicious_flows"),
        F.round(F.coalesce(F.avg("is_malicious"), F.lit(0.0)) * 100, 4).alias("malicious_pct"),
    )


def source_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("DatasetSource").agg(F.count(F.lit(1)).alias("flows"))
