"""Documents kept by key in hash buckets; a merge rewrites only the buckets it touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry.functions.storage import children, fresh_path, read_text, write_once
from netquarry.operators.scoring import upsert_documents

_BUCKET = "store_bucket"


class DocumentStore:
    """A table of documents with one row per key under a shared folder.

    Data folders are never changed once written. A manifest names the folder of
    every bucket, the columns, and the last batch merged; writing the next manifest
    is the commit. A merge that stops before it leaves the old rows in force, and a
    batch merged already is passed over. There is one writer at a time: a second
    one fails at the manifest both want to write. Data no manifest names any more
    stay until ``vacuum_candidates`` are removed by their owner.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, key: str = "cluster_id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path or fresh_path(spark, "documents"), key, buckets

    def _versions(self) -> list[str]:
        return children(self.spark, f"{self.path}/manifests")

    def _manifest(self) -> dict | None:
        """The newest whole manifest; one cut off by a lost writer does not count."""
        for name in reversed(self._versions()):
            try:
                return json.loads(read_text(self.spark, f"{self.path}/manifests/{name}"))
            except ValueError:
                continue
        return None

    def _bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _rows(self, manifest: dict, chosen: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [p for b, p in manifest["folders"].items() if chosen is None or int(b) in chosen]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in folders])

    def read(self) -> DataFrame:
        manifest = self._manifest()
        if manifest is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return self._rows(manifest)

    def lookup(self, *keys) -> DataFrame:
        """Documents of a few keys; only their buckets are read."""
        manifest = self._manifest()
        if manifest is None or not keys:
            raise ValueError("nothing to look up")
        kind = T.StructType.fromJson(manifest["schema"])[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", kind)]))
        chosen = [r[0] for r in wanted.select(self._bucket_of(F.col("k"), manifest["buckets"])).distinct().collect()]
        return self._rows(manifest, chosen).filter(F.col(self.key).isin(*keys))

    def upsert(self, batch: int, incoming: DataFrame) -> bool:
        """Merge documents by key as batch number ``batch``; False if that batch or a later one is in already.

        Incoming fields win, absent ones are kept, new columns are null in older
        documents. Each key occurs once in a batch and is not null; a column keeps
        its type.
        """
        manifest = self._manifest()
        if manifest and batch <= manifest["batch"]:
            return False
        buckets = manifest["buckets"] if manifest else self.buckets
        counts = incoming.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n"))
        summary = counts.agg(
            F.count_if(F.col(self.key).isNull() | (F.col("_n") > 1)).alias("bad"),
            F.collect_set(self._bucket_of(F.col(self.key), buckets)).alias("touched"),  # at most ``buckets`` numbers
        ).first()
        if summary["bad"]:
            raise ValueError(f"{summary['bad']} keys are null or occur more than once")
        merged = incoming
        if manifest:
            old = {f.name: f.dataType for f in T.StructType.fromJson(manifest["schema"])}
            other = [f.name for f in incoming.schema if f.name in old and _bare(old[f.name]) != _bare(f.dataType)]
            if other:
                raise ValueError(f"columns change their type: {other}")
            merged = upsert_documents(self._rows(manifest, summary["touched"]), incoming, self.key)
        folders = dict(manifest["folders"]) if manifest else {}
        data = f"data/{batch:012d}-{uuid.uuid4().hex}"
        if summary["touched"]:
            placed = merged.withColumn(_BUCKET, self._bucket_of(F.col(self.key), buckets))
            placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{data}")
            folders |= {str(b): f"{data}/{_BUCKET}={b}" for b in summary["touched"]}
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in merged.schema])
        taken = self._versions()
        following = int(taken[-1].removesuffix(".json")) + 1 if taken else 0
        record = {"batch": batch, "buckets": buckets, "schema": schema.jsonValue(), "folders": folders}
        write_once(self.spark, f"{self.path}/manifests/{following:012d}.json", json.dumps(record))
        return True

    def vacuum_candidates(self) -> list[str]:
        """Data folders the newest manifest no longer names; readers of older versions may still use them."""
        manifest = self._manifest() or {"folders": {}}
        live = {p.split("/")[1] for p in manifest["folders"].values()}
        return [f"{self.path}/data/{name}" for name in children(self.spark, f"{self.path}/data") if name not in live]


def _bare(kind: T.DataType) -> str:
    """A type without its null flags."""
    return kind.simpleString()
