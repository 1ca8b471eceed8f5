"""Incremental reservoir sample over a stream of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from netquarry.config import DEFAULT
from netquarry.functions.storage import fresh_path
from netquarry.operators.sampling import reservoir


class StreamSampler:
    """Keeps a uniform sample of at most ``limit`` rows of everything seen.

    Each micro-batch is merged with the previous sample and cut again by the
    same seeded row key, so the sample after any number of batches equals the
    batch sample of all rows. Each merge is a new table named by its batch id;
    a replayed batch starts from the sample before it.
    """

    def __init__(self, key: Sequence[str], limit: int = DEFAULT.sample_rows, seed: int = DEFAULT.seed, path: str | None = None):
        self.key, self.limit, self.seed, self.path = list(key), limit, seed, path

    def _table(self, batch_id: int) -> str:
        return f"{self.path}/batch={batch_id:012d}"

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        merged = batch
        if batch_id > 0:
            merged = merged.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(self._table(batch_id - 1)))
        reservoir(merged, self.key, self.limit, self.seed).write.mode("overwrite").parquet(self._table(batch_id))

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        if self.path is None:
            self.path = fresh_path(stream.sparkSession, "sample")
        writer = stream.writeStream.foreachBatch(self._merge).option("checkpointLocation", f"{self.path}/_progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def result(self, like: DataFrame) -> DataFrame:
        """The sample after the last batch, found in the folder; empty if no batch ran."""
        spark = like.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        found = hadoop.Path(f"{self.path}/batch=*/_SUCCESS")
        done = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
        last = max((status.getPath().getParent().toString() for status in done), default=None)
        if last is None:
            return spark.createDataFrame([], like.schema)
        return spark.read.schema(like.schema).parquet(last)
