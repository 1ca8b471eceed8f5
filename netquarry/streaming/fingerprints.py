"""Hourly fingerprints of a stream of flows, each window emitted once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netquarry.config import DEFAULT
from netquarry.functions.storage import children, fresh_path, read_text, remove, write_once
from netquarry.operators import fingerprints

_STAMP = "yyyy-MM-dd'T'HH-mm-ss.SSSSSS"  # sorts as text, fits a folder name


class FingerprintStream:
    """Keeps the flows of open windows and emits a window's fingerprints when it closes.

    The horizon is the latest flow time seen less ``delay``. After every batch the
    windows that end at or before it close: their fingerprints are made by the batch
    operator over all their flows, whatever batch brought them, so gaps, entropies
    and labels are exact and a busy source is spread as in a batch. Flows of a window
    closed before are late; they are counted and dropped. Flows without a time are
    dropped too.

    Nothing is held in executors between batches: open flows lie in the shared folder
    by window and batch, and are removed once the batch that closed their window is
    committed. A batch's commit is one small file with the horizon; a batch run again
    starts from the commit before it and writes the same folders, and a batch that is
    committed is passed over.
    """

    def __init__(self, delay: str = "1 hour", window: str = DEFAULT.fingerprint_window, path: str | None = None, **options):
        self.delay, self.window, self.path, self.options = delay, window, path, options

    def _commits(self, spark: SparkSession) -> list[int]:
        return [int(name) for name in children(spark, f"{self.path}/commits")]

    def _commit(self, spark: SparkSession, batch_id: int) -> dict:
        """What a batch left behind; one that was cut off while written counts as not there."""
        try:
            return json.loads(read_text(spark, f"{self.path}/commits/{batch_id:012d}"))
        except ValueError:
            remove(spark, f"{self.path}/commits/{batch_id:012d}")
            return {}

    def _last(self, spark: SparkSession) -> tuple[int, dict]:
        for batch_id in reversed(self._commits(spark)):
            found = self._commit(spark, batch_id)
            if found:
                return batch_id, found
        return -1, {"horizon": None, "late": 0}

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done, last = self._last(spark)
        if batch_id <= done:
            return
        open_rows = f"{self.path}/open"
        # Folders closed by the last commit are not needed any more, also if that batch ended before removing them.
        for name in children(spark, open_rows):
            if last["horizon"] and name.startswith("stream_closes=") and name.removeprefix("stream_closes=") <= last["horizon"]:
                remove(spark, f"{open_rows}/{name}")
        before = F.to_timestamp_ntz(F.lit(last["horizon"]).cast("string"), F.lit(_STAMP))
        ends = F.window("StartTime", self.window).getField("end")
        timed = batch.filter(F.col("StartTime").isNotNull()).withColumn("_end", ends)
        late = F.coalesce(F.col("_end") <= before, F.lit(False))
        placed = timed.filter(~late).withColumn("stream_closes", F.date_format("_end", _STAMP))
        placed.drop("_end").withColumn("stream_batch", F.lit(batch_id)).hint("rebalance", "stream_closes").write.partitionBy("stream_closes", "stream_batch").option(
            "partitionOverwriteMode", "dynamic"
        ).mode("overwrite").parquet(open_rows)
        seen = timed.agg(
            F.date_format(F.max("StartTime") - F.expr(f"INTERVAL {self.delay}"), _STAMP).alias("horizon"),
            F.count_if(late).alias("late"),
        ).first()
        horizon = max(filter(None, (last["horizon"], seen["horizon"])), default=None)
        due = [n for n in children(spark, open_rows) if n.startswith("stream_closes=") and horizon and n.removeprefix("stream_closes=") <= horizon]
        if due:
            flows = spark.read.schema(batch.schema).option("basePath", open_rows).parquet(*[f"{open_rows}/{n}" for n in due])
            made = fingerprints.fingerprints(flows.select(*batch.columns), self.window, **self.options)
            made.write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch_id:012d}")
        write_once(spark, f"{self.path}/commits/{batch_id:012d}", json.dumps({"horizon": horizon, "late": last["late"] + seen["late"], "closed": bool(due)}))

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """``stream`` holds cleaned flows."""
        if self.path is None:
            self.path = fresh_path(stream.sparkSession, "fingerprint-stream")
        writer = stream.writeStream.foreachBatch(self._merge).option("checkpointLocation", f"{self.path}/_progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def late_flows(self, spark: SparkSession) -> int:
        return self._last(spark)[1]["late"]

    def result(self, flows: DataFrame) -> DataFrame:
        """Fingerprints of all windows closed by committed batches; ``flows`` gives the columns."""
        spark = flows.sparkSession
        done = self._last(spark)[0]
        schema = fingerprints.fingerprints(flows.limit(0), self.window, **self.options).schema
        folders = [n for n in children(spark, f"{self.path}/closed") if int(n.removeprefix("batch=")) <= done]
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/closed/{n}" for n in folders])
