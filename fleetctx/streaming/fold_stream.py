"""The fold as a stream: each micro-batch is appended once, and projections are published as a new version.

A batch is keyed by its id, so a batch that is replayed after a failure overwrites its own files; equal
events keep the first arrival. State is the log itself: whatever was appended, the published snapshot
equals a rebuild.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import fold
from ..sources import log


def read_log(spark: SparkSession, root: str, but: int | None = None) -> DataFrame:
    """The appended log, without one batch if told so; empty before the first."""
    try:
        rows = spark.read.schema(schema.EVENTS).parquet(f"{root}/log")
        return (rows if but is None else rows.where(F.col("batch") != but)).select(*schema.EVENTS.fieldNames())
    except Exception as e:  # the folder comes with the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema.EVENTS)


def append_batch(root: str, publish: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends new events and publishes the projections."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log.append(read_log(spark, root, but=batch_id), batch).write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
        if publish:
            whole = read_log(spark, root)
            head = whole.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            log.publish(spark, fold.snapshot(whole), f"{root}/snapshots", head)

    return run


def start(events: DataFrame, root: str, checkpoint: str, publish: bool = True) -> StreamingQuery:
    """Fold a stream of events (EVENTS, numbered and hashed) until it has no more input."""
    return events.writeStream.foreachBatch(append_batch(root, publish)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
