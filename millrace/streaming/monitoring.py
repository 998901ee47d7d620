"""Monitoring and drift over a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.monitor import drift_any, drift_scan, monitor_batch
from millrace.session import durable_checkpoint


def _with_batch(rows: DataFrame, batch_id: int) -> DataFrame:
    return rows.select(F.lit(batch_id).cast("bigint").alias("batch_id"), "*")


def monitor_stream(
    predictions: DataFrame,
    prediction: str,
    output: str,
    checkpoint: str,
    inputs: list[str] = (),
    bounds: dict[str, tuple[float, float]] | None = None,
    baseline: DataFrame | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write one monitoring record per micro-batch, and a drift record when a baseline is given.

    Every batch overwrites its own folder, so a batch that is run again after a
    failure leaves one record. The baseline, a row per feature, is worked out
    once before the stream starts.
    """
    if baseline is not None:
        baseline = durable_checkpoint(baseline)

    def record(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist() if baseline is not None else batch
        row = monitor_batch(held, prediction, inputs, bounds)
        _with_batch(row, batch_id).write.mode("overwrite").parquet(f"{output}/monitoring/batch={batch_id}")
        if baseline is not None:
            drift = drift_any(drift_scan(baseline, held))
            _with_batch(drift, batch_id).write.mode("overwrite").parquet(f"{output}/drift/batch={batch_id}")
            held.unpersist()

    writer = predictions.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
