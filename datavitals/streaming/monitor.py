"""Repeated scans of an arriving table: each micro-batch is one monitored run.

The history row of a batch carries an id derived from the monitor and the batch number, and a
batch already recorded is not appended again, so a replayed batch leaves one row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from datavitals.functions.normalize import normalize_values
from datavitals.operators.checks import Scan
from datavitals.plans.options import ScanOptions
from datavitals.session import stage
from datavitals.sources.history import history, run_record, save_run


def monitor_stream(
    stream: DataFrame, dataset_name: str, history_path: str, checkpoint: str, roles=None,
    options: ScanOptions | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    def record(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        run_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{dataset_name}/{batch_id}"))
        done = history(batch.sparkSession, history_path).filter(F.col("dataset_name") == dataset_name)
        if not done.filter(F.col("run_id") == run_id).isEmpty():
            return
        # a scan takes some twenty jobs, which read the staged columns they use, not the source again
        row = run_record(Scan(stage(normalize_values(batch), "batch"), roles, options), dataset_name, config={"batch": batch_id}, run_id=run_id)
        save_run(row, history_path, skip_unchanged=False)

    writer = stream.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
