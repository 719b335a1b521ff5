"""Job states as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import JOB_TTL_SECONDS
from ..operators.jobs import DONE

STATE = "status string, updated_at timestamp, created_at timestamp, n_events long"
OUTPUT = "job_id long, status string, updated_at timestamp, created_at timestamp, n_events long, expired boolean"


def job_states(events: DataFrame, ttl: int = JOB_TTL_SECONDS) -> DataFrame:
    """The state of each job after each micro-batch of events (job_id, status, updated_at). The last
    event wins; jobs that ended leave the state ``ttl`` seconds of event time later, with a last row."""

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, updated, created, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], status, updated, created, n, True)], columns=["job_id", "status", "updated_at", "created_at", "n_events", "expired"])
            return
        status, updated, created, n = state.get if state.exists else (None, None, None, 0)
        for b in batches:
            b = b.sort_values("updated_at", kind="stable")
            last = b.iloc[-1]
            if updated is None or last["updated_at"] >= updated:
                status, updated = last["status"], last["updated_at"]
            created = b["updated_at"].min() if created is None else min(created, b["updated_at"].min())
            n += len(b)
        state.update((status, updated.to_pydatetime() if hasattr(updated, "to_pydatetime") else updated, created.to_pydatetime() if hasattr(created, "to_pydatetime") else created, n))
        if status in DONE:
            state.setTimeoutTimestamp(max(int(updated.timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl * 1000)
        yield pd.DataFrame([(key[0], status, updated, created, n, False)], columns=["job_id", "status", "updated_at", "created_at", "n_events", "expired"])

    timed = events.withWatermark("updated_at", "1 hour")
    return timed.groupBy("job_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run_worker(jobs: DataFrame, process, checkpoint: str, sink: str):
    """Pending jobs of a stream through ``process`` (DataFrame -> DataFrame with status), micro-batch by micro-batch."""

    def batch(df: DataFrame, _: int) -> None:
        process(df.where("status = 'pending'")).write.mode("append").parquet(sink)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
