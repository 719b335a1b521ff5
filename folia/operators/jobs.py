"""Extraction jobs as an event log: their latest states, listing, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JOB_TTL_SECONDS

DONE = ("completed", "failed")


def latest(events: DataFrame) -> DataFrame:
    """The state after each job's last event. Transitions aren't checked: the last one counts."""
    last = F.max_by(F.struct("status", "updated_at", "event_id"), F.struct("updated_at", "event_id"))
    return events.groupBy("job_id").agg(last.alias("s"), F.min("updated_at").alias("created_at"), F.count("*").alias("n_events")).select("job_id", "s.status", "s.updated_at", "created_at", "n_events")


def evict(jobs: DataFrame, now, ttl: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs without those that ended more than ``ttl`` seconds before ``now``."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("updated_at")
    return jobs.where(~(F.col("status").isin(*DONE) & (age > ttl * 1_000_000)))


def listing(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Jobs by their time of creation, latest first."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.coalesce(F.unix_micros("created_at"), F.lit(0)).desc(), "job_id")


def with_stored(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs in memory, and of the stored ones those that memory lacks."""
    return memory.unionByName(stored.join(memory.select("job_id"), "job_id", "left_anti"))
