"""A live view of job states over the event log (an extension: the same latest-row rule, as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_status_stream(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """The latest status of each job; write it in update mode."""
    return events.groupBy(key).agg(F.max(F.struct(order, "status")).alias("s")).select(key, F.col("s.status").alias("status"), F.col(f"s.{order}").alias(order))
