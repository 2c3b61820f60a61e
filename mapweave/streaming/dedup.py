"""Streaming form of the session URL de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mapweave.functions.urls import url_hash


def unseen_results(results: DataFrame, time_col: str = "created_at", delay: str = "1 day") -> DataFrame:
    """First arrival of every URL of a session; the state of a URL is dropped ``delay`` after its time.

    Arrival order takes the place of rank order. State is keyed by session and hash, so one busy session is
    spread over all state partitions.
    """
    return (
        results.withColumn("url_hash", url_hash("url"))
        .withWatermark(time_col, delay)
        .dropDuplicatesWithinWatermark(["session_id", "url_hash"])
    )
