"""Answering a stream of requests from a pre-computed score grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from siteline.operators import spatial


def answer(requests: DataFrame, grid: DataFrame, max_dist_m: float = 150) -> DataFrame:
    """(property_id, score, dist_m) of requests (property_id, lat, lng) with a grid point (g_lat, g_lng, score, r, c)
    within the limit."""
    return spatial.nearest_cell(requests, grid, max_dist_m, True, ["score"], ["r", "c"])


def score_stream(requests: DataFrame, grid: DataFrame, out: str, checkpoint: str, max_dist_m: float = 150) -> StreamingQuery:
    """Answers each micro-batch of a stream of requests and appends it to Parquet, a folder per batch.

    The nearest point is chosen within a batch, so the stream keeps no state. A batch that runs again after a failure
    replaces its own folder, so every request is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows, grid, max_dist_m).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
