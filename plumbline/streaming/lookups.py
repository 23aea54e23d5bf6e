"""Streams of requests: each micro-batch is answered by the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.lookup import Lookup


def answer_stream(requests: DataFrame, lookup: Lookup, path: str, checkpoint: str) -> StreamingQuery:
    """Answer a streaming frame of requests; one folder per micro-batch, so a replayed batch overwrites itself."""

    def answer(batch: DataFrame, number: int) -> None:
        lookup.match(batch).select("id", "decision", "candidates", "scores").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
