"""Linking a stream of records against a static source, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def link_stream(records: DataFrame, link: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``link(batch)`` of each micro-batch of ``records`` below ``path``.

    Statistics that ``link`` uses are those of the static side, taken before. A batch that runs again
    replaces its own folder, so results are there once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        link(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
