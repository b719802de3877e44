"""Continuous indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..index import RegexIndex


def append_stream(rows: DataFrame, index: RegexIndex, checkpoint: str, key: str = "doc_id", text: str = "text", **trigger):
    """Start a query that appends each micro-batch of ``rows`` as a generation named by the batch.

    A batch that is run again after a failure replaces its own generation.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        index.append(batch, key, text, name=f"s{batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
