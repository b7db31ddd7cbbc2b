"""Extraction over a stream of passages. It is stateless: each micro-batch is one narrow projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import entity_rows, extract, triple_rows


def stream_extraction(passages: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends entity and triple rows of arriving passages under folder. A batch that runs again overwrites its own folder only."""

    def write(batch: DataFrame, number: int) -> None:
        extracted = extract(batch).persist()
        entity_rows(extracted).write.mode("overwrite").parquet(f"{folder}/entities/batch={number}")
        triple_rows(extracted).write.mode("overwrite").parquet(f"{folder}/triples/batch={number}")
        extracted.unpersist()

    writer = passages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
