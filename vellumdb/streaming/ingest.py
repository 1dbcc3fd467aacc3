"""Streaming ingest: each micro-batch of JSON texts becomes a segment, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..database import Database


def ingest(stream: DataFrame, database: Database, checkpoint: str, column: str = "json", **trigger) -> StreamingQuery:
    """Starts a query that loads the stream's texts.  A batch's number is committed in the
    same manifest as its documents, under the checkpoint's name, so a batch that is run
    again after a crash, wherever it struck, is recognised and not loaded twice."""

    def load(batch: DataFrame, number: int) -> None:
        database.load(batch, column, batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
