"""Streams of chunks into an index: an extension, as the index itself knows batches only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..index.index import Index


def ingest(stream: DataFrame, index: Index, checkpoint: str, closed: bool = False, **trigger) -> StreamingQuery:
    """Add each micro-batch of (docid, file, line, text) rows by one commit: as a folded segment, or with `closed` under the closed vocabulary.

    The commit carries the batch's number, so a batch that is run again after a failure adds nothing twice. `trigger`: as for DataStreamWriter.trigger;
    all that is there, if not given.
    """

    def add(rows: DataFrame, number: int) -> None:
        if rows.isEmpty() or number in index.state.batches:
            return
        if closed:
            index.append(rows, batch=number)
        else:
            index.fold(index.publish(rows, batch=number)["tag"])

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
