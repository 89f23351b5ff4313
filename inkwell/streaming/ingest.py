"""Incremental ingest: each micro-batch of a stream of documents becomes a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from inkwell.sources.index import Index


def into(index: Index, stream: DataFrame, checkpoint: str, merge_every: int = 0) -> DataStreamWriter:
    """A writer that upserts ``stream`` (doc_id, stored, fields) into ``index``; start it with .start().

    A batch that is run again after a failure replaces its own documents by themselves.  With ``merge_every``, segments are merged when there are so many.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.index_all(batch)
            if merge_every and index.num_segments() >= merge_every:
                index.merge_all()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
