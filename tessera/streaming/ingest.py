"""Files that arrive, indexed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.index import Manager
from tessera.sources.loaders import from_table


def indexed(stream: DataFrame, manager: Manager, checkpoint: str) -> StreamingQuery:
    """Indexes the documents of a stream. A batch that comes again after a failure is skipped, as its content is known.

    Segments are merged as they become due, so that their number stays small however many batches come.
    """

    def take(batch: DataFrame, _: int) -> None:
        manager.index_documents(from_table(batch))
        manager.merge()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
