"""Extension: ingest of a stream of raw chunks into the chunk store.

Each micro-batch goes through the batch stages and one upsert. Ids come from the content, so a batch
that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..operators.store import ChunkStore, storable


def ingest_stream(raw: DataFrame, store: ChunkStore, checkpoint: str, **options) -> StreamingQuery:
    """Starts the query; it takes what is there and stops."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(storable(ingest.ingest(batch, **options)))

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
