"""A stream of records into a store, each micro-batch as one atomic commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sylva.model import WriteBatch
from sylva.store import Store

_PARTS = ("nodes", "edges", "embeddings", "catalog")


def ingest(rows: DataFrame, store: Store, part: str, stream: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that applies every micro-batch of ``rows`` as the ``part`` of a write batch.

    ``rows`` has the columns that a batch's part has. The epoch is recorded in the commit itself, so an epoch that is
    delivered again after a failure changes nothing. Empty epochs make no commit. ``trigger`` is passed on, for
    instance ``availableNow=True``.
    """
    if part not in _PARTS:
        raise ValueError(f"part is one of {', '.join(_PARTS)}")

    def apply(batch: DataFrame, epoch: int) -> None:
        if epoch > store.stream_position(stream) and not batch.isEmpty():
            store.apply_batch(WriteBatch(**{part: batch}), streams={stream: epoch})

    writer = rows.writeStream.queryName(stream).option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(**trigger) if trigger else writer).start()
