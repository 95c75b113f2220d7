"""A stream of rows into the corpus, each key once (an extension: the batch append, run for every micro-batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus


def ingest(rows: DataFrame, path: str, checkpoint: str, nfc: bool = True) -> StreamingQuery:
    """Runs until the source has no more. Keys are held against the corpus itself, so no state grows and a batch that runs again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        corpus.append(batch, path, nfc)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
