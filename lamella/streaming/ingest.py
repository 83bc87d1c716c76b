"""Continuous ingest: a stream of writes becomes layers, one for each micro-batch, each applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lamella.operators.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, name: str = "ingest", trigger: dict | None = None) -> StreamingQuery:
    """Start a query that puts ``stream`` (key, value and perhaps ord; NULL deletes) into ``store``.

    A batch that is run again after a crash is known by its number and left out. Within a batch ``ord`` decides (without it a
    key that occurs twice in one batch fails the query, as no row is its last); between batches, arrival.
    ``trigger``: as in writeStream.trigger, by default everything that is there, then stop.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.put_df(batch, f"{name}:{number}", rising=True)

    return stream.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
