"""The simple interface: one named store with text, bytes and JSON values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from lamella.functions.model import decode_value, decoded, encode_value, to_bytes
from lamella.operators.published import Published
from lamella.operators.store import Options
from lamella.sources.table import Table


class Lamella:
    """``with Lamella(spark, path) as db: db.set("a", {"n": 1}); db.get("a")``.

    Values that are neither text nor bytes are stored as JSON and come back parsed. Options are those of a store; None stands
    for a default and 0 turns compaction off.
    """

    def __init__(self, spark: SparkSession, path: str, compact_threshold: int | None = None, flush_entries: int | None = None, durability: str | None = None) -> None:
        said = {"compact_threshold": compact_threshold, "flush_entries": flush_entries, "durability": durability}
        self.inner = Published(spark, path, Options(**{k: v for k, v in said.items() if v is not None}))

    def set(self, key: str | bytes, value: object) -> None:
        self.inner.put([(to_bytes(key), encode_value(value))])

    def set_many(self, data: Mapping) -> None:
        self.inner.put([(to_bytes(k), encode_value(v)) for k, v in data.items()])

    def get(self, key: str | bytes) -> object:
        return decode_value(self.inner.get(key))

    def get_bytes(self, key: str | bytes) -> bytes | None:
        return self.inner.get(key)

    def get_utf8(self, key: str | bytes) -> str | None:
        return self.inner.get_utf8(key)

    def has(self, key: str | bytes) -> bool:
        return self.inner.has(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, other columns) with found, value, text and json: one bulk look-up."""
        return decoded(self.inner.multi_get(keys))

    def delete(self, *keys: str | bytes) -> None:
        self.inner.delete(keys)

    def _rows(self, df: DataFrame) -> Iterator[tuple[bytes, object]]:
        for r in df.toLocalIterator():
            yield bytes(r["key"]), decode_value(r["value"])

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        return self._rows(self.inner.scan())

    def prefix(self, p: str | bytes) -> Iterator[tuple[bytes, object]]:
        return self._rows(self.inner.prefix(p))

    def range(self, start: str | bytes, end: str | bytes) -> Iterator[tuple[bytes, object]]:
        return self._rows(self.inner.range(start, end))

    def seek(self, start: str | bytes) -> Iterator[tuple[bytes, object]]:
        return self._rows(self.inner.seek(start))

    def view(self) -> DataFrame:
        """(key, value, text, json): the live view, for bulk work."""
        return decoded(self.inner.view())

    def save(self) -> Table:
        return self.inner.save()

    def snapshot(self) -> Table:
        return self.inner.snapshot()

    def close(self) -> str:
        """Save everything into the published directory and remove the side directory; returns the table's path."""
        return self.inner.export_and_close()

    def __enter__(self) -> Lamella:
        return self

    def __exit__(self, *_) -> None:
        if not self.inner.store.closed:
            self.close()
