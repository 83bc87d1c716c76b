"""A store behind one published table: writers work in a side directory, readers of the last save keep their view.

``path`` holds one directory for each save and a pointer version that names the newest; the side directory is ``path.store``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lamella.operators import resolve as R
from lamella.operators.store import Options, Store
from lamella.sources.files import Files, sealed, unsealed
from lamella.sources.table import Table, store_sorted


class Published:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()) -> None:  # noqa: B008
        self.spark, self.path, self.side = spark, path.rstrip("/"), f"{path.rstrip('/')}.store"
        self.files = Files(spark, path)
        seed = not self.files.exists(self.side) and self.pointer() is not None
        self.files.make(self.side)
        self.store = Store(spark, self.side, options)
        if seed:  # a table was brought along without its side directory: it is the oldest layer
            self.store.put_df(self.snapshot().raw, unique=True)
        self.put, self.delete, self.get, self.get_utf8, self.has = self.store.put, self.store.delete, self.store.get, self.store.get_utf8, self.store.has
        self.scan, self.seek, self.range, self.prefix = self.store.scan, self.store.seek, self.store.range, self.store.prefix
        self.multi_get, self.multi_has = self.store.multi_get, self.store.multi_has

    def __iter__(self):
        return iter(self.store)

    def pointer(self) -> str | None:
        names = [n for n in self.files.names(self.path) if n.startswith("save-") and n.endswith(".json")]
        for n in reversed(names):
            if said := unsealed(self.files.read(f"{self.path}/{n}"), n):
                return said["table"]  # one that is cut off is a save that never finished
        return None

    def snapshot(self) -> Table:
        """The last save, whatever was written or saved since this call."""
        name = self.pointer()
        if name is None:
            raise FileNotFoundError(f"{self.path} was never saved")
        return Table(self.spark, f"{self.path}/{name}")

    def save(self) -> Table:
        """Compact and publish all that was written, as a table that appears at once; an empty store gives an empty table."""
        self.store.compact()
        self.files.make(self.path)
        name = f"table-{uuid.uuid4().hex}"
        table = store_sorted(self.spark, f"{self.path}/{name}", R.resolve(self.store.raw_log(), keep_tombstones=True), self.store.options.compression)
        n = len([x for x in self.files.names(self.path) if x.startswith("save-")])
        while not self.files.create(f"{self.path}/save-{n:010d}.json", sealed({"table": name})):
            n += 1
        return table

    def close(self) -> None:
        """Keep the side directory, with what was not saved."""
        self.store.close()

    def export_and_close(self) -> str:
        """Save, close and remove the side directory: the published directory alone is the whole store."""
        self.save()
        self.store.close()
        self.files.remove(self.side)
        last = self.pointer()
        for n in self.files.names(self.path):
            if n.startswith("table-") and n != last:
                self.files.remove(f"{self.path}/{n}")
        return f"{self.path}/{last}"

    def view(self) -> DataFrame:
        return self.store.view()
