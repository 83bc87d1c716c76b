"""A mutable store of layers: puts and deletes become layers, a view resolves them, compaction merges them.

Small puts gather in a driver-side table (with a log, so they survive a crash) and become a layer at ``flush_entries``
keys; DataFrames become layers directly and never pass the driver. Layers are immutable tables; a version of the manifest
names those that count. Files that an old version names stay until ``vacuum``.
"""

from __future__ import annotations

import base64
import fcntl
import os
import threading
import time
import uuid
from collections.abc import Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.bounds import bounds, touches
from lamella.functions.model import LOG, check_entry, entries, pairs_of, to_bytes, validated
from lamella.operators import resolve as R
from lamella.operators.compaction import tier_or_all
from lamella.sources.files import Corrupt, Files, sealed, unsealed
from lamella.sources.manifest import Manifests
from lamella.sources.table import Meta, Table, store_sorted, text_or_none


class Options(NamedTuple):
    """``compact_threshold`` 0: never by itself. ``durability``: ``safe`` has each put on disk before it returns, ``balanced``
    at most ``sync_seconds`` later, whether or not another put follows, ``fast`` at a flush or at the close only."""

    compact_threshold: int = 8
    flush_entries: int = 4096
    durability: str = "safe"
    sync_seconds: float = 0.2
    compression: str = "zstd"


def was_applied(manifest: dict, batch_id: str) -> bool:
    """By its id, or by its number, ``stream:number``, where a stream of that name has come as far."""
    stream, _, number = batch_id.rpartition(":")
    return batch_id in manifest["applied"] or (number.isdigit() and int(number) <= manifest.get("streams", {}).get(stream, -1))


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()) -> None:  # noqa: B008
        if options.durability not in ("safe", "balanced", "fast"):
            raise ValueError(f"durability {options.durability!r} is unknown")
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.files = Files(spark, path)
        self.files.make(f"{self.path}/log")
        self._lock_file = self._locked()
        self.manifests = Manifests(spark, self.path)
        self.memtable: dict[bytes, bytes | None] = {}
        self._unlogged: list[tuple[bytes, bytes | None]] = []
        self._log_number = 0
        self._timer: threading.Timer | None = None
        self._log_error: BaseException | None = None
        self._write = threading.RLock()
        self._merging: threading.Thread | None = None
        self._merge_error: BaseException | None = None
        self.closed = False
        self._replay()

    # -- opening and closing

    def _locked(self):
        """One writer for each local store; elsewhere commits alone keep writers apart."""
        local = self.path.removeprefix("file://")
        if "://" in local:
            return None
        f = open(os.path.join(local, "LOCK"), "w")  # noqa: SIM115
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            f.close()
            raise RuntimeError(f"{self.path} is already locked") from None
        return f

    def _replay(self) -> None:
        """Batches of the log that are whole, in order, up to the first that is not; each batch counts entirely or not at all. What
        was cut off goes, so that nothing that is put from now on stands behind it."""
        names = [n for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit()]
        for i, name in enumerate(names):
            try:
                said = unsealed(self.files.read(f"{self.path}/log/{name}"), name)
            except (Corrupt, ValueError):
                said = None
            if said is None:
                for rest in names[i:]:
                    self.files.remove(f"{self.path}/log/{rest}")
                break
            self._log_number = int(name[:-5])
            for k, v in said["rows"]:
                self.memtable[base64.b64decode(k)] = None if v is None else base64.b64decode(v)

    def close(self) -> None:
        if self.closed:
            return
        try:
            self.wait()
            self._log(force=True)
        finally:
            if self._timer:
                self._timer.cancel()
            self.closed = True
            if self._lock_file:
                self._lock_file.close()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")
        if self._log_error:
            e, self._log_error = self._log_error, None
            raise RuntimeError("what was put before could not be logged") from e

    # -- writing

    def put(self, data: Mapping | Iterable) -> None:
        """Upsert pairs, entries or a mapping as one atomic batch; of equal keys the last wins, None deletes."""
        self._batch(pairs_of(data))

    def delete(self, keys: Iterable[str | bytes]) -> None:
        """Delete keys, whether they are there or not."""
        self._batch([(to_bytes(k), None) for k in keys])

    def _batch(self, rows: list[tuple[bytes, bytes | None]]) -> None:
        self._open()
        for k, v in rows:
            check_entry(k, v)
        if not rows:
            return
        with self._write:
            self._unlogged += rows
            try:
                self._log()
            except BaseException:
                del self._unlogged[-len(rows) :]  # the batch counts entirely or not at all
                raise
            self.memtable.update(rows)
            if len(self.memtable) >= self.options.flush_entries:
                self.flush()

    def _log(self, force: bool = False) -> None:
        """Write what is not in the log yet, now or, if ``balanced``, when the timer runs out. Files are named by a counter, so their
        order is that of the puts, whatever the clock does."""
        with self._write:
            if not self._unlogged:
                return
            if force or self.options.durability == "safe":
                code = lambda x: None if x is None else base64.b64encode(x).decode()
                name = f"{self.path}/log/{self._log_number + 1:020d}.json"
                if not self.files.create(name, sealed({"rows": [[code(k), code(v)] for k, v in self._unlogged]})):
                    raise RuntimeError("the log's next file is there already")
                self._log_number += 1
                self._unlogged = []
            elif self.options.durability == "balanced" and self._timer is None:
                self._timer = threading.Timer(self.options.sync_seconds, self._tick)
                self._timer.daemon = True
                self._timer.start()

    def _tick(self) -> None:
        with self._write:
            self._timer = None
            try:
                if not self.closed:
                    self._log(force=True)
            except BaseException as e:  # noqa: BLE001  told by the next call
                self._log_error = e

    def flush(self) -> int:
        """Make a layer of what is in memory; returns the number of layers. The view has every entry all the time: memory is emptied
        after the commit."""
        self._open()
        with self._write:
            if self.memtable:
                rows = dict(self.memtable)
                done = self.files.names(f"{self.path}/log")
                self._add(entries(self.spark, rows).select("key", "value"), 1)
                self.memtable, self._unlogged = {}, []
                for n in done:
                    self.files.remove(f"{self.path}/log/{n}")
            self._maybe_compact()
            return self.layer_count()

    def put_df(self, df: DataFrame, batch_id: str | None = None, rising: bool = False, unique: bool = False) -> bool:
        """Upsert a DataFrame (key, value and perhaps ord; NULL deletes) as one layer; a key that occurs twice needs ``ord``. ``unique``
        promises that none does, and spares an exchange. A ``batch_id`` that was applied before
        is left out, so a repeated micro-batch does nothing; returns whether it was applied. Every id is kept; of a stream's
        ids ``stream:number``, whose numbers are ``rising``, the greatest number alone, and lower ones count as applied."""
        self._open()
        with self._write:
            if batch_id is not None and was_applied(self.manifests.newest(), batch_id):
                return False
            self.flush()  # what was put before is older
            rows = validated(entries(self.spark, df))
            applied = self._add(rows.select("key", "value"), None, batch_id, rising, R.unique) if unique else self._add(R.last_wins(rows), None, batch_id, rising)
            self._maybe_compact()
            return applied

    def _add(self, rows: DataFrame, partitions: int | None, batch_id: str | None = None, rising: bool = False, within=None) -> bool:
        name = f"layers/{uuid.uuid4().hex}"
        table = store_sorted(self.spark, f"{self.path}/{name}", rows, self.options.compression, partitions, within)
        fresh = True

        def change(m: dict) -> dict | None:
            nonlocal fresh
            if batch_id is not None and was_applied(m, batch_id):
                fresh = False
                return None
            m["layers"].append({"seq": m["next_seq"], "first": m["next_seq"], "path": name, **table.meta.as_json()})
            m["next_seq"] += 1
            if batch_id is not None and rising:
                stream, _, number = batch_id.rpartition(":")
                m["streams"] = m.get("streams", {}) | {stream: int(number)}
            elif batch_id is not None:
                m["applied"] = [*m["applied"], batch_id]
            return m

        self.manifests.commit(change)
        if not fresh:
            self.files.remove(f"{self.path}/{name}")
        return fresh

    # -- reading

    def raw_log(self, version: dict | None = None, low: bytes | None = None, high: bytes | None = None, memory: bool = True) -> DataFrame:
        """(key, value, seq, ord) of a version's layers that can have a key in [low, high), and of memory as the newest."""
        m = version or self.manifests.newest()
        log = self.spark.createDataFrame([], LOG)
        for layer in m["layers"]:
            meta = Meta.of(layer)
            if touches(low, high, meta.least, meta.most):
                table = Table(self.spark, f"{self.path}/{layer['path']}")
                log = log.union(table.raw.select("key", "value", F.lit(layer["seq"]).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord")))
        if memory and self.memtable:
            rows = entries(self.spark, dict(self.memtable))
            log = log.union(rows.select("key", "value", F.lit(m["next_seq"]).cast("long").alias("seq"), F.lit(0).cast("long").alias("ord")))
        return log

    def view(self, keep_tombstones: bool = False, version: int | None = None) -> DataFrame:
        """The newest entry of every key, of one pinned version: the newest with what is in memory, or a committed one by its number."""
        self._open()
        return R.resolve(self.raw_log() if version is None else self.raw_log(self._version(version), memory=False), keep_tombstones)

    def versions(self) -> list[int]:
        """The committed versions that can be read."""
        return [v for v in self.manifests.versions() if self.manifests.read(v)]

    def _version(self, version: int) -> dict:
        m = self.manifests.read(version) if version in self.manifests.versions() else None
        if m is None:
            raise ValueError(f"version {version} is not kept")
        return m

    def get_entry(self, key: str | bytes) -> tuple[bool, bytes | None]:
        self._open()
        k = to_bytes(key)
        if k in self.memtable:
            return True, self.memtable[k]
        x = R.get_entry(R.resolve(self.raw_log(low=k, high=k + b"\0", memory=False), True), k).first()
        return x["found"], None if x["value"] is None else bytes(x["value"])

    def get(self, key: str | bytes) -> bytes | None:
        return self.get_entry(key)[1]

    def get_utf8(self, key: str | bytes) -> str | None:
        return text_or_none(self.get(key))

    def has(self, key: str | bytes) -> bool:
        return self.get(key) is not None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, other columns) with ``found`` and ``value``. Only layers that the keys' bounds touch are opened, and only rows
        of these keys are resolved."""
        self._open()
        return R.answered(self._of(R.Wanted(keys)), keys)

    def multi_has(self, keys: DataFrame) -> DataFrame:
        self._open()
        return keys.join(self._of(R.Wanted(keys)).select("key"), "key", "left_semi")

    def _of(self, wanted: R.Wanted) -> DataFrame:
        return R.resolve(wanted.of(self.raw_log(low=wanted.low, high=wanted.high)))

    def scan(self, start=None, end=None, prefix=None, ordered: bool = True) -> DataFrame:
        """Live entries of a seek, range or prefix; layers outside it are not opened."""
        self._open()
        low, high = bounds(start, end, prefix)
        return R.scan(R.resolve(self.raw_log(low=low, high=high)), start, end, prefix, ordered)

    def seek(self, start: str | bytes) -> DataFrame:
        return self.scan(start=start)

    def range(self, start: str | bytes, end: str | bytes) -> DataFrame:
        return self.scan(start, end)

    def prefix(self, p: str | bytes) -> DataFrame:
        return self.scan(prefix=p)

    def __iter__(self):
        for r in self.scan().toLocalIterator():
            yield bytes(r["key"]), bytes(r["value"])

    def layer_count(self) -> int:
        return len(self.manifests.newest()["layers"])

    def layers(self) -> list[dict]:
        """Each layer, oldest first: its number and the least that was merged into it, entries, tombstones, bytes, least and greatest key."""
        return [{"seq": x["seq"], "first": x["first"], **Meta.of(x)._asdict()} for x in self.manifests.newest()["layers"]]

    def memtable_len(self) -> int:
        return len(self.memtable)

    def next_seq(self) -> int:
        """The number that the next layer gets."""
        return self.manifests.newest()["next_seq"]

    def as_of(self, seq: int) -> DataFrame:
        """The live view as it was when layer ``seq`` was the newest, exact: from the newest version that is kept in which no layer mixes
        writes up to ``seq`` with later ones. Raises ValueError if there is none any more (``vacuum`` removes old versions)."""
        self._open()
        for v in reversed(self.manifests.versions()):
            m = self.manifests.read(v)
            if m and m["next_seq"] > seq and not any(x["first"] <= seq < x["seq"] for x in m["layers"]):
                return R.resolve(self.raw_log(m | {"layers": [x for x in m["layers"] if x["seq"] <= seq]}, memory=False))
        raise ValueError(f"layer {seq} was merged with newer ones, and no version from before is kept" if seq < self.next_seq() else f"there is no layer {seq} yet")

    # -- compaction

    def _maybe_compact(self) -> None:
        t = self.options.compact_threshold
        if t and self.layer_count() >= t:
            self.compact_async()

    def compact_async(self) -> None:
        """Merge tiers in the background until there are fewer layers than the threshold; one merge runs at a time."""
        with self._write:
            if self.is_compacting():
                return
            self._merging = threading.Thread(target=self._merge_loop, daemon=True)
            self._merging.start()

    def _merge_loop(self) -> None:
        try:
            while len(layers := self.manifests.newest()["layers"]) >= max(2, self.options.compact_threshold):
                tier = tier_or_all([x["rows"] for x in layers], self.options.compact_threshold)
                if tier is None or not self._merge(layers[tier[0] : tier[1]]):
                    break
        except BaseException as e:  # noqa: BLE001  told by wait()
            self._merge_error = e

    def is_compacting(self) -> bool:
        return self._merging is not None and self._merging.is_alive()

    def wait(self) -> None:
        """Until the background merge ends; its error, if it had one, is raised here."""
        if self._merging:
            self._merging.join()
        if self._merge_error:
            e, self._merge_error = self._merge_error, None
            raise e

    def _merge(self, layers: list[dict]) -> bool:
        """Replace neighbouring layers by one with the greatest of their numbers, so layers that were added meanwhile stay newer."""
        name = f"layers/{uuid.uuid4().hex}"
        log = R.stacked([Table(self.spark, f"{self.path}/{x['path']}").raw for x in layers])
        table = store_sorted(self.spark, f"{self.path}/{name}", log, self.options.compression, None, lambda rows: R.resolve(rows, keep_tombstones=True))
        gone = {x["path"] for x in layers}
        new = {"seq": max(x["seq"] for x in layers), "first": min(x["first"] for x in layers), "path": name, **table.meta.as_json()}
        done = False

        def change(m: dict) -> dict | None:
            nonlocal done
            done = gone <= {x["path"] for x in m["layers"]}
            if not done:
                return None
            m["layers"] = sorted([*(x for x in m["layers"] if x["path"] not in gone), new], key=lambda x: x["seq"])
            return m

        self.manifests.commit(change)
        if not done:
            self.files.remove(f"{self.path}/{name}")
        return done

    def compact(self) -> int:
        """Flush and merge all layers now; returns their number."""
        self._open()
        self.wait()
        with self._write:
            t, self.options = self.options, self.options._replace(compact_threshold=0)
            try:
                self.flush()
            finally:
                self.options = t
            while len(layers := self.manifests.newest()["layers"]) > 1:
                self._merge(layers)
            return self.layer_count()

    def vacuum(self, keep_versions: int = 1, spare_seconds: float | None = None) -> int:
        """Remove layers that none of the newest ``keep_versions`` versions names; returns how many went.

        It waits for a merge and holds back writes, so nothing that this store is about to commit goes. Where other writers are not kept
        out by a lock, folders that changed in the last ``spare_seconds`` stay (a day by default), as they may be about to be committed.
        """
        self._open()
        spare = (0 if self._lock_file else 86_400) if spare_seconds is None else spare_seconds
        with self._write:
            self.wait()
            kept = self.versions()[-keep_versions:]
            used = {x["path"] for v in kept for x in self.manifests.read(v)["layers"]}
            gone = [n for n in self.files.names(f"{self.path}/layers") if f"layers/{n}" not in used]
            gone = [n for n in gone if not spare or self.files.changed(f"{self.path}/layers/{n}") < time.time() - spare]
            for v in self.manifests.versions():
                if kept and v < kept[0]:
                    self.files.remove(f"{self.manifests.dir}/{v:010d}.json")
            for n in gone:
                self.files.remove(f"{self.path}/layers/{n}")
            return len(gone)
