"""Small files on whatever file system a path names, through Hadoop's interface.

``create`` publishes a whole file under a name that must be free, or does nothing:

* on the driver's own disk: written aside, synced, and linked to its name, which fails if the name is taken;
* on HDFS and file systems of its kind: written aside, synced, and renamed without overwriting, one step of the name node;
* on object stores (``CONDITIONAL``): a conditional put; a store that has no such put is no place for two writers.

So a reader never meets half a file, and of two writers of one name exactly one succeeds.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

from pyspark.sql import SparkSession

#: Schemes of stores that rename by copying but can put an object on the condition that it is new.
CONDITIONAL = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "obs")


class Corrupt(Exception):
    """A table or a version that fails validation."""


def sealed(said: dict) -> bytes:
    """JSON with its checksum, each on a line."""
    body = json.dumps(said).encode()
    return body + b"\n%08x\n" % zlib.crc32(body)


def unsealed(raw: bytes, name: str) -> dict | None:
    """What ``sealed`` was given; None if the end is cut off. Raises Corrupt if the checksum differs."""
    if not raw.endswith(b"\n") or raw.count(b"\n") < 2:
        return None
    body, crc, _ = raw.rsplit(b"\n", 2)
    if b"%08x" % zlib.crc32(body) != crc:
        raise Corrupt(f"{name} is damaged: its checksum differs")
    return json.loads(body)


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.scheme = self.fs.getUri().getScheme()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        """What lies in a folder, but for files still being written."""
        return sorted(n for n in (x.getPath().getName() for x in self.fs.listStatus(self.path(p))) if not (n.startswith(".") and n.endswith(".aside"))) if self.exists(p) else []

    def size(self, p: str) -> int:
        return int(self.fs.getContentSummary(self.path(p)).getLength())

    def changed(self, p: str) -> float:
        """When a folder or anything right in it last changed, in seconds."""
        at = self.path(p)
        return max([self.fs.getFileStatus(at).getModificationTime(), *(x.getModificationTime() for x in self.fs.listStatus(at))]) / 1000

    def make(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def remove(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} can't be renamed to {b}")

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, p: str, data: bytes, sync: bool = True) -> bool:
        """Publish a file that must not be there yet; False if it is. ``sync``: it is on disk when this returns."""
        if self.scheme == "file":
            return self._link(self.fs.makeQualified(self.path(p)).toUri().getPath(), data, sync)
        if self.scheme in CONDITIONAL:
            return self._put(p, data)
        return self._renamed(p, data, sync)

    def _link(self, p: str, data: bytes, sync: bool) -> bool:
        folder, name = os.path.split(p)
        aside = f"{folder}/.{name}.{uuid.uuid4().hex}.aside"
        try:
            with open(aside, "wb") as f:
                f.write(data)
                f.flush()
                if sync:
                    os.fsync(f.fileno())
            os.link(aside, p)
        except FileExistsError:
            return False
        finally:
            if os.path.exists(aside):
                os.unlink(aside)
        if sync:
            at = os.open(folder, os.O_RDONLY)
            try:
                os.fsync(at)
            finally:
                os.close(at)
        return True

    def _put(self, p: str, data: bytes) -> bool:
        try:
            stream = self.fs.createFile(self.path(p)).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
            try:
                stream.write(bytearray(data))
            finally:
                stream.close()  # the condition is tested here
        except Exception:
            if self.exists(p):
                return False
            raise
        return True

    def _renamed(self, p: str, data: bytes, sync: bool) -> bool:
        folder, name = p.rsplit("/", 1)
        aside = self.path(f"{folder}/.{name}.{uuid.uuid4().hex}.aside")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(data))
            if sync:
                stream.hsync()
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(self.path(p)), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            self.fs.delete(aside, False)
            if self.exists(p):
                return False
            raise
        return True
