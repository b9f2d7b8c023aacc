"""Small files and folders on whatever store Spark writes to, and outputs that appear as a whole.

Several outputs are made under an attempt of their own.  The attempt becomes a version by one rename, and ``current.json`` is then replaced by one that names
it: until that last rename readers see the version before, and what a crash leaves behind is never looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from .digest import path_digest

CURRENT = "current.json"
#: Versions that stay beside the current one, for readers that have just opened them.
KEPT_VERSIONS = 1


class Store:
    """The file system of a folder, by Hadoop's client."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.folder = str(folder).rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Entries of a folder, sorted; none if there is no such folder."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, parts: Iterable[str]) -> None:
        """A file as a whole: its parts go to another name, which is then renamed over it."""
        own = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(own), False)
        try:
            for part in parts:
                stream.write(bytearray(part.encode()))
            stream.hsync()
        finally:
            stream.close()
        self.rename(own, name)

    def rename(self, name: str, to: str) -> None:
        """Replaces ``to`` if it is a file."""
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        context.rename(self._path(name), self._path(to), array)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def digest(self, name: str) -> str:
        """Of a file's bytes, or of the lines of a folder's parts however they are cut."""
        if self.fs.getFileStatus(self._path(name)).isDirectory():
            return path_digest(self.spark, self.at(name))
        return hashlib.sha256(self.read(name).encode()).hexdigest()


def publish(spark: SparkSession, folder: str | Path, make: Callable[[Store], None], about: dict | None = None) -> dict:
    """Let ``make`` write outputs into an attempt, then make them current together; returns what ``current.json`` says."""
    name = uuid.uuid4().hex
    top = Store(spark, folder)
    attempt = f"attempt-{name}"
    inner = Store(spark, top.at(attempt))
    inner.fs.mkdirs(inner._path(""))
    try:
        make(inner)
        entries = {n: inner.digest(n) for n in inner.names()}
    except BaseException:
        top.delete(attempt)
        raise
    before = json.loads(top.read(CURRENT))["version"] if top.exists(CURRENT) else None
    version = f"version-{name}"
    top.rename(attempt, version)
    said = {"formatVersion": 1, "version": version, "before": before, "entries": entries, **(about or {})}
    top.write(CURRENT, [json.dumps(said, indent=2) + "\n"])
    keep = [version, before][: 1 + KEPT_VERSIONS]
    for old in top.names():
        if old.startswith("version-") and old not in keep:
            top.delete(old)
    return said


def resolve(folder: str | Path) -> Path:
    """Where the current outputs of a local folder lie: its current version, or the folder itself if nothing was published in it."""
    said = Path(folder) / CURRENT
    return Path(folder) / json.loads(said.read_text())["version"] if said.is_file() else Path(folder)
