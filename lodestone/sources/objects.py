"""Single objects by Hadoop's file systems: put, fetch, digest, delete; and collections of vectors, whose size is settled when they are made. Tables and many files are left to Spark's own readers and writers."""

from __future__ import annotations

import hashlib
import io
import json
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
#: A fetched object is held in memory up to so many bytes, and in a file beyond.
IN_MEMORY = 8 << 20


class Objects:
    """Objects below a folder on any file system that Spark reaches. Names lead nowhere else."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        if not name or name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"no name of an object: {name!r}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, name: str, content: bytes | BinaryIO) -> int:
        """Writes an object piece by piece, under another name until it is whole; returns its bytes. One that is there is replaced."""
        fs, path = self._at(name)
        _, part = self._at(f"{name}.part")
        source, n = io.BytesIO(content) if isinstance(content, bytes) else content, 0
        out = fs.create(part, True)
        try:
            while piece := source.read(PIECE):
                out.write(piece)
                n += len(piece)
        except BaseException:
            out.close()
            fs.delete(part, False)
            raise
        out.close()
        fs.delete(path, False)
        if not fs.rename(part, path):
            raise OSError(f"{name} could not be put")
        return n

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def pieces(self, name: str) -> Iterator[bytes]:
        fs, path = self._at(name)
        if not fs.exists(path):
            raise FileNotFoundError(name)
        stream = fs.open(path)
        try:
            while piece := bytes(stream.readNBytes(PIECE)):
                yield piece
        finally:
            stream.close()

    def fetch(self, name: str) -> BinaryIO:
        """The object as a file of its own, at its beginning."""
        out = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)
        try:
            for piece in self.pieces(name):
                out.write(piece)
        except BaseException:
            out.close()
            raise
        out.seek(0)
        return out

    def digest(self, name: str) -> str:
        """SHA-256 in hexadecimal digits."""
        made = hashlib.sha256()
        for piece in self.pieces(name):
            made.update(piece)
        return made.hexdigest()

    def delete(self, name: str) -> None:
        """An object that isn't there is no error."""
        fs, path = self._at(name)
        fs.delete(path, False)


#: What a collection settles, beside its points.
SPECIFICATION = "collection.json"


def ensure_collection(objects: Objects, name: str, size: int, **index: int) -> dict:
    """Makes a collection for vectors of so many numbers, or checks one that is there; settings of its index (cells, probes) are put anew where they differ. Returns what holds now."""
    if size <= 0:
        raise ValueError("vectors need a size above 0")
    at, wanted = f"{name}/{SPECIFICATION}", {"size": size, "metric": "cosine", "index": index}
    if objects.exists(at):
        with objects.fetch(at) as f:
            there = json.load(f)
        if there["size"] != size:
            raise ValueError(f"collection {name} holds vectors of {there['size']} numbers, not {size}")
        wanted["index"] = there["index"] | index
        if wanted == there:
            return there
    objects.put(at, json.dumps(wanted, sort_keys=True).encode())
    return wanted


def of_size(points: DataFrame, size: int, vector: str = "embedding") -> DataFrame:
    """points, of which each vector must have the collection's size; another, or none, is an error when they are read."""
    n = F.coalesce(F.size(vector), F.lit(-1))
    right = F.when(n != size, F.raise_error(F.concat(F.lit(f"the collection needs vectors of {size} numbers, not "), n.cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return points.where(right)
