"""Shared helpers: the shared folder, written stages and size-checked joins."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
#: Rows up to which a two-column side may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; a cluster's executors would each write to a disk of their own, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Stages:
    """Tables written to the shared folder in order to cut lineage; drop() deletes those that are done with."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            delete(self.spark, self.paths.pop(name))
        free_shuffles(self.spark)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """For tables that a result still reads: they go when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished stages go once the driver has collected its garbage; long jobs ask for it between stages."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def releasing(f):
    """f, a function over an iterator of batches; at its end, memory that it has freed goes back to the system. Workers live on between stages, idle or for other work, and the allocators would keep it."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    # musl and others have no malloc_trim
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows; else Spark shuffles both sides. df should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns: rows with equal ones are equal. Maps and variants, which can't be hashed, go in as JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _unhashed(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    # nulls leave a hash as it is, so where they are goes in too
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    return [F.xxhash64(F.lit(salt), nulls, *plain) for salt in (1, 2)]


def _unhashed(kind) -> bool:
    return any(name in kind.simpleString() for name in ("map<", "variant"))


def n_words(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
