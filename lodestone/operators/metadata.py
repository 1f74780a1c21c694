"""Documents, chunks, folders, conversations: latest state, replacement, deletion, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ancestors, chunk_at, chunk_starts


def chunks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, chunk_index, text of the fixed windows. The text is made once and cut natively."""
    df = docs.select(key, text.alias("_t")).withColumn("chunk_index", F.explode(chunk_starts(F.col("_t"))))
    return df.select(key, "chunk_index", chunk_at(F.col("_t"), F.col("chunk_index")).alias("text"))


def latest(events: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """The last state of each key; map-side aggregation keeps one row for each key and task."""
    return events.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of new's keys replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each key, new rows before old ones. Of new rows that repeat a key the last by `order` counts, or by all their columns."""
    last = F.max_by(F.struct(*new.columns), F.col(order) if order else F.struct(*new.columns))
    return replace_rows(old, new.groupBy(F.col(key).alias("_key")).agg(last.alias("_row")).select("_row.*"), key)


def in_subtree(folder: Column, target: str) -> Column:
    return (folder == target) | folder.startswith(f"{target}/")


def first_of(df: DataFrame, by: list[str], order: str) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(order)) == 1


def folder_rollup(docs: DataFrame, folder: str = "folder", status: str = "status", chunk_count: str = "chunk_count", updated: str | None = None) -> DataFrame:
    """A row for each folder and folder above: documents, chunks and states below it, and the last update if its column is named. States but processing and ready count as failed. Counted by leaf folder first, so the explosion is over folders and not documents."""
    last = [F.max(updated).alias("updated")] if updated else []
    own = docs.groupBy("kb", folder).agg(
        F.count("*").alias("n"), F.sum(chunk_count).alias("chunks"), F.count_if(F.col(status) == "processing").alias("processing"), F.count_if(F.col(status) == "ready").alias("ready"), *last
    )
    every = own.withColumn("path", F.explode(ancestors(F.col(folder))))
    total = every.groupBy("kb", "path").agg(*[F.sum(c).alias(c) for c in ("n", "chunks", "processing", "ready")], *([F.max("updated").alias("updated")] if updated else []))
    return total.withColumn("failed", F.col("n") - F.col("processing") - F.col("ready"))


# States of a file that is taken in, and those of them that are over without fault.
QUEUE, DONE = ("queued", "uploading", "done", "skipped", "failed"), ("done", "skipped")


def queue_rollup(files: DataFrame, folder: str = "folder", status: str = "status") -> DataFrame:
    """A row for each folder and folder above of files that are being taken in, by kb: how many are in each state, the share in percent that is done or skipped, and the folder's state."""
    own = files.groupBy("kb", folder).agg(F.count("*").alias("n"), *[F.count_if(F.col(status) == s).alias(s) for s in QUEUE])
    total = own.withColumn("path", F.explode(ancestors(F.col(folder)))).groupBy("kb", "path").agg(*[F.sum(c).alias(c) for c in ("n", *QUEUE)])
    share = F.round(100.0 * (F.col("done") + F.col("skipped")) / F.col("n")).cast("int")
    state = F.when(F.col("uploading") > 0, "uploading").when(F.col("failed") > 0, "failed").when(F.col("queued") > 0, "queued").when(F.col("skipped") == F.col("n"), "skipped").otherwise("done")
    return total.withColumns({"progress": share, "state": state})


def importable(files: DataFrame, existing: DataFrame, suffixes: tuple[str, ...], path: str = "path") -> DataFrame:
    """Files (kb, path) to take in: no system files, a suffix that is handled, and not there already."""
    plain = F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(plain, "/"), -1)
    system = (name == ".ds_store") | name.startswith("._") | F.contains(plain, F.lit("/__macosx/"))
    return files.where(~system & F.regexp_extract(name, r"(\.[^.]+)$", 1).isin(*suffixes)).join(existing.select("kb", path).distinct(), ["kb", path], "left_anti")


def take_attachments(chosen: DataFrame, by: list[str], identity: list[str], order: str, most: int = 10) -> DataFrame:
    """The first `most` distinct attachments of each group in order, with how many of the group were passed over."""
    once = chosen.groupBy(*by, *identity).agg(F.min(order).alias("_at"), F.count("*").alias("_n"))
    group = W.partitionBy(*by)
    placed = once.withColumns({"place": F.row_number().over(group.orderBy("_at")), "_all": F.sum("_n").over(group), "_once": F.count("*").over(group)})
    return placed.where(F.col("place") <= most).select(*by, *identity, "place", (F.col("_all") - F.least(F.col("_once"), F.lit(most))).alias("skipped"))


def size_gate(length: Column, most: int) -> Column:
    """Whether a file may be taken in: not empty, and within the limit; 0 is no limit."""
    return (length > 0) & (length <= most if most > 0 else F.lit(True))


def folder_state(processing: Column, failed: Column) -> Column:
    return F.when(processing > 0, "processing").when(failed > 0, "failed").otherwise("ready")
