"""Background ingestion as a stream of stage events: drained once, restarts read nothing twice, states only move forward, cancelled documents aren't committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages of a document with their progress.
STAGES = (("queued", 0), ("parsing", 10), ("embedding", 35), ("indexing", 70), ("saving", 90), ("ready", 100))


def drain(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 8) -> None:
    """Appends all new files of a folder to a table, and ends. A batch that is run again overwrites its own part."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


FAILED = "failed"


def latest_stage(events: DataFrame, key: str, stage: str, order: list[str]) -> DataFrame:
    """The last stage of each key, and the progress it reached."""
    progress = F.coalesce(F.element_at(_progress(), F.col(stage)), F.lit(0))
    return events.groupBy(key).agg(F.max_by(stage, F.struct(*order)).alias("stage"), F.count("*").alias("n_events"), F.max(progress).alias("progress"))


def _progress():
    return F.create_map(*[F.lit(x) for pair in STAGES for x in pair])


def states(events: DataFrame, key: str, stage: str, order: list[str]) -> DataFrame:
    """key, status, stage, progress by events in any order of arrival. A document only moves forward: an event of an earlier stage than one before it changes nothing, and neither does any after `ready` or `failed`. Failure keeps the progress reached before it. Unknown stages don't count."""
    at = F.element_at(_progress(), F.col(stage))
    known = events.where((F.col(stage) == FAILED) | at.isNotNull())
    listed = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(stage).alias("_stage"), at.alias("_at")))).alias("_all"))
    start = F.struct(F.lit(STAGES[0][0]).alias("stage"), F.lit(0).alias("progress"), F.lit(False).alias("over"))

    def step(s, e):
        failed = e["_stage"] == FAILED
        forward = F.coalesce(e["_at"] >= s["progress"], F.lit(False))
        moved = F.struct(e["_stage"].alias("stage"), F.when(failed, s["progress"]).otherwise(e["_at"]).alias("progress"), (failed | (e["_stage"] == STAGES[-1][0])).alias("over"))
        return F.when(~s["over"] & (failed | forward), moved).otherwise(s)

    last = listed.select(key, F.aggregate("_all", start, step).alias("_s"))
    status = F.when(F.col("_s.stage") == FAILED, FAILED).when(F.col("_s.stage") == STAGES[-1][0], STAGES[-1][0]).otherwise("processing")
    return last.select(key, status.alias("status"), F.col("_s.stage").alias("stage"), F.col("_s.progress").alias("progress"))


def without_cancelled(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows of a batch that may be committed: those whose key has no tombstone by now."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def export_ready(states_now: DataFrame, exported: DataFrame, key: str) -> DataFrame:
    """key and sync status of every ready document, for a sink of its own: what its results name is synced or failed by them, other ready ones are pending. Nothing here changes a document's own state."""
    ready = states_now.where(F.col("status") == STAGES[-1][0]).select(key)
    done = exported.groupBy(key).agg(F.max_by("ok", "attempt").alias("_ok"))
    return ready.join(done, key, "left").select(key, F.when(F.col("_ok"), "synced").when(~F.col("_ok"), "failed").otherwise("pending").alias("sync_status"))
