"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing to target weights, token files.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept. All but the last return the columns of documents, whatever their names and types. Rows without text fail the quality rules; a null source is a source of its own; rows that repeat an id are told apart by all their columns; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, near_duplicates, quality_rules, token_files
from lodestone.llm._common import delete, delete_at_exit, new_path, row_keys, small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    names = [F.col(f"_d.{c}").alias(c) for c in docs.columns]
    book = quality_rules.ledger(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_d"), F.col("text").alias("_text")), "_text")
    # measured_row isn't deterministic, so the filter stays above the measurements and each is made once
    return quality_rules.apply_policy(book, quality_rules.CURRENT, "_kept").where("_kept and measured_row >= 0").select(*names)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Rows without an id stay; of rows that repeat an id and a text one stays, the first by a hash of all its columns; unequal texts of one id are documents of their own."""
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id")
    if repeated.isEmpty():
        found = near_duplicates.near_duplicates(docs)
        copies = small(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")))
        return docs.join(copies, F.col("doc_id") == F.col("_id"), "left_anti")
    names = docs.columns
    keyed = docs.join(repeated, F.col("doc_id") == F.col("_id"), "left").withColumn("_key", F.when(F.col("_id").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    found = near_duplicates.near_duplicates(keyed.select("_key", "text"), key="_key").where("_key is not null").select(F.col("_key").alias("_of"), "component_id").distinct()
    found = found.join(keyed.where("doc_id is not null").select("_key", "doc_id").distinct(), F.col("_of") == F.col("_key")).groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("_first"))
    kept = keyed.join(found.select(F.col("_first._key").alias("_of")), F.col("_key") == F.col("_of"), "left_semi")
    again = F.col("_id").isNotNull()
    own = kept.select(*names)
    once = kept.where(again).groupBy("_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*row_keys(own))).alias("_row"))
    return docs.where("doc_id is null").unionByName(kept.where(~again).select(*names)).unionByName(once.select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and their index."""
    path = new_path(spark, "token-files")
    delete_at_exit(spark, path)
    token_files.write_token_files(docs, path)
    return token_files.token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_files", tokenise),
]
#: Near duplicates, the seeded mix and token ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = []
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        written.append(path)
        for old in written[:-1]:
            delete(spark, old)
            written.remove(old)
    # the result still reads the last one
    delete_at_exit(spark, written[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
