"""Changes to tables of tenants, documents, chunks, points, conversations and messages: each gives the tables as they are afterwards, lazily. Ownership is checked in the plan, so a wrong tenant changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, strip

Tables = dict[str, DataFrame]
#: Tables below a tenant, and those of them that hold a document's rows.
OF_TENANT, OF_DOCUMENT = ("messages", "conversations", "chunks", "points", "documents"), ("chunks", "points", "documents")


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows appended. A key that is there already is an error when the result is read."""
    there = table.select(F.col(key).alias("_key")).distinct()
    known = F.when(F.col("_key").isNotNull(), F.raise_error(F.concat(F.lit(f"{key} exists: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return table.unionByName(rows.join(there, F.col(key) == F.col("_key"), "left").where(known).drop("_key"))


def owned(table: DataFrame, tenants: DataFrame, owner: str) -> DataFrame:
    """Rows of an owner's tenants; those of others aren't to be found."""
    return table.join(tenants.where(F.col("owner") == owner).select("kb").distinct(), "kb", "left_semi")


def _without(tables: Tables, names: tuple[str, ...], gone: DataFrame, on: list[str]) -> Tables:
    gone = gone.select(*on).distinct()
    return tables | {n: tables[n].join(gone, on, "left_anti") for n in names if n in tables}


def delete_documents(tables: Tables, wanted: DataFrame) -> Tables:
    """wanted: kb, document_id. Documents with all their chunks and points go, if they are in the tenant that is named."""
    found = tables["documents"].join(wanted.distinct(), ["kb", "document_id"], "left_semi").select("kb", "document_id")
    return _without(tables, OF_DOCUMENT, found, ["kb", "document_id"])


def folder_target(path: Column) -> Column:
    """A folder's path by its trimmed parts; null for none, and for one that leads out."""
    parts = F.filter(F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), strip), lambda p: ~p.isin("", "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def documents_below(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: kb, path. kb, document_id and the target of each document in or below a folder. Documents meet targets by the folders above them, by value."""
    own = F.btrim(F.replace(F.coalesce("folder", F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))
    parts = F.split(own, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    targets = wanted.select("kb", folder_target(F.col("path")).alias("target")).where("target is not null").distinct()
    return documents.select("kb", "document_id", F.explode(above).alias("target")).join(targets, ["kb", "target"])


def delete_folders(tables: Tables, wanted: DataFrame) -> tuple[Tables, DataFrame]:
    """The tables without documents in or below the folders, and for each folder wanted how many they were: 0 for '' and for paths that lead out."""
    found = documents_below(tables["documents"], wanted)
    counts = found.groupBy("kb", "target").agg(F.count("*").alias("n"))
    told = wanted.withColumn("target", folder_target(F.col("path"))).join(counts, ["kb", "target"], "left").select("kb", "path", F.coalesce("n", F.lit(0)).alias("n"))
    return _without(tables, OF_DOCUMENT, found, ["kb", "document_id"]), told


def delete_tenants(tables: Tables, wanted: DataFrame) -> Tables:
    """Tenants with all that is below them."""
    return _without(tables, (*OF_TENANT, "tenants"), wanted, ["kb"])


def delete_conversations(tables: Tables, wanted: DataFrame) -> Tables:
    return _without(tables, ("messages", "conversations"), wanted, ["conversation_id"])


def append_messages(tables: Tables, new: DataFrame) -> Tables:
    """Messages are added, and their conversations updated by the last of them. Messages to conversations that aren't there go."""
    known = new.join(tables["conversations"].select("conversation_id"), "conversation_id", "left_semi")
    last = known.groupBy("conversation_id").agg(F.max("created_at").alias("_last"))
    talks = tables["conversations"].join(last, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")
    return tables | {"messages": tables["messages"].unionByName(known), "conversations": talks}


def rename_conversations(talks: DataFrame, titles: DataFrame) -> DataFrame:
    """titles: conversation_id, title. Trimmed titles replace the old ones; blank ones don't."""
    new = titles.select("conversation_id", strip(F.col("title")).alias("_title")).where("_title <> ''").groupBy("conversation_id").agg(F.max("_title").alias("_title"))
    return talks.join(new, "conversation_id", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")


def without_hash(documents: DataFrame) -> DataFrame:
    """Documents whose content hash is missing and that didn't fail."""
    return documents.where("content_hash is null and status <> 'failed'")


def fill_hashes(documents: DataFrame, contents: DataFrame, key: str = "document_id") -> DataFrame:
    """Missing hashes are made from contents (key, content); documents whose content isn't there, and failed ones, stay as they are."""
    found = without_hash(documents).select(key).join(contents, key).select(key, content_hash(F.col("content")).alias("_hash"))
    return documents.join(found, key, "left").withColumn("content_hash", F.coalesce("content_hash", "_hash")).drop("_hash")


def same_model(rows: DataFrame, tenants: DataFrame, model: str) -> DataFrame:
    """rows of tenants, of which each must have the embedding model given; another is an error when the result is read."""
    known = tenants.select("kb", "embedding_model")
    right = F.when(F.col("embedding_model") != model, F.raise_error(F.concat(F.lit("another embedding model: "), F.col("embedding_model"))).cast("boolean")).otherwise(F.lit(True))
    return rows.join(known, "kb").where(right).drop("embedding_model")
