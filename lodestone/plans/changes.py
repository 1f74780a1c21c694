"""Queries on changes to the store, ingestion and files. Bindings besides those of the catalogue: points are vectors whose tenant is src and their label; a conversation's tenant is src and its number modulo 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metadata, store
from ..streaming import ingest
from .catalogue import DOCS, docs, query, read


def _tables(spark: SparkSession, d: str) -> store.Tables:
    own = docs(spark, d).select("kb", F.col("doc_id").alias("document_id"), "folder", "status")
    points = read(spark, d, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("kb"), F.col("vec_id").alias("document_id"))
    said = read(spark, d, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("kb"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"))
    talks = said.groupBy("kb", "conversation_id").agg(F.max("created_at").alias("updated_at")).withColumn("title", F.concat(F.lit("talk "), F.col("conversation_id").cast("string")))
    return {"tenants": own.select("kb").distinct(), "documents": own, "points": points, "conversations": talks, "messages": said}


def _counts(tables: store.Tables, names) -> DataFrame:
    out = None
    for n in names:
        part = tables[n].groupBy("kb").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "kb", "n")
        out = part if out is None else out.unionByName(part)
    return out


STORE = f"""{DOCS}, points as (select 'src' || label as kb, vec_id as document_id from embeddings), said as (select 'src' || (conv_id % 5) as kb, conv_id as conversation_id, turn as created_at from conversations),
talks as (select kb, conversation_id, max(created_at) as updated_at from said group by all)"""


@query(f"with {DOCS} select doc_id as document_id, kb from docs")
def insert_documents(spark: SparkSession, d: str) -> DataFrame:
    own = _tables(spark, d)["documents"].select("document_id", "kb")
    return store.insert(own.where("document_id % 2 = 0"), own.where("document_id % 2 = 1"), "document_id")


@query(f"with {DOCS} select doc_id as document_id, kb from docs where kb in ('src1', 'src3')")
def owned_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the tenants of one owner."""
    t = _tables(spark, d)
    tenants = t["tenants"].withColumn("owner", F.when(F.col("kb").isin("src1", "src3"), "a").otherwise("b"))
    return store.owned(t["documents"], tenants, "a").select("document_id", "kb")


@query(f"""with {STORE}, gone as (select kb, doc_id as document_id from docs where doc_id % 10 = 0)
select 'documents' as name, kb, count(*) as n from docs where doc_id % 10 <> 0 group by kb union all select 'points', p.kb, count(*) from points p where not exists (select 1 from gone g where g.kb = p.kb and g.document_id = p.document_id) group by p.kb""")
def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the documents goes with their points; another tenth is asked for under a wrong tenant, and stays."""
    t = _tables(spark, d)
    wanted = t["documents"].where("document_id % 10 = 0").select("kb", "document_id").union(t["documents"].where("document_id % 10 = 1").select(F.concat("kb", F.lit("x")), "document_id"))
    return _counts(store.delete_documents(t, wanted), ("documents", "points"))


FOLDERS = ["en", " de \\ src1/.", "", "../en", "fr/src2", "es/none"]


@query(f"""with {DOCS}, w as (select kb, p as path, t from (select distinct kb from docs), (values ('en', 'en'), (' de \\ src1/.', 'de/src1'), ('', null), ('../en', null), ('fr/src2', 'fr/src2'), ('es/none', 'es/none')) v(p, t))
select w.kb, path, count(d.doc_id) as n from w left join docs d on d.kb = w.kb and (d.folder = t or starts_with(d.folder, t || '/')) group by w.kb, path""")
def delete_folder_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each deletion of a folder takes: none for '' and for paths that lead out."""
    t = _tables(spark, d)
    return store.delete_folders(t, t["tenants"].select("kb", F.explode(F.array(*[F.lit(p) for p in FOLDERS])).alias("path")))[1]


@query(f"""with {STORE} select 'tenants' as name, kb, 1 as n from (select distinct kb from docs) where kb <> 'src1' union all select 'documents', kb, count(*) from docs where kb <> 'src1' group by kb union all select 'points', kb, count(*) from points where kb <> 'src1' group by kb
union all select 'conversations', kb, count(*) from talks where kb <> 'src1' group by kb union all select 'messages', kb, count(*) from said where kb <> 'src1' group by kb""")
def delete_tenant(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return _counts(store.delete_tenants(t, t["tenants"].where("kb = 'src1'")), ("tenants", "documents", "points", "conversations", "messages"))


@query(f"with {STORE} select 'conversations' as name, kb, count(*) as n from talks where conversation_id % 7 <> 0 group by kb union all select 'messages', kb, count(*) from said where conversation_id % 7 <> 0 group by kb")
def delete_conversations(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return _counts(store.delete_conversations(t, t["conversations"].where("conversation_id % 7 = 0")), ("conversations", "messages"))


@query(f"with {STORE} select conversation_id, updated_at + case when conversation_id % 3 = 0 then 1 else 0 end as updated_at, (select count(*) from said s where s.conversation_id = t.conversation_id) + case when conversation_id % 3 = 0 then 1 else 0 end as n from talks t")
def append_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every third conversation gets a message, and so would one that isn't there."""
    t = _tables(spark, d)
    new = t["conversations"].where("conversation_id % 3 = 0").select("kb", "conversation_id", (F.col("updated_at") + 1).alias("created_at"))
    after = store.append_messages(t, new.union(new.select("kb", F.col("conversation_id") - 1_000_000, "created_at")))
    counts = after["messages"].groupBy("conversation_id").agg(F.count("*").alias("n"))
    return after["conversations"].select("conversation_id", "updated_at").join(counts, "conversation_id")


@query(f"with {STORE} select conversation_id, case when conversation_id % 2 = 0 and conversation_id % 5 <> 0 then 'T ' || conversation_id else 'talk ' || conversation_id end as title from talks")
def rename_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Even conversations get a trimmed title, but for blank ones."""
    talks = _tables(spark, d)["conversations"]
    title = F.when(F.col("conversation_id") % 5 == 0, "  \t").otherwise(F.concat(F.lit(" \tT "), F.col("conversation_id").cast("string"), F.lit("\n")))
    return store.rename_conversations(talks, talks.where("conversation_id % 2 = 0").select("conversation_id", title.alias("title"))).select("conversation_id", "title")


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("doc_id").alias("document_id"), "kb", "status", F.when(F.col("doc_id") % 3 != 0, text.content_hash(F.col("text"))).alias("content_hash"))


@query(f"with {DOCS} select doc_id as document_id, kb from docs where doc_id % 3 = 0 and status <> 'failed'")
def missing_hash_documents(spark: SparkSession, d: str) -> DataFrame:
    return store.without_hash(_hashed(spark, d)).select("document_id", "kb")


@query(f"with {DOCS} select doc_id as document_id, case when doc_id % 3 <> 0 or (status <> 'failed' and doc_id % 2 = 0) then sha256(text) end as content_hash from docs")
def fill_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Missing hashes, from the contents that are there."""
    contents = read(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return store.fill_hashes(_hashed(spark, d), contents).select("document_id", "content_hash")


@query(f"with {DOCS} select doc_id, kb from docs where kb = 'src' || (doc_id % 6)")
def cross_tenant_guard(spark: SparkSession, d: str) -> DataFrame:
    """Requests of documents under a tenant: those that the tenant has."""
    asked = read(spark, d, "documents").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 6).cast("string")).alias("kb"))
    return docs(spark, d).select("doc_id", "kb").join(asked, ["doc_id", "kb"], "left_semi")


@query(f"with {STORE} select p.kb, count(*) as n from points p where p.kb in (select kb from docs) group by p.kb")
def embedding_model_check(spark: SparkSession, d: str) -> DataFrame:
    """Points of tenants, all of which have the engine's model; another would be an error."""
    t = _tables(spark, d)
    return store.same_model(t["points"], t["tenants"].withColumn("embedding_model", F.lit("hashing-16")), "hashing-16").groupBy("kb").agg(F.count("*").alias("n"))


@query(f"with {DOCS}, f as (select doc_id, kb, status, case when doc_id % 4 <> 0 then folder end as folder from docs) select doc_id from f where coalesce(folder, '') = '' and status <> 'failed'")
def rootless_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents at the root: a missing folder is the root."""
    f = docs(spark, d).withColumn("folder", F.when(F.col("doc_id") % 4 != 0, F.col("folder")))
    return f.where((F.coalesce("folder", F.lit("")) == "") & (F.col("status") != "failed")).select("doc_id")


@query("select user_id, cast(count_if(event_type <> 'error') as bigint) as succeeded, cast(count_if(event_type = 'error') as bigint) as failed from events group by user_id")
def import_tally(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    return read(spark, d, "events").groupBy("user_id").agg(F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"))


@query("with c as (select conv_id % 5 as kb, conv_id, max(turn) as updated, min(turn) as created from conversations group by all) select kb, conv_id, row_number() over (partition by kb order by updated desc, created desc, conv_id) as place from c")
def conversation_order(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of a tenant, the last updated first, and then the last made."""
    from pyspark.sql import Window as W

    c = read(spark, d, "conversations").groupBy((F.col("conv_id") % 5).alias("kb"), "conv_id").agg(F.max("turn").alias("updated"), F.min("turn").alias("created"))
    return c.select("kb", "conv_id", F.row_number().over(W.partitionBy("kb").orderBy(F.desc("updated"), F.desc("created"), "conv_id")).cast("long").alias("place"))


@query(f"with {DOCS} select kb, doc_id, row_number() over (partition by kb order by n_chars desc, doc_id) as place from docs")
def document_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a tenant, the newest first; their size stands for their time."""
    from pyspark.sql import Window as W

    return docs(spark, d).select("kb", "doc_id", F.row_number().over(W.partitionBy("kb").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("place"))


@query("select item_id as question_id, text as question, 'fact' as question_type, case when length(text) > 400 then 'hard' else 'easy' end as difficulty from benchmark")
def sample_projection(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit("fact").alias("question_type"), F.when(F.length("text") > 400, "hard").otherwise("easy").alias("difficulty"))


NAMES = ["a/b.PDF", "a/.DS_Store", "x/__MACOSX/b.txt", "x/._b.txt", "c.docx", "c.exe", "README"]


@query(f"""with {DOCS}, f as (select doc_id, kb, folder || '\\' || {NAMES}[1 + doc_id % {len(NAMES)}] as path from docs)
select kb, path, doc_id from f where doc_id % {len(NAMES)} in (0, 4) and path not in (select path from f g where g.kb = f.kb and g.doc_id % 11 = 0)""")
def import_filter(spark: SparkSession, d: str) -> DataFrame:
    """Files chosen to be taken in, without system files, other suffixes and what is there already."""
    from ..sources.parsers import SUPPORTED

    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    files = docs(spark, d).select("doc_id", "kb", F.concat("folder", F.lit("\\"), name).alias("path"))
    return metadata.importable(files, files.where("doc_id % 11 = 0"), SUPPORTED)


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || '+00:00' as at from events")
def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", text.iso_time(F.col("ts")).alias("at"))


STAGED = [s for s, _ in ingest.STAGES] + [ingest.FAILED, "unknown"]


def _staged(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGED]), ((F.col("event_id") * 7 + F.col("user_id")) % 31 % len(STAGED) + 1).cast("int"))
    return read(spark, d, "events").select((F.col("event_id") % 997).alias("doc_id"), "ts", "event_id", stage.alias("stage"))


STATES = f"""e as (select event_id % 997 as doc_id, ts, event_id, {STAGED}[1 + (event_id * 7 + user_id) % 31 % {len(STAGED)}] as stage from events),
a as (select *, {[p for _, p in ingest.STAGES]}[list_position({[s for s, _ in ingest.STAGES]}, stage)] as reached from e where stage <> 'unknown'),
o as (select *, coalesce(sum(case when stage in ('ready', 'failed') then 1 else 0 end) over (partition by doc_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as over_before from a),
s as (select doc_id, bool_or(stage = 'failed') as failed, coalesce(max(reached), 0) as progress from o where over_before = 0 group by doc_id),
states as (select doc_id, case when failed then 'failed' when progress = 100 then 'ready' else 'processing' end as status, case when failed then 'failed' else {[s for s, _ in ingest.STAGES]}[list_position({[p for _, p in ingest.STAGES]}, progress)] end as stage, progress from s)"""


@query(f"with {STATES} select doc_id, status, stage, progress from states")
def stage_states(spark: SparkSession, d: str) -> DataFrame:
    """States that only move forward, from events in any order; a failure keeps the progress before it."""
    return ingest.states(_staged(spark, d), "doc_id", "stage", ["ts", "event_id"])


@query(f"with {STATES} select doc_id, case when doc_id % 4 = 0 then 'failed' when doc_id % 4 = 1 then 'synced' else 'pending' end as sync_status from states where status = 'ready'")
def export_after_ready(spark: SparkSession, d: str) -> DataFrame:
    """The export's own state of each ready document, by its last attempt."""
    now = ingest.states(_staged(spark, d), "doc_id", "stage", ["ts", "event_id"])
    ids = read(spark, d, "events").select((F.col("event_id") % 997).alias("doc_id")).distinct()
    tries = ids.where("doc_id % 4 < 2").select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("attempt"), ok.alias("ok")) for n, ok in ((1, F.col("doc_id") % 4 == 0), (2, F.col("doc_id") % 4 == 1))])).alias("t")).select("doc_id", "t.*")
    return ingest.export_ready(now, tries, "doc_id")


@query("select event_id, user_id from events where user_id % 6 <> 0")
def cancelled_commit(spark: SparkSession, d: str) -> DataFrame:
    """What of a batch is committed when some documents were cancelled meanwhile."""
    e = read(spark, d, "events").select("event_id", "user_id")
    return ingest.without_cancelled(e, e.where("user_id % 6 = 0").select("user_id"), "user_id")


@query(f"with {DOCS} select kb, string_agg(case when status = 'ready' and n_chars <= 200 then cast(doc_id as varchar) end, ',' order by doc_id) as failures from docs group by kb")
def resync_failures(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a tenant whose export fails, in order."""
    bad = F.when((F.col("status") == "ready") & (F.col("n_chars") <= 200), F.col("doc_id"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(bad)), lambda x: x.cast("string")), ",")
    return docs(spark, d).groupBy("kb").agg(F.nullif(listed, F.lit("")).alias("failures"))


@query(f"""with {DOCS}, f as (select kb, folder, {list(metadata.QUEUE)}[1 + (doc_id // 3) % 5] as status from docs where doc_id % 2 = 0), u as (select kb, status, unnest([split_part(folder, '/', 1), folder]) as path from f),
c as (select kb, path, count(*) as n, count_if(status = 'queued') as queued, count_if(status = 'uploading') as uploading, count_if(status = 'done') as done, count_if(status = 'skipped') as skipped, count_if(status = 'failed') as failed from u group by all)
select kb, path, n, cast(queued as bigint) as queued, cast(uploading as bigint) as uploading, cast(done as bigint) as done, cast(skipped as bigint) as skipped, cast(failed as bigint) as failed, cast(round(100.0 * (done + skipped) / n) as int) as progress,
    case when uploading > 0 then 'uploading' when failed > 0 then 'failed' when queued > 0 then 'queued' when skipped = n then 'skipped' else 'done' end as state from c""")
def import_queue_rollup(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in metadata.QUEUE]), (F.floor(F.col("doc_id") / 3) % 5 + 1).cast("int"))
    return metadata.queue_rollup(docs(spark, d).where("doc_id % 2 = 0").select("kb", "folder", status.alias("status")))


@query(f"with {DOCS}, u as (select kb, doc_id, unnest([split_part(folder, '/', 1), folder]) as path from docs) select kb, path, count(*) as n, max(doc_id) as updated from u group by all")
def folder_rollup_updated(spark: SparkSession, d: str) -> DataFrame:
    """The last update below each folder; ids stand for times."""
    return metadata.folder_rollup(docs(spark, d).withColumns({"chunk_count": F.lit(1), "at": F.col("doc_id")}), updated="at").select("kb", "path", "n", "updated")


@query("""with o as (select user_id, event_type, cast(floor(value) as bigint) % 9 as size, min(event_id) as first, count(*) as n from events group by all),
p as (select *, row_number() over (partition by user_id order by first) as place, sum(n) over (partition by user_id) as every, count(*) over (partition by user_id) as once from o)
select user_id, event_type, size, cast(place as int) as place, cast(every - least(once, 10) as bigint) as skipped from p where place <= 10""")
def attachments_taken(spark: SparkSession, d: str) -> DataFrame:
    """The first ten distinct attachments of each user, and how many were passed over."""
    e = read(spark, d, "events").select("user_id", "event_type", (F.floor("value") % 9).alias("size"), "event_id")
    return metadata.take_attachments(e, ["user_id"], ["event_type", "size"], "event_id")


@query("select doc_id, length(text) > 0 and length(text) <= 500 as limited, length(text) > 0 as unlimited from documents")
def size_gate(spark: SparkSession, d: str) -> DataFrame:
    """Files within a limit, and without one."""
    n = F.length("text")
    return read(spark, d, "documents").select("doc_id", metadata.size_gate(n, 500).alias("limited"), metadata.size_gate(n, 0).alias("unlimited"))
