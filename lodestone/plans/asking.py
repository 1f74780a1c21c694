"""Queries on what questions are answered with, on models, and on the evaluation of answers. Bindings besides those of the catalogue: benchmark items are samples whose expected answers are their texts, documents answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, evaluation, metadata, retrieval
from ..sources import gateway, parsers
from . import session
from .catalogue import METRIC, NORMAL, TOP, _hits, query, read


@query("""with w as (select conv_id, turn, unnest(string_split(lower(text), ' ')) as w from conversations), c as (select conv_id, turn, ('0x' || md5(w)[1])::int as place, count(*) as n from w where w <> '' group by all)
select conv_id, turn, place, round(n / sqrt(sum(n * n) over (partition by conv_id, turn)), 6) as weight from c""")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of messages through the offline gateway, in requests of 32; their places that aren't 0."""
    made = gateway.embed(read(spark, d, "conversations").select("conv_id", "turn", "text"), gateway.HashingGateway(), "text")
    return made.select("conv_id", "turn", F.posexplode("embedding").alias("place", "weight")).where("weight <> 0").withColumn("weight", F.round("weight", 6))


@query("with m as (select distinct p_type as name from part where not contains(lower(p_type), 'embed')) select name, name = (select max(p_type) from part) as is_default, cast(row_number() over (order by name = (select max(p_type) from part) desc, lower(name), name) as int) as place from m")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    """Models by name, the default first; kinds of parts stand for them."""
    part = read(spark, d, "part")
    named = part.select("p_type").union(part.select(F.concat("p_type", F.lit("-Embedding"))))
    return gateway.models(named, part.agg(F.max("p_type")).first()[0], "p_type")


TALK = """t as (select conv_id, max(turn) as last from conversations where role = 'user' group by conv_id), q as (select c.conv_id, c.turn, c.text as question from conversations c join t on t.conv_id = c.conv_id and t.last = c.turn),
h as (select c.conv_id, row_number() over (partition by c.conv_id order by c.turn) as place, c.role, c.text as content from conversations c join q on q.conv_id = c.conv_id and c.turn < q.turn where c.role in ('user', 'assistant') and c.text <> ''),
n as (select conv_id, (select count(*) from h where h.conv_id = q.conv_id) as n, question from q)"""


def _talks(spark: SparkSession, d: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    talks = read(spark, d, "conversations").groupBy("conv_id").agg(said.alias("said"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last")).where("last is not null")
    asked = F.element_at(F.filter("said", lambda m: (m["turn"] == F.col("last")) & (m["role"] == "user")), 1)["content"]
    return talks.select("conv_id", F.filter("said", lambda m: m["turn"] < F.col("last")).alias("history"), asked.alias("question"))


@query(f"""with {TALK} select conv_id, 1 as place, 'system' as role, '{answers.SYSTEM}' as content from q union all select conv_id, place + 1, role, content from h
union all select conv_id, n + 2, 'system', '{answers.EVIDENCE.strip().replace("'", "''")}' || chr(10) || to_json({{'retrieved_context': 'conv ' || conv_id, 'temporary_attachment_context': '', 'knowledge_base_catalog': case when conv_id % 2 = 0 then '[文件]' else '' end}})::varchar from n union all select conv_id, n + 3, 'user', question from n""")
def answer_messages(spark: SparkSession, d: str) -> DataFrame:
    """What a model gets for the last question of each conversation."""
    talks = _talks(spark, d)
    context, catalogue = F.concat(F.lit("conv "), F.col("conv_id").cast("string")), F.when(F.col("conv_id") % 2 == 0, "[文件]")
    made = answers.answer_messages(F.col("question"), context, F.col("history"), catalogue, F.lit(None).cast("string"))
    return talks.select("conv_id", F.posexplode(made).alias("place", "m")).select("conv_id", (F.col("place") + 1).cast("long").alias("place"), "m.role", "m.content")


@query("""with c as (select distinct conv_id from conversations) select conv_id, 'retrieval_decision' as agent, 'completed' as status, case when conv_id % 3 = 0 then 'SKIP' else 'RETRIEVE' end as outcome, -1 as retrieved_count, -1 as top_k from c
union all select conv_id, 'knowledge_retrieval', case when conv_id % 3 = 0 then 'skipped' else 'completed' end, null, case when conv_id % 3 = 0 then 0 else cast(conv_id % 11 as int) end, 10 from c union all select conv_id, 'answer', 'completed', null, -1, -1 from c""")
def agent_trace(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "conversations").select("conv_id").distinct()
    used = F.col("conv_id") % 3 != 0
    trace = answers.agent_trace(F.when(used, "RETRIEVE").otherwise("SKIP"), used, F.when(used, F.col("conv_id") % 11).otherwise(0), 10)
    return ids.select("conv_id", F.inline(trace)).fillna(-1, ["retrieved_count", "top_k"])


@query(f"""with {TOP}, c as (select question_id, rank, cast(vec_id // 3 as varchar) as document_id, cast(vec_id as varchar) as chunk_id, cast(vec_id // 3 as varchar) as key from hits
union all select question_id, 100 + i, null, 'attachment:' || i || ':' || case when i = 1 then 'c' || question_id else '0' end, 'file ' || (i + question_id) % 2 from (select distinct question_id from hits), (values (0), (1), (2)) v(i)),
f as (select *, row_number() over (partition by question_id, key order by rank) as first from c) select question_id, string_agg(chunk_id, ',' order by rank) as chunk_ids, count(*) as n from f where first = 1 group by question_id""")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of hits and then of three attachments, two of which share a name, after they were stored as JSON and read again."""
    null = F.lit(None)
    cited = F.struct(F.floor(F.col("vec_id") / 3).cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("doc "), F.floor(F.col("vec_id") / 3).cast("string")).alias("title"), null.cast("int").alias("page_number"), F.col("score").alias("score"), null.cast("boolean").alias("temporary"))
    rows = _hits(spark, d).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", cited.alias("c")))), lambda x: x["c"]).alias("hits"))
    one = lambda i: F.array(F.struct(null.cast("string").alias("document_id"), (F.concat(F.lit("c"), F.col("question_id").cast("string")) if i == 1 else null.cast("string")).alias("chunk_id"), F.lit("").alias("title"), null.cast("int").alias("page_number"), null.cast("double").alias("score"), null.cast("boolean").alias("temporary")))
    attached = F.concat(*[answers.attachment_citations(F.lit(i), F.concat(F.lit("file "), ((F.col("question_id") + i) % 2).cast("string")), one(i)) for i in range(3)])
    every = answers.citations_of(answers.citations_json(answers.all_citations(F.col("hits"), attached)))
    return rows.select("question_id", every.alias("c")).select("question_id", F.array_join(F.transform("c", lambda x: x["chunk_id"]), ",").alias("chunk_ids"), F.size("c").cast("long").alias("n"))


@query("""with c as (select conv_id, turn, text, coalesce(sum(length(text) + 2) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as spent from conversations)
select conv_id, turn, substring(text, 1, cast(least(length(text), 400 - spent) as bigint)) as text from c where 400 - spent > 0""")
def parsed_attachment_budget(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of attachments that were parsed before, while a budget lasts; the one that crosses it is cut."""
    return retrieval.within_room(read(spark, d, "conversations"), "conv_id", "turn", "text", 400).select("conv_id", "turn", "text")


@query(r"""with s as (select conv_id, turn, """ + NORMAL + r""" as t from conversations), j as (select conv_id, string_agg(t, chr(10) || chr(10) order by turn) as t from s where t <> '' group by conv_id)
select conv_id, cast(i as int) as chunk_index, sha256(substring(t, cast(350 * i + 1 as bigint), 400)) as hash from (select conv_id, t, unnest(range(0, 1 + greatest(0, cast(ceil((length(t) - 400) / 350.0) as bigint)))) as i from j)""")
def joined_source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents of several sources; the turns of a conversation stand for the pages of a file."""
    joined = parsers.join_sources(read(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return metadata.chunks(joined, "conv_id", F.col("text")).select("conv_id", "chunk_index", text.content_hash(F.col("text")).alias("hash"))


@query(r"""select conv_id, turn, 'x ' || chr(10) || '$$' || chr(10) || 'a^2' || chr(10) || '$$' || chr(10) || ' `\(b\)` ' || '$' || conv_id || '$ (' || turn || ') $\frac{1}{2}$ ~~~(\alpha)~~~' as text from conversations""")
def dollar_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Signs of formulas outside code."""
    made = F.concat(F.lit(r"x \[ a^2" + "\n" + r"\] `\(b\)` \( "), F.col("conv_id").cast("string"), F.lit(r"\) ("), F.col("turn").cast("string"), F.lit(r") (\frac{1}{2}) ~~~(\alpha)~~~"))
    return read(spark, d, "conversations").select("conv_id", "turn", text.dollar_formulas(made).alias("text"))


SAMPLES = f"""s as (select cast(item_id as varchar) as question_id, text as expected, item_id, item_id % 5 = 0 as refuse, case when item_id % 3 = 0 then [] else ['d' || item_id, 'e'] end as documents, case when item_id % 4 = 0 then [] else ['c' || item_id] end as chunks from benchmark),
p as (select s.*, d.text as answer, {METRIC.format("expected")} as a, {METRIC.format("d.text")} as b, d.doc_id is null as gone from s left join documents d on d.doc_id = s.item_id),
e as (select question_id, ch, count(*) as n from (select question_id, unnest(string_split(a, '')) as ch from p) where ch <> '' group by all), f as (select question_id, ch, count(*) as n from (select question_id, unnest(string_split(b, '')) as ch from p where b is not null) where ch <> '' group by all),
common as (select question_id, sum(least(e.n, f.n)) as n from e join f using (question_id, ch) group by question_id),
r as (select p.question_id, refuse as expected_refusal, case when gone then 'no response' when item_id % 13 = 0 then 'timeout' when not refuse and item_id % 7 = 0 then 'no answer score' end as error, case when refuse then null when item_id % 7 = 0 then null else item_id % 100 end::double as answer_score,
    case when len(documents) > 0 then item_id % 2 = 0 end as document_hit, case when len(chunks) > 0 then item_id % 6 <> 0 end as chunk_hit, round(case when length(a) > 0 and length(b) > 0 then 2.0 * coalesce(c.n, 0) / (length(a) + length(b)) else 0 end, 4) as answer_char_f1,
    round(len(list_filter(ks, lambda k: contains(b, k)))::double / nullif(len(ks), 0), 4) as keyword_recall
    from (select *, list_filter(list_transform(string_split(expected, ' ')[1:3], lambda w: {METRIC.format("w")}), lambda w: w <> '') as ks from p) p left join common c using (question_id)),
results as (select *, case when error is not null then false when expected_refusal then false else coalesce(document_hit, true) and coalesce(chunk_hit, true) and answer_score >= 20 end as passed from r)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    no_ids = F.array().cast("array<string>")
    items = read(spark, d, "benchmark")
    own = lambda c: F.concat(F.lit(c), i.cast("string"))
    samples = items.select(
        i.cast("string").alias("question_id"), F.concat(F.lit("q "), i.cast("string")).alias("question"), F.lit(None).cast("string").alias("question_type"), F.lit(None).cast("string").alias("difficulty"), F.col("text").alias("expected_answer"),
        F.when(i % 3 == 0, no_ids).otherwise(F.array(own("d"), F.lit("e"))).alias("source_document_ids"), F.when(i % 4 == 0, no_ids).otherwise(F.array(own("c"))).alias("source_chunk_ids"), F.slice(F.split("text", " "), 1, 3).alias("keywords"), (i % 5 == 0).alias("should_refuse"),
    )
    cited = F.array(F.struct(F.when(i % 2 == 0, own("d")).alias("document_id"), F.lit("x").alias("chunk_id")))
    answered = items.select("item_id").join(read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")
    responses = answered.select(
        i.cast("string").alias("question_id"), "answer", cited.alias("citations"), no_ids.alias("retrieved_document_ids"), F.when(i % 6 != 0, F.array(own("c"), F.lit(None).cast("string"))).otherwise(no_ids).alias("retrieved_chunk_ids"), F.lit(True).alias("retrieval_used"), F.lit(1).alias("retrieved_count"),
        F.when(i % 7 != 0, (i % 100).cast("double")).alias("answer_score"), F.when(i % 13 == 0, "timeout").alias("error"),
    )
    return evaluation.score_responses(samples, responses, 20.0)


@query(f"with {SAMPLES} select question_id, expected_refusal, error, answer_score, document_hit, chunk_hit, answer_char_f1, keyword_recall, passed from results where error is distinct from 'no response'")
def score_response(spark: SparkSession, d: str) -> DataFrame:
    """A result for each sample; retrieved documents are read from the citations."""
    return _results(spark, d).where("error is null or error <> 'no response'").select("question_id", "expected_refusal", "error", "answer_score", "document_hit", "chunk_hit", "answer_char_f1", "keyword_recall", "passed")


@query(f"""with {SAMPLES}, g as (select * from results where error is null) select (select count(*) from results) as sample_count, count(*) as completed_count, (select count(*) from results where error is not null) as error_count, cast(count_if(passed) as bigint) as passed_count, round(avg(passed::int::double), 4) as pass_rate,
round(avg(document_hit::int::double), 4) as document_hit_rate, round(avg(chunk_hit::int::double), 4) as chunk_hit_rate, round(avg((not expected_refusal)::int::double), 4) as refusal_accuracy, round(avg(answer_score), 4) as average_answer_score,
round(avg(case when not expected_refusal then answer_char_f1 end), 4) as average_answer_char_f1, round(avg(keyword_recall), 4) as average_keyword_recall from g""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summarise(_results(spark, d))


@query("select cast(item_id as varchar) as question_id, text as question, case when item_id % 3 = 1 then 'approved' end as status from benchmark where item_id % 3 < 2")
def eval_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as JSON lines and read again; those that are drafts aren't taken."""
    path = session.shared_path(spark, "samples")
    i = F.col("item_id")
    status = F.when(i % 3 == 1, "approved").when(i % 3 == 2, "draft")
    read(spark, d, "benchmark").select(i.cast("string").alias("question_id"), F.col("text").alias("question"), status.alias("status")).write.json(path)
    return evaluation.read_samples(spark, f"{path}/*.json").select("question_id", "question", "status")


@query("select cast(item_id as varchar) as question_id from benchmark where item_id in (1, 3)")
def eval_selected(spark: SparkSession, d: str) -> DataFrame:
    """Samples by ids, trimmed and without repeats."""
    samples = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"))
    return evaluation.select_samples(samples, [" 1", "3 ", "1", ""])


@query("with s as (select item_id, case when item_id % 4 <> 0 then [item_id, item_id + 7] else [] end as ids from benchmark), k as (select doc_id from documents where source <> 'src3') select cast(item_id as varchar) as question_id from s where len(ids) > 0 and not exists (select 1 from k where list_contains(ids, doc_id))")
def eval_kb_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Samples that expect documents, none of which is the tenant's."""
    i = F.col("item_id")
    ids = F.when(i % 4 != 0, F.array(i.cast("string"), (i + 7).cast("string"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("")))
    samples = read(spark, d, "benchmark").select(i.cast("string").alias("question_id"), ids.alias("source_document_ids"))
    known = read(spark, d, "documents").where("source <> 'src3'").select(F.col("doc_id").alias("document_id"))
    return evaluation.outside_tenant(samples, known).select("question_id")


@query("""select a.vec_id, case when a.vec_id % 9 = 0 then 0.0 else round(100 * greatest(0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 2) end as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def semantic_score_of_answers(spark: SparkSession, d: str) -> DataFrame:
    """Scores of answers from two vectors; blank answers have 0."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    answer = F.when(F.col("vec_id") % 9 == 0, " \n").otherwise("a")
    return pairs.select("vec_id", text.semantic_score(answer, F.lit("e"), F.col("embedding"), F.col("other")).alias("score"))
