"""Evaluation of answers: samples, scores (bag-of-characters F1, keyword recall, semantic score, hits), results, summary, report."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import is_refusal
from ..functions.text import metric_text
from ..sources.gateway import post_json

SAMPLE = "question_id string, question string, question_type string, difficulty string, expected_answer string, source_document_ids array<string>, source_chunk_ids array<string>, keywords array<string>, should_refuse boolean, status string"
_NAMES = [f.split()[0] for f in SAMPLE.split(", ")]


def read_samples(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """Samples of JSON-lines files that are approved or have no status, or every sample. A line that is no JSON or lacks its question or id is an error that names it, and so is a set without samples."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.list_(pa.string()) if n.endswith("_ids") or n == "keywords" else pa.bool_() if n == "should_refuse" else pa.string()) for n in _NAMES] + [("fault", pa.string())])
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, line in enumerate(content.decode("utf-8-sig").splitlines(), 1):
                    if line.strip():
                        rows.append(_sample(f"{name}, line {n}", line))
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(parsed, f"{SAMPLE}, fault string")
    if fault := found.where("fault is not null").select("fault").first():
        raise ValueError(fault[0])
    samples = found.drop("fault")
    if not every:
        samples = samples.where("status is null or status = 'approved'")
    if samples.isEmpty():
        raise ValueError("there are no samples to evaluate")
    return samples


def _sample(where: str, line: str) -> dict:
    try:
        made = json.loads(line)
    except json.JSONDecodeError as e:
        return {"fault": f"{where} is not JSON: {e}"}
    if not (made.get("question_id") and made.get("question")):
        return {"fault": f"{where} has no question_id or question"}
    as_text = lambda v: v if v is None or isinstance(v, str) else str(v)
    row: dict = {n: as_text(made.get(n)) for n in _NAMES}
    row |= {n: [as_text(x) for x in made.get(n) or []] for n in ("source_document_ids", "source_chunk_ids", "keywords")}
    return row | {"should_refuse": bool(made.get("should_refuse"))}


def export_samples(spark: SparkSession, url: str, ids: list[str] = (), every: bool = False, post: Callable = post_json) -> tuple[DataFrame, dict]:
    """Samples and metadata from a remote tool's export: those with the ids if any are given, else approved ones, or every one. An answer without samples, or a sample that lacks its question or id, is an error."""
    wanted = list(dict.fromkeys(i.strip() for i in ids if i.strip()))
    # Words of the request, and its path
    request = {"format": "jsonl", "scope": "selected" if wanted else "all" if every else "approved"} | ({"questionIds": wanted} if wanted else {})
    status, _, body = post(f"{url.rstrip('/')}/api/datasets/export", "", request)
    if status >= 400:
        raise ValueError(f"the export of {url} failed: {status}")
    data = json.loads(body).get("data")
    told = data.get("samples") if isinstance(data, dict) else None
    if not isinstance(told, list) or not told:
        raise ValueError(f"the export of {url} has no samples")
    # an export is one answer held by the driver, so its rows are few
    rows = [_sample(f"sample {n}", json.dumps(x)) if isinstance(x, dict) else {"fault": f"sample {n} is no object"} for n, x in enumerate(told, 1)]
    if faults := [r["fault"] for r in rows if r.get("fault")]:
        raise ValueError(faults[0])
    samples = spark.createDataFrame([tuple(r[n] for n in _NAMES) for r in rows], SAMPLE)
    return select_samples(samples, wanted), data["metadata"] if isinstance(data.get("metadata"), dict) else {}


def select_samples(samples: DataFrame, ids: list[str]) -> DataFrame:
    """The samples asked for by trimmed ids; all if none is given. Ids that no sample has are an error that lists them."""
    wanted = {i.strip() for i in ids} - {""}
    if not wanted:
        return samples
    chosen = samples.where(F.col("question_id").isin(*wanted))
    if missing := sorted(wanted - {r[0] for r in chosen.select("question_id").distinct().collect()}):
        raise ValueError(f"no sample has the question_id {', '.join(missing)}")
    return chosen


def outside_tenant(samples: DataFrame, documents: DataFrame, ids: str = "source_document_ids", document: str = "document_id") -> DataFrame:
    """Samples that expect documents of which the tenant has none."""
    named = samples.select("question_id", F.explode(F.filter(ids, lambda x: x.isNotNull() & (x != ""))).alias("_id"))
    known = documents.select(F.col(document).cast("string").alias("_id")).distinct()
    good = named.join(known, "_id", "left_semi").select("question_id").distinct()
    return samples.join(named.select("question_id").distinct(), "question_id", "left_semi").join(good, "question_id", "left_anti")


def bag_f1(expected: Column, answer: Column) -> Column:
    """F1 of two normalised texts as bags of characters; 0 if one is empty. Each row is counted by itself: how often a character occurs is what the text loses without it."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    chars = F.filter(F.array_distinct(F.split(expected, "")), lambda c: c != "")
    common = F.aggregate(chars, F.lit(0).cast("int"), lambda n, c: n + F.least(times(expected, c), times(answer, c)))
    a, b = F.length(expected), F.length(answer)
    return F.when((a > 0) & (b > 0), 2.0 * common / (a + b)).otherwise(0.0)


def char_f1(df: DataFrame, key: str, expected: str, answer: str) -> DataFrame:
    """key and char_f1 of two normalised texts, to six digits."""
    return df.select(key, F.round(bag_f1(F.col(expected), F.col(answer)), 6).alias("char_f1"))


def keyword_recall(keywords: Column, answer: Column) -> Column:
    """The share of keywords in the answer; null without keywords."""
    own = F.filter(keywords, lambda k: k != "")
    return F.size(F.filter(own, lambda k: F.contains(answer, k))) / F.nullif(F.size(own), F.lit(0))


def _ids(ids: Column) -> Column:
    """Distinct ids in order, without null and ''."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def retrieved_ids(found: Column, citations: Column, name: str) -> Column:
    """What was retrieved; the ids of the citations if that is empty."""
    own = _ids(found)
    return F.when(F.size(own) > 0, own).otherwise(_ids(F.transform(citations, lambda c: c[name])))


def hit(expected: Column, found: Column, checked: Column) -> Column:
    """Null where ids aren't checked or none is expected; else whether any is found."""
    return F.when(checked & (F.size(expected) > 0), F.arrays_overlap(expected, _ids(found)))


def passed(should_refuse: Column, refused: Column, document_hit: Column, chunk_hit: Column, score: Column, least: float = 75.0) -> Column:
    """Refusal samples pass by refusing alone; others need all that applies to them and a score."""
    right = should_refuse == refused
    return F.when(should_refuse, right).otherwise(right & F.coalesce(document_hit, F.lit(True)) & F.coalesce(chunk_hit, F.lit(True)) & F.coalesce(score >= least, F.lit(False)))


RESPONSE = "question_id string, answer string, citations array<struct<document_id:string,chunk_id:string>>, retrieved_document_ids array<string>, retrieved_chunk_ids array<string>, retrieval_used boolean, retrieved_count int, answer_score double, error string"


def score_responses(samples: DataFrame, responses: DataFrame, least: float = 75.0, check_ids: bool = True) -> DataFrame:
    """A result for each sample. Samples without a response, or with one that failed, keep a row with the error. A sample that isn't to be refused needs an answer score; without one it is an error too."""
    c = F.col
    refuse = F.coalesce("should_refuse", F.lit(False))
    gone = F.when(c("_of").isNull(), F.lit("no response")).otherwise(c("error"))
    error = F.coalesce(gone, F.when(~refuse & c("answer_score").isNull(), F.lit("no answer score")))
    df = samples.join(responses.withColumnRenamed("question_id", "_of"), c("question_id") == c("_of"), "left")
    normal = metric_text(F.coalesce("answer", F.lit("")))
    df = df.withColumns({
        "error": error,
        "answer": F.coalesce("answer", F.lit("")),
        "expected_answer": F.coalesce("expected_answer", F.lit("")),
        "expected_refusal": refuse,
        "refusal_detected": is_refusal(F.coalesce("answer", F.lit(""))),
        "expected_document_ids": _ids(c("source_document_ids")),
        "expected_chunk_ids": _ids(c("source_chunk_ids")),
        "retrieved_document_ids": retrieved_ids(c("retrieved_document_ids"), c("citations"), "document_id"),
        "retrieved_chunk_ids": retrieved_ids(c("retrieved_chunk_ids"), c("citations"), "chunk_id"),
        "answer_char_f1": F.round(bag_f1(metric_text(F.coalesce("expected_answer", F.lit(""))), normal), 4),
        "keyword_recall": F.round(keyword_recall(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), metric_text), normal), 4),
        "answer_score": F.when(~refuse, c("answer_score")),
    })
    checked = F.lit(check_ids)
    df = df.withColumns({"document_hit": hit(c("expected_document_ids"), c("retrieved_document_ids"), checked), "chunk_hit": hit(c("expected_chunk_ids"), c("retrieved_chunk_ids"), checked), "refusal_correct": c("expected_refusal") == c("refusal_detected"), "answer_score_passed": c("answer_score") >= least})
    df = df.withColumn("passed", F.when(c("error").isNull(), passed(c("expected_refusal"), c("refusal_detected"), c("document_hit"), c("chunk_hit"), c("answer_score"), least)).otherwise(False))
    return df.select(
        "question_id", "question", "question_type", "difficulty", "passed", "expected_refusal", "refusal_detected", "refusal_correct", "document_hit", "chunk_hit", F.lit(not check_ids).alias("source_id_check_skipped"), "answer_score", "answer_score_passed", "answer_char_f1", "keyword_recall",
        F.coalesce("retrieval_used", F.lit(False)).alias("retrieval_used"), F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"), "retrieved_document_ids", "retrieved_chunk_ids", "expected_document_ids", "expected_chunk_ids", "answer", "expected_answer", "error",
    )


def rate(x: Column) -> Column:
    return F.round(F.avg(x.cast("double")), 4)


def summarise(results: DataFrame) -> DataFrame:
    """One row; rows with an error count only as such. Rates and means leave nulls out and are null without any."""
    good = F.col("error").isNull()
    only = lambda c: F.when(good, F.col(c))
    return results.agg(
        F.count("*").alias("sample_count"),
        F.count_if(good).alias("completed_count"),
        F.count_if(~good).alias("error_count"),
        F.count_if(good & F.col("passed")).alias("passed_count"),
        rate(F.coalesce(only("passed"), F.when(good, F.lit(False)))).alias("pass_rate"),
        rate(only("document_hit")).alias("document_hit_rate"),
        rate(only("chunk_hit")).alias("chunk_hit_rate"),
        rate(only("refusal_correct")).alias("refusal_accuracy"),
        rate(only("answer_score")).alias("average_answer_score"),
        rate(F.when(good & ~F.col("expected_refusal"), F.col("answer_char_f1"))).alias("average_answer_char_f1"),
        rate(only("keyword_recall")).alias("average_keyword_recall"),
    )


def write_report(results: DataFrame, path: str, least: float = 0.0, **about) -> int:
    """Writes results as JSON lines and the summary with what is told about the run as one JSON text below path; returns the exit code."""
    spark = results.sparkSession
    results.write.mode("overwrite").json(f"{path}/results")
    summary = summarise(spark.read.schema(results.schema).json(f"{path}/results")).first().asDict()
    text = json.dumps({**about, "summary": summary}, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return gate(summary, least)


def gate(summary: dict, least: float) -> int:
    """Exit code: 2 with errors, 1 below the pass rate, else 0."""
    return 2 if summary["error_count"] else 1 if (summary["pass_rate"] or 0) < least else 0
