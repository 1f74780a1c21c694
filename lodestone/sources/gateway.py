"""Gateways to models: texts to vectors and messages to answers, in Arrow batches. The offline one needs no network; the remote one posts JSON and tries again where that can help."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts of a request, states that may pass, how often and how long to wait for them, and states on which a schema is left out.
BATCH = 32
PASSING, RETRIES, LONGEST_WAIT = {429, 500, 502, 503, 504}, 3, 8.0
NO_SCHEMA = {400, 422}


class Gateway(Protocol):
    embedding_model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def complete(self, messages: list[dict], **options) -> str: ...


class HashingGateway:
    """Vectors from words: each adds one at the place that the first digit of its MD5 says, and the vector gets length one. Answers repeat the last message."""

    embedding_model = "hashing-16"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(16)
            for word in text.lower().split(" "):
                if word:
                    v[int(hashlib.md5(word.encode()).hexdigest()[0], 16)] += 1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    def complete(self, messages: list[dict], **options) -> str:
        return messages[-1]["content"]


def post_json(url: str, key: str, payload: dict, timeout: float = 180.0) -> tuple[int, dict, bytes]:
    body = json.dumps(payload, ensure_ascii=False).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class RemoteGateway:
    """`post` and `wait` can be given, so it runs without a network in tests."""

    def __init__(self, url: str, key: str, chat_model: str, embedding_model: str, models: tuple[str, ...] = (), post: Callable = post_json, wait: Callable[[float], None] = time.sleep):
        self.url, self.key, self.chat_model, self.embedding_model = url.rstrip("/"), key, chat_model, embedding_model
        self.models, self.post, self.wait = models or (chat_model,), post, wait

    def _ask(self, path: str, payload: dict) -> tuple[int, dict]:
        """Tries again on states that may pass, after the time that the answer names or a doubling one."""
        for attempt in range(RETRIES + 1):
            status, headers, body = self.post(f"{self.url}/{path}", self.key, payload)
            if status not in PASSING or attempt == RETRIES:
                return status, json.loads(body) if status < 400 else {"error": body.decode(errors="replace")}
            told = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            self.wait(min(LONGEST_WAIT, float(told) if told.replace(".", "", 1).isdigit() else 2.0**attempt))
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            status, made = self._ask("embeddings", {"model": self.embedding_model, "input": part})
            if status >= 400:
                raise RuntimeError(f"embeddings: {status} {made['error']}")
            out += in_order(made["data"], len(part))
        return out

    def complete(self, messages: list[dict], schema: dict | None = None, **options) -> str:
        payload = {"model": self.chat_model, "messages": messages} | options
        with_schema = payload | {"response_format": {"type": "json_object"}} if schema else payload
        status, made = self._ask("chat/completions", with_schema)
        if schema and status in NO_SCHEMA:
            status, made = self._ask("chat/completions", payload)
        if status >= 400:
            raise RuntimeError(f"completion: {status} {made['error']}")
        return made["choices"][0]["message"]["content"]


def in_order(data: list[dict], n: int) -> list[list[float]]:
    """Vectors by their index. One that is missing or there twice is an error."""
    by = {d["index"]: d["embedding"] for d in data}
    if len(data) != n or set(by) != set(range(n)):
        raise ValueError(f"{n} vectors were asked for, and there are those of {sorted(by)}")
    return [by[i] for i in range(n)]


def gateway(conf: dict[str, str]) -> Gateway:
    """By the setting `provider`: offline without one, or remote, for which all of its settings must be there."""
    kind = conf.get("provider", "offline")
    if kind == "offline":
        return HashingGateway()
    if kind != "remote":
        raise ValueError(f"no gateway is called {kind}")
    if missing := [k for k in ("url", "key", "chat_model", "embedding_model") if not conf.get(k)]:
        raise ValueError(f"the remote gateway needs {', '.join(missing)}")
    return RemoteGateway(*(conf[k] for k in ("url", "key", "chat_model", "embedding_model")), tuple(filter(None, conf.get("models", "").split(","))))


def models(named: DataFrame, default: str, name: str = "name") -> DataFrame:
    """name, is_default, place of the chat models: the default first, then by name in any letter case; models for embeddings aren't among them."""
    df = named.select(F.col(name).alias("name")).where(~F.contains(F.lower("name"), F.lit("embed"))).distinct().withColumn("is_default", F.col("name") == default)
    # a list of models is short
    return df.withColumn("place", F.row_number().over(W.orderBy(F.desc("is_default"), F.lower("name"), "name")))


def embed(df: DataFrame, made: Gateway, text: str, vector: str = "embedding") -> DataFrame:
    """df with a vector for each text, in requests of BATCH texts. A null text counts as ''."""
    keep = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            vectors = [v for i in range(0, len(texts), BATCH) for v in made.embed(texts[i : i + BATCH])]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(texts)} texts have {len(vectors)} vectors")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(vectors, pa.list_(pa.float64()))], [*keep, vector])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep) + f", `{vector}` array<double>"
    return df.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def probe(checks: dict[str, Callable[[], object]]) -> dict[str, str]:
    """Runs every check and tells of all that failed, by name."""
    faults = {}
    for name, check in checks.items():
        try:
            check()
        except Exception as e:  # noqa: BLE001  all failures are told together
            faults[name] = f"{type(e).__name__}: {e}"
    return faults
