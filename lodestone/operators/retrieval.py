"""Top-k retrieval, citations, bounded contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a tile: points by questions. A tile is scored in steps of STEP questions, which bounds a worker's memory.
TILE_POINTS, TILE_QUESTIONS, STEP = 16384, 4096, 256
#: Counts of large keys are broadcast up to so many rows, joined by key beyond.
MOST_BROADCAST = 200_000


def _tiled(df: DataFrame, sizes: DataFrame | None, few: bool, own: str, other: str, on: list[str], row: str) -> DataFrame:
    """Each row with its own tile number by hash and once for each tile of the other side; keys of one tile have none in `sizes`, which is None where all keys have one."""
    if sizes is None:
        df = df.withColumns({own: F.lit(1), other: F.lit(1)})
    else:
        sizes = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in on], own, other)
        sizes = F.broadcast(sizes) if few else sizes
        match = [F.col(c) == F.col(f"_k_{c}") for c in on]
        df = df.join(sizes, match, "left").drop(*[f"_k_{c}" for c in on]).fillna(1, [own, other])
    tile = F.pmod(F.xxhash64(row), F.col(own)).cast("int")
    return df.withColumn(own, tile).withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))))


def top_k(points: DataFrame, questions: DataFrame, k: int, on: str | list[str], vector: str = "embedding", point: str = "vec_id", question: str = "question_id") -> DataFrame:
    """The k nearest points of its tenant for each question, by exact cosine to six digits; ties by point id.

    `questions` has question_id, the columns of `on`, qvec. Points and questions of a tenant meet in tiles of bounded size, so neither side is broadcast and a tenant with a third of all rows is dealt over many tasks; a tile gives k rows a question at most. Vectors that are null, of zero length or of another size than the question's have no score; a null tenant matches none. Returns question_id, point id, score, rank.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    on = [on] if isinstance(on, str) else list(on)
    points = points.select(*on, point, F.col(vector).alias("_v")).dropna(subset=[*on, "_v"])
    questions = questions.select(*on, question, F.col("qvec").alias("_q")).dropna(subset=[*on, "_q"])
    tiles = lambda df, rows, name: df.groupBy(*on).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = tiles(points, TILE_POINTS, "_p").join(tiles(questions, TILE_QUESTIONS, "_s"), on).where("_p > 1 or _s > 1")
    # counted once, as rows that are at hand, since both sides ask
    large = sizes.limit(MOST_BROADCAST + 1).toPandas()
    few = len(large) <= MOST_BROADCAST
    if few:
        # an empty frame would come from Python workers on all executors, beside those that score
        sizes = points.sparkSession.createDataFrame(large, sizes.schema) if len(large) else None
    left = _tiled(points, sizes, few, "_p", "_s", on, point)
    right = _tiled(questions, sizes, few, "_s", "_p", on, question)
    pid, qid = (dict(df.dtypes)[c] for df, c in ((points, point), (questions, question)))

    def score(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, own in p.groupby(p["_v"].map(len)):
            asked = q[q["_q"].map(len) == size]
            if not size or asked.empty:
                continue
            ids, m = own[point].to_numpy(), _unit(own["_v"])
            ids, m = ids[good := np.isfinite(m).all(axis=1)], m[good]
            names, v = asked[question].to_numpy(), _unit(asked["_q"])
            names, v = names[good := np.isfinite(v).all(axis=1)], v[good]
            if len(m):
                out += [(np.full(len(near), name, names.dtype), near, scores) for name, (near, scores) in zip(names, _nearest(v, m, ids, k), strict=True)]
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) if out else [] for i, c in enumerate((question, point, "score"))})

    by = [*on, "_p", "_s"]
    # other names, since both sides may come from one table
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], question, "_q")
    near = left.groupBy(*by).cogroup(right.groupBy(*[f"_r_{c}" for c in by])).applyInPandas(score, f"`{question}` {qid}, `{point}` {pid}, score double")
    rank = F.row_number().over(W.partitionBy(question).orderBy(F.desc("score"), F.col(point)))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(v: np.ndarray, m: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k nearest rows of m for each row of v. All steps are scored and rounded in one array."""
    room = np.empty((min(STEP, len(v)), len(m)))
    for i in range(0, len(v), STEP):
        step = v[i : i + STEP]
        scores = np.matmul(step, m.T, out=room[: len(step)])
        np.clip(np.round(scores, 6, out=scores), -1, 1, out=scores)
        for row in scores:
            near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            best = near[np.lexsort((ids[near], -row[near]))][:k]
            yield ids[best], row[best]


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def dedup_citations(hits: DataFrame, question: str, key: Column, rank: str = "rank") -> DataFrame:
    """The first hit of each document for a question; hits without a key go."""
    first = F.row_number().over(W.partitionBy(question, "_key").orderBy(rank))
    return hits.withColumn("_key", key).where("_key is not null").withColumn("_first", first).where("_first = 1").drop("_key", "_first")


def within_budget(df: DataFrame, group: str, order: str, text: str, header: Column, budget: int) -> DataFrame:
    """Texts of a group in order while a budget of characters lasts; the one that crosses it is cut. Each costs its header and two characters more."""
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    cost = F.length(header) + F.length(text) + 2
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0))
    room = F.lit(budget) - spent - F.length(header) - 2
    return df.withColumn("_room", room).where("_room > 0").withColumn(text, F.substring(F.col(text), F.lit(1), F.least(F.length(text), F.col("_room")).cast("int"))).drop("_room")


def within_room(df: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """As within_budget, without headers; two characters part the texts, but aren't needed after the last."""
    spent = F.coalesce(F.sum(F.length(text) + 2).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_room", F.lit(budget) - spent).where("_room > 0").withColumn(text, F.substring(F.col(text), F.lit(1), F.least(F.length(text), F.col("_room")).cast("int"))).drop("_room")


def last_n(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_back", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_back") <= n).drop("_back")


def fit_cells(points: DataFrame, cells: int, vector: str = "embedding", point: str = "vec_id", most: int = 50_000, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Centres of an inverted file by spherical k-means on at most `most` vectors, those with the least hashes of their ids."""
    bounded = points.where(F.size(vector) > 0).orderBy(F.xxhash64(F.lit(seed), point), point).limit(most).select(vector).toPandas()
    if bounded.empty:
        raise ValueError("no vectors to fit cells on")
    m = _unit(bounded[vector])
    m = m[np.isfinite(m).all(axis=1)]
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(m[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(m), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def nearest_cells(df: DataFrame, centres: np.ndarray, n: int, vector: str, name: str = "cells") -> DataFrame:
    """The n nearest cells of each row's vector, nearest first; none for a null vector."""
    n = min(n, len(centres))

    @F.pandas_udf("array<int>")
    def find(v: pd.Series) -> pd.Series:
        out = pd.Series([[]] * len(v), index=v.index)
        have = v[v.map(lambda x: x is not None and len(x) == centres.shape[1])]
        if len(have):
            far = -(np.stack(have.to_numpy()).astype(np.float64) @ centres.T)
            out[have.index] = pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)), index=have.index)
        return out

    return df.withColumn(name, find(vector))


def index_cells(points: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every point with its cell; write it partitioned by cell and searches read only the cells they probe."""
    return nearest_cells(points, centres, 1, vector).withColumn("cell", F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit(-1))).drop("cells")


def search_cells(index: DataFrame, questions: DataFrame, centres: np.ndarray, k: int, probes: int, on: str, **names: str) -> DataFrame:
    """Approximate top_k: each question looks into its `probes` nearest cells, and scores there are exact. As many probes as cells give top_k's own rows; recall below that is the caller's to measure."""
    probed = nearest_cells(questions, centres, probes, "qvec").withColumn("cell", F.explode("cells")).drop("cells")
    return top_k(index, probed, k, [on, "cell"], **names)
