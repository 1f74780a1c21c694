"""Quality classifier: a sparse rule ensemble.

Small boosted trees are grown on statistics of labelled texts; every path from a root is a rule (a conjunction of thresholds). A logistic regression with a lasso penalty weighs the rules, and those it keeps are compiled into one Spark column expression. All texts are then scored by Spark's own functions.

Fitted on at most SAMPLE_ROWS labelled rows, the first by a hash of the id; of rows that share an id the one with the least statistics counts. Null, empty or blank texts have all statistics 0 and are scored like any other. Repeated rows get equal scores. Without labelled rows of both classes, or with an empty table, every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, documents

SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 32
LASSO, STEPS = 0.001, 300
#: A row counts as good from this score on.
THRESHOLD = 0.7

STATISTICS = {
    "log_words": "ln(1 + w)",
    "mean_length": "if(w > 0, c / w, 0)",
    "distinct_share": "if(w > 0, d / w, 0)",
    "symbol_share": "if(w > 0, symbols / w, 0)",
    "bang_share": "if(w > 0, bangs / w, 0)",
    "bar_share": "if(w > 0, bars / w, 0)",
    "upper_share": "if(c > 0, uppers / c, 0)",
    "digit_share": "if(c > 0, digits / c, 0)",
    "line_share": "if(w > 0, lines / w, 0)",
    "repeated_line_share": "if(lines > 0, repeated / lines, 0)",
}


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by the columns of STATISTICS, doubles rounded to 9 digits; other columns of those names go."""
    keep = [c for c in df.columns if c != text and c not in STATISTICS]
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.select(*keep, t.alias("_t"), words.alias("_w"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"))

    def count(pattern: str) -> Column:
        return F.regexp_count("_t", F.lit(pattern)).cast("double")

    counts = {
        "w": F.size("_w").cast("double"),
        "c": F.length(F.concat_ws("", "_w")).cast("double"),
        "d": F.size(F.array_distinct("_w")).cast("double"),
        "symbols": count(r"[#*$%&<>]+"),
        "bangs": count("[!]+"),
        "bars": count(r"[|]+"),
        "uppers": count(r"[A-ZÀ-ÖØ-Þ]"),
        "digits": count("[0-9]"),
        "lines": F.size("_l").cast("double"),
        "repeated": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("double"),
    }
    df = df.select(*keep, F.struct(*[x.alias(n) for n, x in counts.items()]).alias("_s")).select(*keep, "_s.*")
    return df.select(*keep, *[F.round(F.expr(x).cast("double"), 9).alias(n) for n, x in STATISTICS.items()])


#: (statistic's place, above or not, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A tree's rules, and its step at each row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))

    def split(rows: np.ndarray, path: Rule) -> None:
        g, w = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 20:
            for j in range(x.shape[1]):
                gs = np.cumsum(np.bincount(binned[rows, j], gradient[rows], BINS + 1))[:-1]
                ws = np.cumsum(np.bincount(binned[rows, j], weight[rows], BINS + 1))[:-1]
                gain = gs**2 / (ws + 1) + (g - gs) ** 2 / (w - ws + 1) - g**2 / (w + 1)
                gain[(ws < 1) | (w - ws < 1)] = 0
                b = int(gain[: len(edges[j])].argmax()) if len(edges[j]) else 0
                if len(edges[j]) and gain[b] > best[0]:
                    best = (gain[b], (j, b))
        if best[1] is None:
            step[rows] = RATE * g / (w + 1)
            return
        j, b = best[1]
        below = binned[rows, j] <= b
        for above, part in ((False, rows[below]), (True, rows[~below])):
            rule = (*path, (j, above, float(edges[j][b])))
            rules.append(rule)
            split(part, rule)

    split(np.arange(len(x)), ())
    return rules, step


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in rule:
        out &= x[:, j] > at if above else x[:, j] <= at
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """x: a row of statistics for each text; y: 0 or 1. The intercept, and rules with weights."""
    if len(set(y.tolist())) < 2:
        return 0.0, []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    score, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        new, step = _grow(x, binned, edges, y - p, np.maximum(p * (1 - p), 1e-6))
        rules |= dict.fromkeys(new)
        score += step
    kept, columns, seen = [], [], set()
    for r in rules:
        h = holds(r, x)
        if 0 < h.mean() < 1 and (mark := h.tobytes()) not in seen:
            seen.add(mark)
            kept.append(r)
            columns.append(h)
    if not kept:
        return float(score[0]), []
    m = np.stack(columns, 1).astype(np.float64)
    centre, scale = m.mean(0), m.std(0)
    m = (m - centre) / scale
    # accelerated proximal gradient; the logistic loss bends by a quarter of the largest eigenvalue at most
    bend = 0.25 * np.linalg.norm(m, 2) ** 2 / len(y) + 0.25
    w, b = np.zeros(m.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(m @ vw + vb))) - y
        nw = vw - m.T @ error / len(y) / bend
        nw = np.sign(nw) * np.maximum(np.abs(nw) - LASSO / bend, 0)
        nb = vb - error.mean() / bend
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    w = w / scale
    return float(b - w @ centre), [(r, float(x)) for r, x in zip(kept, w, strict=True) if x]


def compile_rules(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble as a column over the statistics: a score from 0 to 1."""
    names = list(STATISTICS)
    total = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for j, above, at in rule:
            test = test & (F.col(names[j]) > at if above else F.col(names[j]) <= at)
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[float, list[tuple[Rule, float]]]:
    """Fits on at most `rows` labelled rows that aren't held out. An id with several labels counts as its least."""
    sample = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_y"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    # at most `rows` rows: a fixed bound
    joined = df.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id").select("_id", "_y", "text")
    # a row for each id: of rows that repeat it, that with the least statistics
    once = statistics(joined).groupBy("_id").agg(F.min(F.struct("_y", *STATISTICS)).alias("_row"))
    got = once.select("_id", "_row.*").orderBy("_id").toPandas()
    return fit(got[list(STATISTICS)].to_numpy(float), got["_y"].to_numpy(float)) if len(got) else (0.0, [])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = statistics(docs).select("doc_id", held_out().alias("held_out"), compile_rules(*model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
