"""Benchmark decontamination by winnowing.

Of the hashes of all K-word runs, the least in every WINDOW consecutive ones is kept as a fingerprint, so two texts that share SPAN = K + WINDOW - 1 words in a row share one. Fingerprints of documents and benchmark items are joined, and each hit is extended, word by word along its diagonal, to the shared runs; those of SPAN words or more count. An item of fewer words is looked up as a whole, by the hash of all its words.

A null or empty text has no words and is never contaminated; an item without words never occurs; a null item_id counts as ''. Equal item_ids count once. Repeated rows are judged one by one; an empty benchmark or table gives clean rows or none. Words are compared by 64-bit hashes.

The benchmark's word hashes are sent to the executors in blocks of at most BLOCK_WORDS words (8 bytes each). A larger benchmark takes one pass over the texts for each block; a pass writes only rows with hits, under two hashes of the whole row, and its block is given up before the next one is made. The hits are merged at the end, and rows with equal hashes, which are equal rows, share them. Any columns may come along, maps included, under any names but n_words, n_hit, n_items and items_sha256, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Stages, delete_at_exit, documents, releasing, row_keys, small
from ._words import ALNUM_WORDS, runs, text_slices, words

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
BLOCK_WORDS = 1 << 22
TABLE = 1 << 20
#: Matches of fingerprints that are extended at once.
MATCHES = 1 << 20


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of the hashes are the least of some `window` consecutive ones."""
    if len(h) < window:
        return np.zeros(len(h), bool)
    n = len(h) - window + 1
    least = h[:n].copy()
    for i in range(1, window):
        np.minimum(least, h[i : i + n], out=least)
    kept = np.zeros(len(h), bool)
    for i in range(window):
        kept[i : i + n] |= least == h[i : i + n]
    return kept


class Index:
    """Fingerprints of some items: sorted hashes with item and place; short items by length."""

    def __init__(self, ids: list[str], hashes: list[np.ndarray], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        keep = [i for i, h in enumerate(hashes) if len(h)]
        self.ids, self.words = [ids[i] for i in keep], [hashes[i] for i in keep]
        parts = defaultdict(list)
        for i, h in enumerate(self.words):
            if len(h) < span:
                parts[len(h)].append((runs(h, len(h)), i, np.zeros(1, np.int64)))
            else:
                r = runs(h, k)
                at = np.flatnonzero(winnow(r, span - k + 1))
                parts[0].append((r[at], i, at))
        self.tables = {}
        for n, rows in parts.items():
            h = np.concatenate([r[0] for r in rows])
            item = np.repeat([r[1] for r in rows], [len(r[0]) for r in rows])
            at = np.concatenate([r[2] for r in rows])
            order = np.argsort(h, kind="stable")
            table = np.zeros(TABLE, bool)
            table[(h & np.uint64(TABLE - 1)).astype(np.int64)] = True
            self.tables[n] = (table, h[order], item[order], at[order])

    def hits(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """h: word hashes of several documents; starts: where each begins, and the end. Returns which words are hit, and the items of each hit document."""
        hit, found = np.zeros(len(h), bool), defaultdict(set)
        for n, (table, keys, item, at) in self.tables.items():
            r = runs(h, n or self.k)
            mask = table[(r & np.uint64(TABLE - 1)).astype(np.int64)]
            if not n and mask.any():
                mask &= winnow(r, self.span - self.k + 1)
            places = np.flatnonzero(mask)
            first, last = np.searchsorted(keys, r[places], "left"), np.searchsorted(keys, r[places], "right")
            total = np.cumsum(last - first)
            # so many matches at once, or those of one place
            cuts = np.unique(np.searchsorted(total, np.arange(MATCHES, total[-1], MATCHES))) if len(total) else []
            for part, left, right in zip(*(np.split(x, cuts) for x in (places, first, last)), strict=True):
                count = right - left
                if not count.sum():
                    continue
                place = np.repeat(part, count)
                entry = np.repeat(left - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                doc = np.searchsorted(starts, place, "right") - 1
                pairs = np.unique(np.stack([item[entry], place - at[entry], doc], 1), axis=0)
                for i, diagonal, d in pairs:
                    own = self.words[i]
                    need = min(self.span, len(own))
                    lo, hi = max(diagonal, starts[d]), min(diagonal + len(own), starts[d + 1])
                    if hi - lo < need:
                        continue
                    same = np.zeros(hi - lo + 2, np.int8)
                    same[1:-1] = h[lo:hi] == own[lo - diagonal : hi - diagonal]
                    edge = np.flatnonzero(np.diff(same))
                    for a, b in zip(edge[::2], edge[1::2], strict=True):
                        if b - a >= need:
                            hit[lo + a : lo + b] = True
                            found[int(d)].add(int(i))
        return hit, found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in text_slices(batch.column(1)):
            h, starts = words(data, offsets, ALNUM_WORDS)
            out += [h[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["item_id", "words"])


def _scanned(own: Index, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[int, set[int]]]]:
    for row, end, data, offsets in text_slices(column):
        h, starts = words(data, offsets, ALNUM_WORDS)
        yield row, end, starts, *own.hits(h, starts)


def _judge(name: str, index):
    """The columns of a batch, and how it is hit."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            n_words, n_hit, n_items, digest = [], [], [], []
            for row, end, starts, hit, found in _scanned(own, batch.column(name)):
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words += np.diff(starts).tolist()
                n_hit += np.diff(total[starts]).tolist()
                for d in range(end - row):
                    ids = sorted({own.ids[i] for i in found[d]}) if d in found else []
                    n_items.append(len(ids))
                    digest.append(_digest(ids))
            more = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "n_words", "n_hit", "n_items", "items_sha256"])

    return judge


def _hits_only(index):
    """k1, k2, text to k1, k2 and the hit spans and items of rows that are hit."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            rows, spans, items = [], [], []
            for row, _, starts, hit, found in _scanned(own, batch.column("text")):
                for d in sorted(found):
                    part = np.zeros(starts[d + 1] - starts[d] + 2, np.int8)
                    part[1:-1] = hit[starts[d] : starts[d + 1]]
                    rows.append(row + d)
                    spans.append(np.flatnonzero(np.diff(part)).tolist())
                    items.append(sorted({own.ids[i] for i in found[d]}))
            if rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in ("k1", "k2")], pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["k1", "k2", "spans", "items"])

    return hits


#: Words as ALNUM_WORDS has them, capitals included, as a pattern.
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NONE = hashlib.sha256(b"").hexdigest()


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest() if ids else _NONE


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            covered, to = 0, 0
            for a, b in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
                covered += max(0, b - max(to, a))
                to = max(to, b)
            ids = sorted({x for part in items for x in part})
            n_hit.append(covered)
            n_items.append(len(ids))
            digest.append(_digest(ids))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())], ["k1", "k2", "n_hit", "n_items", "items_sha256"])


OUT = ("n_words", "n_hit", "n_items", "items_sha256")


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, n_hit, n_items and items_sha256 to the rows of df; columns of those names are replaced."""
    spark = df.sparkSession
    df = df.drop(*OUT)
    stages = Stages(spark, "benchmark")
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"), F.col(item_text).alias("text"))
    # equal items are one
    own = stages.write(own.mapInArrow(releasing(_hashed), "item_id string, words binary").distinct(), "words")
    total = own.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // (8 * block_words)))

    def block(b: int):
        rows = own.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == b).collect()
        return spark.sparkContext.broadcast(Index([r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows]))

    if n_blocks == 1:
        index = block(0)
        stages.drop()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", n_words long, n_hit long, n_items long, items_sha256 string"
        return df.mapInArrow(releasing(_judge(text, index)), schema)
    k1, k2 = row_keys(df)
    names = df.columns
    keyed = df.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").alias("text"))
    found = []
    for b in range(n_blocks):
        index = block(b)
        found.append(stages.write(keyed.mapInArrow(releasing(_hits_only(index)), "k1 long, k2 long, spans array<bigint>, items array<string>"), f"hits-{b}"))
        index.destroy()
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("k1", "k2").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    merged = stages.write(merged.mapInArrow(releasing(_merge), "k1 long, k2 long, n_hit long, n_items long, items_sha256 string"), "merged")
    # the result still reads these
    delete_at_exit(spark, stages.paths.pop("merged"))
    stages.drop()
    whole = df.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(LETTERS)), F.lit(0)).cast("long").alias("n_words"))
    joined = whole.join(small(merged), ["k1", "k2"], "left")
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(_NONE)).alias("items_sha256"))


def decontaminate(df: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of df in which no benchmark item occurs, in the columns they came with."""
    return find_contamination(df, benchmark, **names).where("n_hit = 0").select(*[f"`{c}`" for c in df.columns])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
with dw as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), bw as (
    select cast(item_id as varchar) as item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark
), win as (
    select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as run
    from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from bw where len(w) > 0)
), sizes as (
    select distinct n from win
), runs as (
    select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)
), hit as (
    select doc_id, r.n, i, item from runs r join win on r.n = win.n and r.run = win.run
), h as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from hit)) group by doc_id
), s as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hit) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join h using (doc_id) left join s using (doc_id)
"""
