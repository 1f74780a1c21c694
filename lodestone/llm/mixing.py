"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents stand in a seeded order, dealt over strata (hash ranges, called shards here), and are cut into blocks of equally many words; how many is chosen for each source by its own size and target, so a source that is small beside the corpus has blocks as fine for it as a large one has. Sainte-Lague gives each source a whole number of words by its target. These are counted in blocks of the source's mean block, as the last of a shard is only part full, and Sainte-Lague divides them over its shards by their numbers of blocks. In a shard with n blocks and quota q every block is taken q // n times, and q % n blocks in a row, from a seeded one on, once more; since the order is seeded, that run is a random set of documents.

Null or empty texts have size 0 and nothing is taken from them; a null source is a source of its own, after all others. Repeated rows are documents of their own. Very long texts are cut like others. An empty table gives no rows. Nothing is collected: what meets in one task is a row for each source (a few dozen bytes, so a million sources would do), and one for each of a source's shards.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, n_words, row_keys

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Strata of a source: so many at least, and one for so many rows of the corpus, so that none grows with it.
SHARDS, SHARD_ROWS = 128, 1 << 17
#: Blocks for what is taken of each source once, and the most words of a block.
BLOCKS, BLOCK_WORDS = 1 << 16, 4096


def water_fill(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Targets that share sum(sizes) by weight, each at most `most` times its size; what is above goes to the others by weight."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    weight = sum(weights)
    for i in order:
        out[i] = min(most * sizes[i], left * weights[i] / weight) if weight > 0 else 0.0
        left -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats_so_far + 1), the first of equal ones first; `most` bounds each. Starts from the rounded shares, so only a few seats are moved one by one."""
    most = most or [seats] * len(votes)
    seats = min(seats, sum(m for m, v in zip(most, votes, strict=True) if v > 0))
    total = sum(votes)
    if not seats or total <= 0:
        return [0] * len(votes)
    got = [min(m, int(v * seats / total + 0.5)) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    spare = seats - sum(got)
    if spare > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if g > 0]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def _source_quotas(weights: tuple, most: float, blocks: int, block_words: int):
    def quotas(sources: pd.DataFrame) -> pd.DataFrame:
        # UTF-8 bytes sort as code points do
        key = [(s is None, b"" if s is None else s.encode("utf-8", "surrogatepass")) for s in (None if pd.isna(s) else s for s in sources["source"])]
        at = sorted(range(len(key)), key=key.__getitem__)
        sources = sources.iloc[at].reset_index(drop=True)
        sizes = [int(x) for x in sources["source_size"]]
        target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
        sources["target"] = target
        sources["block"] = [max(1, min(block_words, int(min(n, t)) // blocks)) for n, t in zip(sizes, target, strict=True)]
        sources["words"] = sainte_lague(target, round(sum(target)), [int(most * n) for n in sizes])
        return sources[["source", "source_size", "target", "block", "words"]]

    return quotas


def _shard_quotas(most: float):
    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard").reset_index(drop=True)
        block = int(shards["block"].iloc[0])
        shards["blocks"] = [-(-int(n) // block) for n in shards["shard_size"]]
        # in integers: a source's words times its blocks can be beyond a double
        size, words, n = int(shards["source_size"].iloc[0]), int(shards["words"].iloc[0]), int(shards["blocks"].sum())
        seats = (2 * words * n + size) // (2 * size) if size else 0
        shards["quota"] = sainte_lague([float(b) for b in shards["blocks"]], seats, [int(most) * b for b in shards["blocks"]])
        return shards[["source", "shard", "source_size", "target", "block", "blocks", "quota"]]

    return quotas


def mix_plan(sized: DataFrame, seed: int, weights=WEIGHTS, most=MAX_REPEATS, blocks=BLOCKS, block_words=BLOCK_WORDS) -> DataFrame:
    """sized: columns source, size, shard. A row for each source and shard: its blocks and quota."""
    by_shard = sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    by_source = by_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size"))
    sources = by_source.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(_source_quotas(weights, most, blocks, block_words), "source string, source_size long, target double, block long, words long")
    joined = by_shard.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.groupBy("source").applyInPandas(_shard_quotas(most), "source string, shard int, source_size long, target double, block long, blocks long, quota long")


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(b, d) - F.greatest(a, c))


#: What mix adds.
ADDED = ("source_size", "target", "passes", "lo1", "hi1", "lo2", "hi2", "taken")


def mix(df: DataFrame, seed: int = 17, size: str = "size", source: str = "source", order: tuple[str, ...] = ("doc_id",), **plan) -> DataFrame:
    """df has a size in words and a source for each row; adds source_size, target, taken, and the parts taken besides whole passes:
    `passes` times the whole row, and words [lo1, hi1) and [lo2, hi2) of it once more. Columns of df with those names are replaced; others, whatever their names, are kept."""
    kept = [c for c in df.columns if c not in ADDED]
    # df's own columns travel in a struct, so no name of theirs meets one of ours
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(None).alias("row")
    own = df.select(row, F.col(f"`{size}`").alias("size"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order]).alias("h"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    shards = plan.pop("shards", None) or max(SHARDS, -(-df.count() // SHARD_ROWS))
    own = own.withColumn("shard", F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int"))
    p = mix_plan(own.select("source", "size", "shard"), seed, **plan).select(
        F.col("source").alias("ps"), F.col("shard").alias("pk"), "source_size", "target", "block", "blocks", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long").alias("passes"), F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).cast("long").alias("more")
    )
    # where the seeded run of blocks begins; it may wrap round the shard's end
    p = p.withColumn("first", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "ps", "pk"), F.col("blocks"))).otherwise(0))
    run = W.partitionBy("source", "shard").orderBy("h", *[f"o{i}" for i in range(len(order))], "size").rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumn("end", F.sum("size").over(run))
    own = own.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("shard") == F.col("pk")))
    begin, end = F.col("end") - F.col("size"), F.col("end")
    stop = F.col("first") + F.col("more")
    a1, b1 = F.col("first") * F.col("block"), F.least(stop, F.col("blocks")) * F.col("block")
    b2 = F.greatest(F.lit(0).cast("long"), stop - F.col("blocks")) * F.col("block")
    own = own.withColumns({
        "lo1": F.greatest(F.lit(0).cast("long"), a1 - begin),
        "hi1": F.greatest(F.lit(0).cast("long"), a1 - begin) + _overlap(begin, end, a1, b1),
        "lo2": F.lit(0).cast("long"),
        "hi2": _overlap(begin, end, F.lit(0).cast("long"), b2),
    })
    own = own.withColumn("taken", F.col("passes") * F.col("size") + F.col("hi1") - F.col("lo1") + F.col("hi2") - F.col("lo2"))
    return own.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *ADDED)


def mix_documents(df: DataFrame, seed: int = 17, text: str = "text", source: str = "source", key: str = "doc_id", **plan) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, in the columns it came with. Only documents at the ends of a seeded run are cut, at words, with a space between those kept; a document without words goes, since nothing is taken from it. n_chars, if there, counts a cut text's characters anew. Rows that share an id but differ in any column are documents of their own; equal rows are decided one by one and written as often as all of them are taken."""
    names = df.columns
    k1, k2 = row_keys(df)
    rows = df.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    same = df.select(n_words(F.col(f"`{text}`")).alias("size"), F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("id"), k1.alias("k1"), k2.alias("k2"))
    decided = mix(same, seed, "size", "source", ("id", "k1", "k2"), **plan)
    parts = F.array(*[F.struct(F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in (1, 2)])
    whole = [(F.col(f"hi{i}") - F.col(f"lo{i}") == F.col("size")).cast("long") for i in (1, 2)]
    decided = decided.where("taken > 0").select("k1", "k2", (F.col("passes") + whole[0] + whole[1]).alias("passes"), F.filter(parts, lambda p: (p["hi"] > p["lo"]) & (p["hi"] - p["lo"] < F.col("size"))).alias("parts"))
    # equal rows have decisions of their own, which are added up; only rows at the ends of a run have parts
    decided = decided.groupBy("k1", "k2").agg(F.sum("passes").alias("passes"), F.flatten(F.collect_list("parts")).alias("parts"))
    # rows with equal keys are equal, so it is all one which of them is kept; both steps deal rows by the same keys
    rows = rows.groupBy("k1", "k2").agg(F.first("row").alias("row")).join(decided, ["k1", "k2"])
    no_part = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    copies = F.when(F.col("passes") > 0, F.array_repeat(no_part, F.col("passes").cast("int"))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    rows = rows.select("row", F.explode(F.concat(copies, "parts")).alias("part"))
    own = F.col(f"row.`{text}`")
    words = F.regexp_extract_all(own, F.lit(r"([^\x20\x09-\x0D]+)"))
    cut = F.array_join(F.slice(words, (F.col("part.lo") + 1).cast("int"), (F.col("part.hi") - F.col("part.lo")).cast("int")), " ")
    is_cut = F.col("part.hi") > 0
    rows = rows.select("row", is_cut.alias("is_cut"), F.when(is_cut, cut).otherwise(own).alias("text"))
    made = {text: F.col("text")} | ({"n_chars": F.when(F.col("is_cut"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in names and text != "n_chars" else {})
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")
