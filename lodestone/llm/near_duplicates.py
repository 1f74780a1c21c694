"""Near duplicates by a grouped prefix join on Jaccard similarity of word shingles.

1. A sketch: every document adds its distinct shingles to 2**SKETCH_BITS counters, whose sums over the whole corpus put shingles in one global order, rare before frequent. Any fixed order gives right results; this one keeps common lines and passages out of prefixes. The sketch has a fixed size, and is what is broadcast.
2. A document of n shingles has as prefix its first n - ceil(t * n) + 1. Documents with equal prefixes and sizes collapse into a group, and inside it those with equal sets (a 128-bit sum of hashes) into a class. From here on copies cost nothing.
3. Groups post their prefix shingles. First each group is paired with the leader of a posting (of a cell of it, where the sketch says that a posting is long): the group in which the posting's shingle comes first. Only the most frequent partner counts: a number of pairs linear in the groups. Pairs are verified on whole sets, and links united.
4. Only postings that hold several components after that can hold a link that still matters. Their groups are paired, a long posting being dealt over several tasks, and pairs of groups are held against the size and overlap bounds, which are the same for all members of a group. What is left is expanded to members of different components, as is a group that holds several by itself, and verified on whole sets. So no link between two components is missed, and no large group of copies or near copies is paired with itself.
5. Connected components by alternating large-star and small-star steps.

Shingles are compared by 64-bit hashes. A null, empty or blank text has no shingles and no links. A row whose id is null has no links and a null component. Rows that share an id are one document. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Stages, delete_at_exit, documents, releasing, small
from ._words import BLANK_WORDS, mix, runs, text_slices, whole, words

SHINGLE = 5
#: Similarity of 75 / 100.
PERCENT = 75
SKETCH_BITS, SLOTS, FAN_IN = 22, 64, 64
#: A posting that may be longer than this is dealt out to cells.
CELL = 8192
#: A posting over several components with more groups than this is a long one; a task pairs so many of its groups with all others.
LONG, MEET = 64, 4096
#: Classes that so many documents share at least, and one in so many of all documents, are broadcast to them.
HOT, HOT_SHARE = 256, 1_000_000
U = np.uint64


def shingle_sets(column, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text; with fewer than k words, one shingle of them all."""
    for row, end, data, offsets in text_slices(column):
        h, starts = words(data, offsets, BLANK_WORDS)
        every = runs(h, k)
        for d in range(end - row):
            a, b = starts[d], starts[d + 1]
            if b - a >= k:
                yield row + d, np.unique(every[a : b - k + 1])
            elif b > a:
                yield row + d, np.array([whole(h[a:b])], U)
            else:
                yield row + d, np.empty(0, U)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def add():
            nonlocal held, size
            if held:
                counts[:] += np.bincount((np.concatenate(held) & U(len(counts) - 1)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            held, size = [], 0

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    add()
        add()
        if counts.any():
            yield _slots(TaskContext.get().partitionId(), np.split(counts, SLOTS))

    return sketch


SKETCH = "part long, slot int, counts binary"


def _slots(part: int, slots: list[np.ndarray], first: int = 0) -> pa.RecordBatch:
    packed = [zlib.compress(s.astype("<u4").tobytes(), 1) for s in slots]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(slots), pa.int64()), pa.array(range(first, first + len(slots)), pa.int32()), pa.array(packed, pa.binary())], ["part", "slot", "counts"])


def _add(key, pdf):
    import pandas as pd

    total = np.zeros((1 << SKETCH_BITS) // SLOTS, np.uint64)
    for packed in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(packed), "<u4")
    total = np.minimum(total, 2**32 - 1)
    return pd.DataFrame({"part": [key[1]], "slot": [key[0]], "counts": [zlib.compress(total.astype("<u4").tobytes(), 1)]})


def frequency_ranks(texts: DataFrame, stages: Stages, k: int = SHINGLE) -> np.ndarray:
    """A byte of up to 127 for each counter of the sketch: four steps to each doubling of its count. The tasks' sketches are added up FAN_IN at a time."""
    parts = stages.write(texts.mapInArrow(releasing(_sketch(k)), SKETCH), "sketch")
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    sums = parts
    while True:
        n = -(-n // FAN_IN)
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("slot", "part").applyInPandas(_add, SKETCH)
        if n <= 1:
            break
    ranks = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = len(ranks) // SLOTS
    # SLOTS rows of a fixed size
    for _, slot, packed in sums.collect():
        c = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.float64)
        ranks[slot * width : (slot + 1) * width] = np.minimum(127, np.floor(4 * np.log2(1 + c)))
    stages.drop("sketch")
    return ranks


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s ^ U(0x1234567)).sum().astype(np.int64)), int(mix(s + U(0xABCDEF)).sum().astype(np.int64))


PREFIXES = "doc_id long, n int, d1 long, d2 long, g1 long, g2 long, prefix array<bigint>"


def _prefixes(ranks, k: int, percent: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        mask = U(len(rank) - 1)
        for batch in batches:
            ids, n, digests, cut, held, size = batch.column(0), [], [], [], [], 0
            done = 0

            def out(upto: int) -> pa.RecordBatch:
                offsets = np.concatenate([[0], np.cumsum(cut)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held) if held else np.empty(0, np.int64), pa.int64()))
                d = np.array(digests, np.int64).reshape(-1, 4)
                return pa.RecordBatch.from_arrays([ids.slice(done, upto - done), pa.array(n, pa.int32()), *[pa.array(d[:, i]) for i in range(4)], lists], ["doc_id", "n", "d1", "d2", "g1", "g2", "prefix"])

            for row, s in shingle_sets(batch.column(1), k):
                key = (rank[(s & mask).astype(np.int64)].astype(U) << U(56)) | (s >> U(8))
                p = prefix_length(len(s), percent)
                if p < len(key):
                    key = np.partition(key, p - 1)[:p]
                key.sort()
                n.append(len(s))
                digests.append((*_digest(s), *_digest(key)))
                cut.append(p)
                held.append(key.view(np.int64))
                size += p
                if size > 500_000:
                    yield out(row + 1)
                    done, n, digests, cut, held, size = row + 1, [], [], [], [], 0
            if done < batch.num_rows:
                yield out(batch.num_rows)

    return prefixes


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, d1, out, size = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(out, pa.binary())], ["id", "n", "d1", "shingles"])

            for row, s in shingle_sets(batch.column(1), k):
                rows.append(row)
                n.append(len(s))
                d1.append(_digest(s)[0])
                out.append(s.tobytes())
                size += len(s)
                if size > 500_000:
                    yield made()
                    rows, n, d1, out, size = [], [], [], [], 0
            if rows:
                yield made()

    return sets


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return verify


def verified(df: DataFrame, pairs: DataFrame, stages: Stages, name: str, k: int, percent: int) -> DataFrame:
    """pairs: written; a, na, da, b, nb, db (id, size and digest of two sets). Those that link, as a, b."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ends = stages.write(ends, f"{name}-ids")
    texts = df.select("_id", "_text").join(small(ends), F.col("_id") == F.col("id"), "left_semi")
    sets = texts.mapInArrow(releasing(_sets(k)), "id long, n int, d1 long, shingles binary").dropDuplicates(["id", "n", "d1"])
    sets = stages.write(sets, f"{name}-sets")
    left, right = (sets.select(F.col("id").alias(f"i{x}"), F.col("n").alias(f"n_{x}"), F.col("d1").alias(f"d_{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    joined = pairs.join(left, (F.col("a") == F.col("ia")) & (F.col("na") == F.col("n_a")) & (F.col("da") == F.col("d_a"))).drop("ia", "n_a", "d_a")
    joined = joined.join(right, (F.col("b") == F.col("ib")) & (F.col("nb") == F.col("n_b")) & (F.col("db") == F.col("d_b"))).select("a", "b", "sa", "sb")
    links = stages.write(joined.mapInArrow(releasing(_verify(percent)), "a long, b long").distinct(), f"{name}-links")
    stages.drop(f"{name}-ids", f"{name}-sets")
    return links


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """edges a, b. node and label (the least node that it reaches), for nodes with an edge. Large-star and small-star in turn until nothing changes; each is written."""
    u, v = F.col("u"), F.col("v")
    now = stages.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state = None
    step = 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        star = both.where(v > u).join(least, u == F.col("w")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node itself also moves to the least of its lower neighbours
        low = star.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        moved = star.join(low, u == F.col("w"))
        star = moved.select(v.alias("u"), F.col("m").alias("v")).where(u != v).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        step += 1
        new = stages.write(star, f"{name}-{step}")
        stages.drop(f"{name}-{step - 1}")
        now = new
    return now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of df: the key, n_shingles and component_id (the least key that links reach, itself included)."""
    spark = df.sparkSession
    stages = Stages(spark, "near")
    df = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    ranks = spark.sparkContext.broadcast(frequency_ranks(df.select("_text"), stages, k))
    docs = stages.write(df.mapInArrow(releasing(_prefixes(ranks, k, percent)), PREFIXES), "docs")
    ranks.destroy()

    linked = docs.where("doc_id is not null and n > 0")
    groups = linked.groupBy("n", "g1", "g2").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"), F.min("d1").alias("lo"), F.max("d1").alias("hi"))
    posted = groups.select("gid", "n", (F.col("lo") != F.col("hi")).alias("several"), F.posexplode("prefix").alias("pos", "token"))
    # cells: how long the posting can be, by the sketch's rank in the token's first byte
    longest = F.pow(F.lit(2.0), (F.shiftrightunsigned("token", 56) + 1) / 4)
    cells = F.greatest(F.lit(1), F.ceil(longest / CELL)).cast("int")
    posted = posted.withColumn("cell", F.when(longest > CELL, F.pmod(F.xxhash64("gid", "n"), cells)).otherwise(0).cast("int"))
    cell = W.partitionBy("token", "cell")
    # the group in which the shingle comes first has the fewest rare ones, so it is nearest to the others
    posted = posted.withColumns({"lead": F.min(F.struct("pos", "gid", "n")).over(cell), "_rows": F.count("*").over(cell), "_several": F.max("several").over(cell)})
    posted = posted.where((F.col("_rows") > 1) | F.col("_several") | (longest > CELL))
    posted = stages.write(posted.select("token", "cell", "gid", "n", "pos", F.col("lead.gid").alias("lid"), F.col("lead.n").alias("ln")), "posted")

    classes = linked.groupBy("n", "g1", "g2", "d1", "d2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"))
    own = classes.join(linked.groupBy("n", "g1", "g2").agg(F.min("doc_id").alias("gid")), ["n", "g1", "g2"])
    classes = stages.write(own.select("n", "d1", "cid", "gid", "copies"), "classes")

    # linear pairs: a group with its most frequent leader, a cell's leader with its posting's, a class with its group's first
    bound = F.col("c") + F.greatest(_rest(F.col("n"), percent), _rest(F.col("ln"), percent)) >= _overlap(F.col("n"), F.col("ln"), percent)
    led = posted.where("gid <> lid or n <> ln").groupBy("gid", "n", "lid", "ln").agg(F.count("*").alias("c"))
    led = led.where(_sizes(F.col("n"), F.col("ln"), percent) & bound).groupBy("gid", "n").agg(F.max(F.struct("c", "lid", "ln")).alias("best")).select("gid", "n", F.col("best.lid").alias("lid"), F.col("best.ln").alias("ln"))
    heads = posted.where(F.shiftrightunsigned("token", 56) >= int(4 * np.log2(CELL)) - 1).select("token", F.col("lid").alias("gid"), F.col("ln").alias("n")).distinct()
    first = heads.groupBy("token").agg(F.min(F.struct("gid", "n")).alias("lead")).withColumnRenamed("token", "_token")
    heads = heads.join(first, F.col("token") == F.col("_token")).select("gid", "n", F.col("lead.gid").alias("lid"), F.col("lead.n").alias("ln")).where("gid <> lid")
    heads = heads.where(_sizes(F.col("n"), F.col("ln"), percent)).distinct()
    lead = classes.where("cid = gid").select(F.col("cid").alias("_cid"), F.col("n").alias("_n"), "d1")
    star = led.union(heads).distinct()
    star = star.join(lead, (F.col("gid") == F.col("_cid")) & (F.col("n") == F.col("_n"))).select("gid", "n", F.col("d1").alias("da"), "lid", "ln")
    star = star.join(lead, (F.col("lid") == F.col("_cid")) & (F.col("ln") == F.col("_n"))).select(F.col("gid").alias("a"), F.col("n").alias("na"), "da", F.col("lid").alias("b"), F.col("ln").alias("nb"), F.col("d1").alias("db"))
    inner = classes.where("cid <> gid").select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("d1").alias("da"), F.col("gid").alias("b"), F.col("n").alias("nb"))
    inner = inner.join(lead, (F.col("b") == F.col("_cid")) & (F.col("nb") == F.col("_n"))).select("a", "na", "da", "b", "nb", F.col("d1").alias("db"))
    pairs = stages.write(star.union(inner), "pairs-1")
    links = verified(df, pairs, stages, "star", k, percent)
    labels = stages.write(components(links, stages, "united"), "labels")

    # what those pairs left: postings over several components
    known = classes.join(labels, F.col("cid") == F.col("node"), "left").select("gid", "n", "d1", "cid", F.coalesce("label", "cid").alias("label"))
    known = stages.write(known, "known")
    span = known.groupBy("gid", "n").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left = span.select(F.col("gid").alias("_gid"), F.col("n").alias("_n"), "lo", "hi")
    post = posted.select("token", "gid", "n", "pos").join(left, (F.col("gid") == F.col("_gid")) & (F.col("n") == F.col("_n"))).select("token", "gid", "n", "pos", "lo", "hi")
    post = stages.write(post, "post")
    mixed = post.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("_rows")).where("lo < hi").select(F.col("token").alias("_token"), "_rows")
    post = post.join(mixed, F.col("token") == F.col("_token")).drop("_token")
    # shingles before this one that can be shared with another component, those of them in long postings, and shingles after it
    post = post.withColumn("hot", (F.col("_rows") > LONG).cast("int"))
    group = W.partitionBy("gid", "n")
    so_far = group.orderBy("token").rowsBetween(W.unboundedPreceding, W.currentRow)
    post = post.withColumns({"before": F.row_number().over(group.orderBy("token")) - 1, "hots": F.sum("hot").over(so_far) - F.col("hot"), "all_hot": F.sum("hot").over(group), "after": F.col("n") - F.col("pos") - 1})
    deals = F.ceil(F.col("_rows") / MEET).cast("int")

    def side(x: str) -> DataFrame:
        deal = F.pmod(F.xxhash64("gid", "n"), deals).cast("int") if x == "a" else F.explode(F.sequence(F.lit(0), deals - 1))
        before = F.when(F.col("hot") == 1, F.col("hots")).otherwise(F.col("before"))
        return post.select(F.col("token").alias(f"t{x}"), deal.alias(f"e{x}"), F.col("hot").alias(f"o{x}"), F.col("gid").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}"), before.alias(f"p{x}"), F.col("all_hot").alias(f"h{x}"), F.col("after").alias(f"r{x}"))

    # a pair that shares an earlier shingle of a short posting is met there; at a long posting only pairs count that can link without one
    most = F.least("pa", "pb") + 1 + F.least("ra", "rb")
    least = _overlap(F.col("na"), F.col("nb"), percent)
    once = (F.col("ga") < F.col("gb")) | ((F.col("ga") == F.col("gb")) & (F.col("na") < F.col("nb")))
    apart = F.least("loa", "lob") < F.greatest("hia", "hib")
    met = side("a").join(side("b"), (F.col("ta") == F.col("tb")) & (F.col("ea") == F.col("eb")) & once & apart & _sizes(F.col("na"), F.col("nb"), percent) & (most >= least))
    met = met.groupBy("ga", "na", "gb", "nb").agg(F.sum(1 - F.col("oa")).alias("c"), F.max(F.least("ha", "hb")).alias("h"))
    # long postings that both are in are counted whole, as not all of them were met
    met = met.where(F.col("c") + F.col("h") + F.greatest(_rest(F.col("na"), percent), _rest(F.col("nb"), percent)) >= least).select("ga", "na", "gb", "nb")
    alone = span.where("lo < hi").select(F.col("gid").alias("ga"), F.col("n").alias("na"), F.col("gid").alias("gb"), F.col("n").alias("nb"))
    met = stages.write(met.unionByName(alone), "groups-met")

    # members of the groups that are left
    a, b = (known.select(F.col("gid").alias(f"_g{x}"), F.col("n").alias(f"_n{x}"), F.col("d1").alias(f"d{x}"), F.col("cid").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    pairs = met.join(a, (F.col("ga") == F.col("_ga")) & (F.col("na") == F.col("_na"))).join(b, (F.col("gb") == F.col("_gb")) & (F.col("nb") == F.col("_nb")))
    same = (F.col("ga") == F.col("gb")) & (F.col("na") == F.col("nb"))
    pairs = pairs.where((F.col("la") != F.col("lb")) & (~same | (F.col("la") < F.col("lb")))).select("a", "na", "da", "b", "nb", "db")
    pairs = stages.write(pairs, "pairs-2")
    more = verified(df, pairs, stages, "rest", k, percent)
    labels = components(links.union(more), stages, "all")
    labels = stages.write(labels, "labels-all")
    final = stages.write(docs_components(docs, classes, labels), "result")
    result = stages.paths.pop("result")
    delete_at_exit(spark, result)
    stages.drop()
    return spark.read.schema(final.schema).parquet(result).withColumnRenamed("doc_id", key)


def docs_components(docs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The component of each document by its class. A class of many documents would meet them in one task, so those are broadcast: each has one in HOT_SHARE of all documents at least, so there are HOT_SHARE of them at most."""
    docs = docs.select("doc_id", "n", "d1")
    own = classes.join(labels, F.col("cid") == F.col("node"), "left").groupBy(F.col("n").alias("_n"), F.col("d1").alias("_d1")).agg(F.min(F.coalesce("label", "cid")).alias("_of"), F.sum("copies").alias("copies"))
    many = max(HOT, (classes.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE)
    has = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    hot = F.broadcast(own.where(F.col("copies") > many).select(F.col("_n").alias("_hn"), F.col("_d1").alias("_hd"), F.col("_of").alias("_hot")))
    found = docs.join(hot, has & (F.col("n") == F.col("_hn")) & (F.col("d1") == F.col("_hd")), "left")
    # those that are done, and those without shingles, go past the second join, whose keys are never null for the others
    rest = found.where(has & F.col("_hot").isNull()).join(own.where(F.col("copies") <= many), (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")), "left").select("doc_id", "n", F.col("_of").alias("component_id"))
    done = found.where(~has | F.col("_hot").isNotNull()).select("doc_id", "n", F.when(has, F.col("_hot")).otherwise(F.col("doc_id")).alias("component_id"))
    return rest.unionByName(done).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _overlap(n, m, percent: int):
    """The least overlap of linked sets of n and m: percent / (100 + percent) of n + m."""
    return F.ceil(F.lit(percent) * (n.cast("long") + m.cast("long")) / F.lit(100 + percent))


def _rest(n, percent: int):
    """What comes after the prefix."""
    return F.ceil(F.lit(percent) * n.cast("long") / 100) - 1


def _sizes(n, m, percent: int):
    return F.lit(100) * F.least(n, m).cast("long") >= F.lit(percent) * F.greatest(n, m).cast("long")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


#: Every pair that shares a shingle and whose sizes allow a link is counted; what links reach is followed step by step.
OP1_SQL = r"""
with recursive dw as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), shingle as (
    select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from dw where len(w) > 0)
), size as (
    select doc_id, count(*) as n from shingle group by doc_id
), sized as (
    select doc_id, s, n from shingle join size using (doc_id)
), met as (
    select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as common
    from sized a join sized b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by all
), link as (
    select x, y from met where 100 * common >= 75 * (nx + ny - common)
), step as (
    select x, y from link union all select y, x from link
), reach as (
    select doc_id, doc_id as other from dw
    union
    select doc_id, y from reach join step on other = x
)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, min(other) as component_id from reach left join size using (doc_id) group by doc_id, n
"""
