"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

Only DataFrame expressions. Rows with equal keys share a shard; with one shard more, only the fraction 1/(n+1) of the keys moves, all of it into the new shard. A null key counts as key 0, a null text as no bytes. Repeated rows and ties get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents

#: Multiplier of the 64-bit linear congruential generator in Lamping and Veach (2014).
MULTIPLIER = 2862933555777941757
_32, _16 = 0xFFFFFFFF, 0xFFFF
#: Rows of all shards for one more bucket in each, and buckets up to which their counts are broadcast.
BUCKET_ROWS, MOST_BUCKETS = 1 << 18, 1 << 14


def _times(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * MULTIPLIER + 1 modulo 2**64 in 32-bit halves; no product passes 2**48, so nothing overflows under ANSI rules."""
    c_high, c_low = MULTIPLIER >> 32, MULTIPLIER & _32

    def wide(x: Column, c: int) -> tuple[Column, Column]:
        return x * F.lit(c >> 16), x * F.lit(c & _16)

    upper, lower = wide(low, c_low)
    sum_low = F.shiftleft(upper.bitwiseAND(F.lit(_16)), 16) + lower.bitwiseAND(F.lit(_32)) + F.lit(1)
    carry = F.shiftright(sum_low, 32) + F.shiftright(upper, 16) + F.shiftright(lower, 32)

    def narrow(x: Column, c: int) -> Column:
        upper, lower = wide(x, c)
        return F.shiftleft(upper.bitwiseAND(F.lit(_16)), 16) + lower.bitwiseAND(F.lit(_32))

    return (carry + narrow(high, c_low) + narrow(low, c_high)).bitwiseAND(F.lit(_32)), sum_low.bitwiseAND(F.lit(_32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key (its 64 bits unsigned). b grows with every jump, so `shards` steps always end it."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_32)).alias("low"),
    )

    def jump(s: Column, _: Column) -> Column:
        high, low = _times(s["high"], s["low"])
        far = (s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), F.least(far, F.lit(9e15)).cast("long").alias("j"), high.alias("high"), low.alias("low")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["b"]).cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, grown: int | None = None) -> DataFrame:
    """Adds `shard`, and `grown_shard` under `grown` shards. Columns of those names are replaced."""
    df = df.withColumn("shard", jump_shard(F.col(key), shards))
    return df if grown is None else df.withColumn("grown_shard", jump_shard(F.col(key), grown))


def number_slots(df: DataFrame, shard: str, order: list[str], buckets: int | None = None) -> DataFrame:
    """Adds `slot`: 0, 1, 2, ... without gaps in each shard. Rows are numbered in hash buckets of a shard, of which there are more the more rows there are, and buckets by running counts, so no task holds a shard."""
    buckets = buckets or max(256, -(-df.count() // BUCKET_ROWS))
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order]).cast("binary"))
    df = df.withColumn("_bucket", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    counts = df.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(*order))
    df = df.withColumn("_row", inside)
    # a row for each shard and bucket, which are few beside the rows; broadcast while surely small
    starts = F.broadcast(starts) if buckets <= MOST_BUCKETS else starts
    return df.join(starts, (df[shard] == starts["_shard"]) & (df["_bucket"] == starts["_of"])).withColumn("slot", F.col("_start") + F.col("_row") - 1).drop("_bucket", "_row", "_start", "_shard", "_of")


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Writes df to one folder for each shard (shard=0, ...)."""
    assign_shards(df, key, shards).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = assign_shards(rows, "doc_id", 16, grown=17)
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _nibbles() -> list[int]:
    """What each half byte adds to a CRC-32."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: A byte of a CRC-32 by its halves; jumps in 128-bit integers; slots by running numbers over all rows of a shard.
OP9_SQL = f"""
with recursive texts as (
    select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents
), bytes as (
    select doc_id, n, list_prepend(4294967295::bigint, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)) as b from texts
), sums as (
    select doc_id, n + 1 as size, xor(4294967295::bigint, list_reduce(b, lambda c, x: xor(xor(xor(c, x) >> 4, {_nibbles()}[1 + (xor(c, x) & 15)]) >> 4, {_nibbles()}[1 + (xor(xor(c, x) >> 4, {_nibbles()}[1 + (xor(c, x) & 15)]) & 15)]))) as crc from bytes
), jumps as (
    select distinct doc_id, s.n as shards, (coalesce(doc_id, 0)::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as k, 0::bigint as b, 0::bigint as j from documents, (values (16), (17)) s(n)
    union all
    select doc_id, shards, k, b, floor((b + 1)::double * (2147483648::double / ((k // 8589934592)::double + 1)))::bigint from (
        select doc_id, shards, (k * {MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint as k, j as b from jumps where j < shards)
), shards as (
    select doc_id, max(case when shards = 16 and j >= 16 then b end)::int as shard, max(case when shards = 17 and j >= 17 then b end)::int as grown from jumps group by doc_id
), placed as (
    select s.doc_id, size, crc, shard, grown, ('0x' || md5(concat_ws(':', s.doc_id, crc, size))[1:8])::bigint % greatest(256, ceil((select count(*) from documents) / {float(BUCKET_ROWS)}))::bigint as bucket
    from sums s join shards on shards.doc_id is not distinct from s.doc_id
)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by bucket, doc_id nulls first, crc, size) - 1 as slot, grown as grown_shard from placed
"""
