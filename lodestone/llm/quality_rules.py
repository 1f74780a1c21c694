"""Quality rules as a bitmask ledger: every rule is measured once, its failure kept as a bit, and policies (sets of rules with a version) are applied to the bits afterwards.

Only DataFrame expressions. A null or empty text has no words, lines or symbols; it fails the rule on few words. Each row is judged by itself, so ties and repeated rows get equal verdicts; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, documents

#: Words of a window, and the least number of words.
WINDOW, LEAST_WORDS = 8, 20

#: name -> failure, as SQL over the measurements. The place in this table is the rule's bit.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words >= 1 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "bullets": "n_words >= 1 and 10 * n_bars > 3 * n_words",
}
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v3": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "bullets"),
}
BASE, CURRENT = "v1", "v3"


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, first occurrences included. Windows are compared by 64-bit hashes: each word is hashed once, and hashes of runs of 2, 4 and 8 words are made from those of half the length. Only a text with a repeated window is sorted."""

    def doubled(hashes: Column, width: int) -> Column:
        n = lambda h: F.size(h) - width
        return _let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), n(h)), F.slice(h, F.lit(width + 1), n(h)), lambda a, b: F.xxhash64(a, b)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        hashes = doubled(hashes, width)

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            hit = F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((F.get(s, k + 1)["h"] == x["h"]), F.lit(False)))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(_let(pairs, places), start, step, lambda a: a["n"])

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_bars; measured_row numbers the rows. A filter on a verdict that also names measured_row isn't pushed below the measurements, which would be made again for it."""
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bars", "measured_row")
    df = df.drop(*[c for c in df.columns if c in own and c != text])
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_words", words)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")
    bars = F.size(F.filter("_words", lambda w: w.isin("|", "-", "*", "•"))).cast("long")
    df = df.select(
        *[c for c in df.columns if c not in (text, "_words")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        symbols.alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        bars.alias("n_bars"),
        F.monotonically_increasing_id().alias("measured_row"),
    )
    return df.withColumns({"n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.dup")}).drop("_lines")


def mask(policy: str, policies: dict = POLICIES, rules: dict = RULES) -> int:
    return sum(1 << list(rules).index(r) for r in policies[policy])


def ledger(df: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """The measurements and `failed_bits`, a bit for each rule that the row fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return measure(df, text).withColumn("failed_bits", total)


def apply_policy(book: DataFrame, policy: str, name: str = "kept", policies: dict = POLICIES) -> DataFrame:
    """Adds whether a row of the ledger passes the policy. Texts aren't read again."""
    return book.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy, policies)).cast("long")) == 0)


def ablation(book: DataFrame, policy: str, policies: dict = POLICIES, rules: dict = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects, so that would come back without it. The ledger is first counted by its bits, of which there are few."""
    whole = mask(policy, policies)
    counts = book.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(rules).index(r)).cast("long").alias("bit")) for r in policies[policy]])).alias("r")
    rows = counts.select("failed_bits", "n", rule)
    fails = F.col("failed_bits").bitwiseAND(F.col("r.bit")) != 0
    only = F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long")) == F.col("r.bit")
    return rows.groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule")).agg(F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(documents(spark, sf_dir, "doc_id", "text"))
    book = apply_policy(apply_policy(book, BASE, "_base"), CURRENT)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failed_bits")


#: Windows are compared as texts here.
OP3_SQL = r"""
with w as (
    select doc_id, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
    from documents
), k as (
    select *, len(words) as n,
        case when len(words) >= 8 then list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' ')) else [] end as windows
    from w
), rep as (
    select doc_id, count(distinct p + o) as n_repeat_words from (
        select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, win) as c from (select doc_id, unnest(windows) as win, unnest(range(len(windows))) as p from k)) where c > 1
    ), range(8) as r(o) group by doc_id
), m as (
    select k.doc_id, cast(n as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(len(list_filter(words, lambda x: x in ('|', '-', '*', '•'))) as bigint) as n_bars,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
    from k left join rep using (doc_id)
), b as (
    select *, cast((n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (10 * n_symbols > 3 * n_words)::int
        + 8 * (n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines)::int + 16 * (n_words >= 1 and (word_chars < 2 * n_words or word_chars > 20 * n_words))::int
        + 32 * (n_words >= 1 and 10 * n_bars > 3 * n_words)::int as bigint) as failed_bits
    from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from b
"""
