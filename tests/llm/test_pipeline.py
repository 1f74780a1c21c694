"""Stages of the pipeline against brute force, each on its own rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import near_duplicates, quality_rules, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 83}x{i}" for i in range(120))
ROWS = [
    (1, LONG, "en", "a", 1), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, "few words", "en", "b", 9), (5, "spam " * 60, "en", "b", 9), (6, LONG.replace("w1x1 ", "other "), "de", "b", 9), (7, LONG + " end", "en", None, 2), (8, " ".join(f"# $ v{i}" for i in range(30)), "en", "a", 3),
    (9, "\n".join(["same line of text here"] * 3 + [f"line {i} is another one of many" for i in range(4)]), "en", "a", 4), (10, " ".join(f"k{i}" for i in range(40)), "en", "c", 5), (10, " ".join(f"m{i}" for i in range(40)), "en", "c", 5), (None, " ".join(f"n{i}" for i in range(40)), "en", "c", 6), (11, LONG, "en", "a", 1), (11, LONG, "fr", "a", 1),
    (12, "x" * 50_000 + " " + " ".join(f"z{i}" for i in range(50)), "en", "b", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def _kept(text):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    windows = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = {i + k for i in range(n - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    size = sum(map(len, w))
    return not (
        n < 20 or 100 * len(covered) > 30 * n or 10 * len(re.findall(r"[#*$%&|<>]", t)) > 3 * n or len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        or n and not 2 * n <= size <= 20 * n or n and 10 * sum(x in "|-*•" and len(x) == 1 for x in w) > 3 * n
    )


def test_quality(spark, docs):
    got = corpus_pipeline.quality(spark, docs, "")
    assert got.columns == docs.columns
    want = Counter(r for r in ROWS if _kept(r[1]))
    assert Counter(map(tuple, got.collect())) == want and 0 < len(want) < len(ROWS)
    assert corpus_pipeline.quality(spark, docs.limit(0), "").count() == 0


def test_deduplicate(spark, docs):
    got = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()]
    again = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs.repartition(5), "").collect()]
    assert Counter(got) == Counter(again)
    # 1, 6, 7 and 11 are near copies; of the rows of one id and text one stays
    assert sorted((r[0] or 0, r[1] or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in ROWS if r[0] not in (6, 7, 11))


def test_decontaminate(spark, docs, tmp_path):
    items = [(1, " ".join(f"m{i}" for i in range(5, 20))), (2, "few words"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r in ROWS if r[1] != "few words" and not (r[1] or "").startswith("m0"))


def test_mix(spark, docs):
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    words = lambda t: len(WORD.findall(t or ""))
    assert sum(words(r[1]) for r in rows) == sum(words(r[1]) for r in ROWS)
    texts = {r[1] for r in ROWS}
    whole = Counter(r for r in rows if r[1] in texts)
    own = Counter(ROWS)
    assert all(whole[r] <= 3 * own[r] for r in whole) and set(whole) <= set(own)
    for r in rows:
        if r[1] not in texts:
            assert r[4] == len(r[1])
            assert any(x[0] == r[0] and x[2:4] == r[2:4] and r[1] in " ".join(WORD.findall(x[1] or "")) for x in ROWS)


def test_tokenise(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    got = sorted(corpus_pipeline.tokenise(spark, docs, "").collect(), key=lambda r: r.start)
    want = Counter((r[0], len(e := tok.encode(r[1] or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*e, 0], "<u4").tobytes())) for r in ROWS)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_run(spark, tmp_path):
    """The stages in order, each on what the one before it kept."""
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"m{i}" for i in range(5, 20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r[0] for r in ROWS if _kept(r[1])} - {6, 7, 11}
    assert {r.doc_id for r in got} <= kept and {r.doc_id for r in got} >= {1}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mixing", "token_files"]
    assert quality_rules.CURRENT == "v3" and near_duplicates.PERCENT == 75
