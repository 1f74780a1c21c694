"""Literal cases of the text, parser, retrieval and evaluation modules."""

import io
import tracemalloc
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import intent, text
from lodestone.operators import evaluation, listing, metadata, retrieval
from lodestone.sources import parsers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_chunk_geometry(spark):
    df = spark.createDataFrame([(1, "A" * 250 + "\n\n" + "B" * 147 + " " + "B" * 202)], "id int, t string")
    got = [r.text for r in metadata.chunks(df, "id", F.col("t")).orderBy("chunk_index").collect()]
    assert [len(x) for x in got] == [400, 252]
    assert got[0][-50:] == got[1][:50]


def test_point_id_is_uuid5(spark):
    assert one(spark, text.point_id(F.lit("d:0"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "rag-chunk:d:0"))


@pytest.mark.parametrize("raw, want", [("井资料\\长63/渗透率", "井资料/长63/渗透率"), ("a/./b//c", "a/b/c"), ("a/../b", None)])
def test_paths(spark, raw, want):
    assert one(spark, text.normalise_path(F.lit(raw))) == want


def test_normalise(spark):
    assert one(spark, text.normalise_source(F.lit("  a\tb\n\n\n\nc \x00"))) == "a b\n\nc"


@pytest.mark.parametrize("raw, want", [("SKIP", False), ("RETRIEVE", True), ('{"decision":"SKIP"}', False), ('{"decision": "SKIP"', False), ("```json\n{\"decision\": \"SKIP\"}\n```", False), ("perhaps skip", True), ("", True)])
def test_decisions(spark, raw, want):
    assert one(spark, intent.decision_retrieves(F.lit(raw))) is want


def test_char_f1_and_scores(spark):
    df = spark.createDataFrame([(1, "ab中文", "ab中文"), (2, "", "x")], "id int, e string, a string")
    assert {r.id: r.char_f1 for r in evaluation.char_f1(df, "id", "e", "a").collect()} == {1: 1.0, 2: 0.0}
    assert round(one(spark, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.8), F.lit(0.6)))), 6) == 0.8
    assert one(spark, evaluation.passed(F.lit(False), F.lit(False), F.lit(None).cast("boolean"), F.lit(True), F.lit(74.9))) is False
    assert one(spark, evaluation.hit(F.array(F.lit("a")), F.array(F.lit(None).cast("string")), F.lit(True))) is False


def test_upsert_and_budget(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, metadata.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    df = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "y" * 10), (1, 3, "z")], "g int, i int, t string")
    assert [r.t for r in retrieval.within_budget(df, "g", "i", "t", F.lit("h"), 20).orderBy("i").collect()] == ["x" * 10, "yyyy"]


def test_cells_recall(spark):
    points = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    questions = points.where("vec_id % 20 = 0").selectExpr("vec_id as question_id", "label", "embedding as qvec")
    centres = retrieval.fit_cells(points, 16)
    index = retrieval.index_cells(points, centres)
    assert index.count() == points.count()
    pairs = lambda df: {(r.question_id, r.vec_id) for r in df.collect()}
    exact = pairs(retrieval.top_k(points, questions, 10, "label"))
    assert len(pairs(retrieval.search_cells(index, questions, centres, 10, 13, "label")) & exact) >= 0.9 * len(exact)
    assert pairs(retrieval.search_cells(index, questions, centres, 10, 16, "label")) == exact


def test_top_k_tiles(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else None, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(90)] + [(100, "a", None), (101, "a", [0.0, 0.0, 0.0]), (102, "a", [1.0]), (103, "b", [])]
    points = spark.createDataFrame(rows, "vec_id int, kb string, embedding array<float>")
    questions = points.where("vec_id % 20 = 0").selectExpr("vec_id as question_id", "kb", "embedding as qvec")
    got = sorted(map(tuple, retrieval.top_k(points, questions, 4, "kb").collect()))
    monkeypatch.setattr(retrieval, "TILE_POINTS", 16)
    monkeypatch.setattr(retrieval, "TILE_QUESTIONS", 2)
    assert sorted(map(tuple, retrieval.top_k(points, questions, 4, "kb").collect())) == got
    assert {r[0] for r in got} == {20, 40, 80} and all(r[3] <= 4 for r in got) and {r[1] for r in got} <= set(range(90))
    assert retrieval.top_k(points.limit(0), questions, 4, "kb").count() == 0


def test_catalogue_without_folder_or_room(spark):
    files = spark.createDataFrame([("a", None, "x.txt", "ready"), ("a", "", "x.txt", "ready"), ("a", None, None, "ready"), ("b", "f", "y.txt", "failed")], "kb string, folder string, file_name string, status string")
    assert [tuple(r) for r in listing.catalogue_text(files).collect()] == [("a", "已入库目录：0 个文件夹，1 个文件。\n[文件夹]\n[文件]\n- x.txt", 0)]
    assert [r.omitted for r in listing.catalogue_text(files, 10).collect()] == [2]
    asked = spark.createDataFrame([("q", "a", ["x.TXT?"]), ("r", "b", ["f"])], "question_id string, kb string, messages array<string>")
    assert {r.question_id: r.headline for r in listing.headlines(asked, files, True).collect()} == {"q": listing.FOUND % 1, "r": listing.EMPTY}
    assert {r.question_id: r.headline for r in listing.headlines(asked, files, False).collect()} == {"q": listing.LISTED % ("知识库", 1), "r": listing.EMPTY}


def test_parsers():
    assert parsers.parse("a.jsonl", '{"井号":"化31"}\n{"产量":12}'.encode())[0][2] == '{"井号": "化31"}\n{"产量": 12}'
    assert parsers.parse("a.csv", b"a;b;\n1.0;;\n;;\n")[0][2] == "a\tb\n1.0"
    assert parsers.parse("a.html", b"<p>x</p><script>y</script>")[0][2] == "x\ny"
    assert parsers.parse("a.xml", b"<r k='v'><a>t</a><b>t</b></r>") == [(None, "r", "v\nt")]
    w = "xmlns:w='urn:w'"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    assert [s[2] for s in parsers.parse("a.docx", _docx(body))] == ["one\nc1\tc2"]
    assert parsers.decode("中文".encode("gb18030")) == "中文"
    with pytest.raises(ValueError):
        parsers.parse("a.pdf", b"%PDF")


def _docx(body: str) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", body)
    return b.getvalue()


def test_read_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("hello")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error is None) for r in parsers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.TXT": ("hello", True), "b.pdf": (None, False)}


def _zipped(files):
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return at.getvalue()


def test_zip_container():
    content = _zipped({"a/x.json": '{"a":1}', "b.bin": b"\x00\x01", "c.HTML": "<p>hello</p>"})
    want = [(None, "a/x.json", '{\n  "a": 1\n}'), (None, "c.HTML", "hello")]
    assert parsers.parse("m.ptpt", content) == want
    assert parsers.parse("m", content) == want
    with pytest.raises(ValueError):
        parsers.parse("m.stpt", b"PK\x03\x04 cut")


def test_byte_strings():
    content = b"\x00\x01alpha one\x00\x02alpha one\x00!!!!!!!!\x01\x02" + "wide text".encode("utf-16-le") + b"\x00\x00" + "长庆油田".encode("gb18030") + b"\x00"
    (source,) = parsers.parse("dir/lib.dll", content)
    head, *lines = source[2].split("可读字符串:\n")
    assert source[:2] == (None, "二进制内容") and head == f"文件名: lib.dll\n文件大小: {len(content)} 字节\n"
    assert lines[0].split("\n") == ["alpha one", "wide text", "长庆油田"]


def test_byte_strings_limit():
    assert len(parsers.byte_strings("x", b"\x00".join(b"word%07d" % i for i in range(20000)))[0][2]) < 120_000
    assert parsers.byte_strings("x", b"")[0][2].endswith("可读字符串:\n")


def test_top_k_room(spark):
    rng = np.random.default_rng(1)
    m, ids = rng.normal(size=(20_000, 8)), np.arange(20_000)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    tracemalloc.start()
    got = list(retrieval._nearest(m[:600], m, ids, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one array of a step's scores, and little beside
    assert peak < 1.3 * 8 * retrieval.STEP * len(m)
    for i in (0, 255, 256, 599):
        scores = np.clip(np.round(m @ m[i], 6), -1, 1)
        want = np.lexsort((ids, -scores))[:3]
        assert got[i][0].tolist() == want.tolist() and np.allclose(got[i][1], scores[want], atol=1e-6)


def test_top_k_of_small_tenants_has_one_kind_of_worker(spark):
    points = spark.createDataFrame([(i, i % 2, [float(i % 7 - 3), float(i % 5), 1.0]) for i in range(90)], "vec_id int, kb int, embedding array<float>").localCheckpoint()
    questions = points.where("vec_id % 20 = 0").selectExpr("vec_id as question_id", "kb", "embedding as qvec")
    df = retrieval.top_k(points, questions, 4, "kb")
    assert df.count() == 20
    # counts of large tenants take no rows from Python
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
