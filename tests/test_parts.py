"""Literal cases of parsers, evaluation, gateways, stored tables and streams."""

import hashlib
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import intent, text
from lodestone.operators import answers, evaluation, metadata, store
from lodestone.sources import gateway, maps, objects, office, parsers, plain
from lodestone.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def _zipped(files):
    at = io.BytesIO()
    with zipfile.ZipFile(at, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return at.getvalue()


def test_text_formats():
    assert parsers.parse("a.xml", rb"<r k='v'><a>t\r\nu</a>tail<b> t </b><c>t</c></r>") == [(None, "r", "v\nt\nu\nt")]
    assert parsers.parse("a.xml", "<?xml version='1.0' encoding='gb2312'?><r>中文</r>".encode("gb18030"))[0][2] == "中文"
    assert parsers.parse("a.csv", b"1.50,2,\n,,\n x ,,y\n")[0][2] == "1.50\t2\nx\t\ty"
    assert plain.tab_lines([[1.0, True, None, 2.5, " a "], [None, ""], [3, None]]) == "1\tTrue\t\t2.5\ta\n3"
    with pytest.raises(ValueError, match="line 3"):
        parsers.parse("a.jsonl", b'{"a":1}\n\nnot')
    assert [plain.decode(x) for x in ("é".encode("utf-8-sig"), "中".encode("gb18030"), b"", b"\x81")] == ["é", "中", "", "�"]
    assert [plain.looks_like_text(x) for x in (b"", b"ab\n", b"\xff\xfea\x00", b"a\x00" * 9, b"\x01" * 3 + b"a" * 97, b"\x01" * 6 + b"a" * 94)] == [False, True, True, False, True, False]
    assert parsers.parse("README", b"hello")[0][2] == "hello"
    with pytest.raises(ValueError):
        parsers.parse("a.exe", b"")


def test_sheets():
    ns = 'xmlns="m" xmlns:r="r"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" s="1"><v>45292.5</v></c><c r="E1" s="2"><v>0.25</v></c></row><row><c r="A2"><v>3.0</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="C2" t="e"><v>#DIV/0!</v></c><c r="D2" s="3"><v>2.50</v></c></row><row><c r="A3" t="s"/></row></sheetData></worksheet>'
    files = {
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet,
        "xl/sharedStrings.xml": f"<sst {ns}><si><r><t>sh</t></r><r><t>ared</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="[Red]0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="20"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    }
    assert parsers.parse("a.XLSX", _zipped(files)) == [(None, "One", "shared\t\tTrue\t2024-01-01 12:00:00\t06:00:00\n3\tin\t#DIV/0!\t2.5")]


def _slide(*texts):
    return "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r><a:br/></a:p>" for t in texts) + "</p:sld>"


def test_slides(monkeypatch):
    rels = "<Relationships><Relationship Id='a' Type='x/slide' Target='slides/slide2.xml'/><Relationship Id='b' Type='x/slide' Target='/ppt/slides/slide1.xml'/><Relationship Id='c' Type='x/slide' TargetMode='External' Target='http://x'/></Relationships>"
    show = "<p:presentation xmlns:p='p' xmlns:r='r'><p:sldIdLst><p:sldId r:id='a'/><p:sldId r:id='c'/></p:sldIdLst></p:presentation>"
    files = {"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide2.xml": _slide("two", " "), "ppt/slides/slide10.xml": _slide("ten"), "ppt/slides/slide1.xml": _slide("one")}
    assert parsers.parse("a.pptx", _zipped(files)) == [(1, "第 1 页", "two")]
    del files["ppt/presentation.xml"]
    assert [s[2] for s in parsers.parse("a.pptx", _zipped(files))] == ["one", "two", "ten"]
    monkeypatch.setattr(office, "MOST_SLIDE_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        parsers.parse("a.pptx", _zipped(files))
    with pytest.raises(ValueError):
        parsers.parse("a.pptx", b"no zip")


def _string(t):
    raw = t.encode("gb18030")
    return struct.pack("<I", len(raw)) + raw


def test_albums():
    number = lambda n: struct.pack("<I", n)
    tree = _string("stored") + number(7) + _string("图册") + number(1) + number(3) + _string("分类") + number(2) + number(1) + _string("图一") + _string("\\a\\b\\") + _string("x.gdb") + number(1) + _string("图二") + _string("") + _string("y.gdb")
    content = maps.ALBUM.ljust(maps.ALBUM_TREE, b"\x00") + tree
    got = parsers.parse("d/a.lst", content)
    assert got[0][2].split("\n")[3:] == ["图册名: 图册", "分类数: 1", "图件数: 2", "图册标志: 7"]
    assert got[1][1] == "GeoMap图册/分类/图一" and got[1][2].endswith("相对目录: a/b\nGeoMap 数据库文件: x.gdb\n完整相对路径: a/b/x.gdb")
    assert got[2][2].endswith("相对目录: .\nGeoMap 数据库文件: y.gdb\n完整相对路径: y.gdb")
    for bad in (content + b"x", content[:-2], content[: maps.ALBUM_TREE], content.replace(number(3) + _string("分类"), number(4) + _string("分类"))):
        with pytest.raises(ValueError):
            parsers.parse("a.lst", bad)
    assert parsers.parse("a.lst", b"plain list")[0][2] == "plain list"


def test_layer_styles():
    record = bytearray(maps.STYLE_RECORD)
    record[0:4], record[160:163] = "井位".encode("gb18030"), b"abc"
    head = maps.STYLE.ljust(maps.STYLE_COUNT, b"\x00")
    (got,) = parsers.parse("s.att", head + struct.pack("<I", 2) + bytes(record) + bytes(maps.STYLE_RECORD))
    assert got[1] == "GeoMap属性表/LayerStyle" and got[2].split("\n")[-2:] == ["1\t井位\t\tabc", "2\t图层_2"]
    for bad in (head + struct.pack("<I", 3) + bytes(record) * 2, head + struct.pack("<I", 0), head + struct.pack("<I", 0) + bytes(9)):
        with pytest.raises(ValueError):
            parsers.parse("s.att", bad)


def _layer(name, body, size=maps.LAYER_HEAD):
    raw = name.encode("gb18030")
    head = bytearray(maps.LAYER.ljust(size, b"\x00"))
    head[maps.LAYER_NAME_SIZE : maps.LAYER_NAME_SIZE + 4 + len(raw)] = struct.pack("<I", len(raw)) + raw
    return bytes(head) + body


def test_map_layers():
    body = b"\x01\x02" + maps.OBJECT_TEXT + _string("ab") + b"\x00" * 3 + _string("ab") + b"\xff" + _string("长庆油田") + _string("12.5|3") + _string("名 ?") + _string("well_7")
    content = maps.MAP.ljust(0x204, b"\x00") + "图名".encode("gb18030").ljust(0x100, b"\x00") + _layer("层一", body) + _layer(" ", b"")
    about, first, second = parsers.parse("m.gdb", content)
    assert "图名: 图名\n图层数: 2\n提取的文本或数值属性记录数: 4" in about[2]
    assert first[1] == "GeoMap属性表/001/层一" and first[2].split("\n")[3:] == ["属性记录数: 4", "记录号\t属性值", "1\tab", "2\t长庆油田", "3\t12.5|3", "4\twell_7"]
    assert second[1] == "GeoMap属性表/002/图层_2" and second[2].endswith("-\t本图层没有可直接提取的文本或数值属性")
    for bad in (maps.MAP, maps.MAP + _layer("x" * 300, b""), maps.MAP + maps.LAYER + bytes(50), maps.MAP + _layer("a", b"", 0x400) + _layer("b", b"")):
        with pytest.raises(ValueError):
            parsers.parse("m.gdb", bad)
    assert parsers.parse("m.gdb", b"\x00text here")[0][1] == "二进制内容"


def test_files_to_chunks(spark, tmp_path):
    ns = "xmlns:w='urn:w'"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ttab\n\n\n\nend " + "z" * 500)
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.docx").write_bytes(_zipped({"word/document.xml": f"<w:document {ns}><w:body><w:p><w:t>x</w:t></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:t>m</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}))
    (tmp_path / "e.json").write_text("{}")
    (tmp_path / "f.pptx").write_bytes(_zipped({"ppt/slides/slide1.xml": _slide("s1"), "ppt/slides/slide2.xml": _slide(), "ppt/slides/slide3.xml": _slide("s3")}))
    found = parsers.read_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in found.where("error is not null").collect()] == ["b.pdf"]
    joined = {r.path.rsplit("/", 1)[-1]: r.text for r in parsers.join_sources(found).collect()}
    assert joined == {"a.txt": "one tab\n\nend " + "z" * 500, "c.docx": "x\nm m", "e.json": "{}", "f.pptx": "s1\n\ns3"}
    chunks = metadata.chunks(parsers.join_sources(found), "path", F.col("text"))
    assert chunks.where("path like '%a.txt'").count() == 2


@pytest.mark.parametrize("raw, want", [("```SKIP", True), ("SKIP```", True), ("```SKIP```", False), ("```JSON\nSKIP\n```", False), ('{"decision":"RETRIEVE","decision":"skip"}', False), ('{"decision":"SKIP"} x', True), ('["SKIP"]', True), ('"SKIP"', True), (None, True), ("{'decision': 'SKIP'}", True), ('{"decision": null}', True), (' {"DECISION" : "skip" ', False)])
def test_decisions(spark, raw, want):
    assert intent.retrieves(raw) is want
    assert one(spark, intent.decision_retrieves(F.lit(raw).cast("string"))) is want


def test_exact_text_and_refusals(spark):
    made = one(spark, text.exact_metric_text(F.lit("ＡＢ ß_ﬁ")))
    assert made == "abssfi"
    assert one(spark, intent.is_refusal(F.lit("没有　找到＿相关，内容"), True)) and not one(spark, intent.is_refusal(F.lit("found it"), True))


def test_cosine_faults(spark):
    f = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    empty = F.array().cast("array<double>")
    assert one(spark, text.cosine(f(0, 0), f(1, 0))) is None and one(spark, text.cosine(f(1), f(1, 0))) is None and one(spark, text.cosine(empty, empty)) is None
    for a, b in ((f(0, 0), f(1, 0)), (f(1), f(1, 0)), (empty, empty)):
        with pytest.raises(Exception, match="vectors must"):
            one(spark, text.cosine(a, b, True))
    assert one(spark, text.semantic_score(F.lit(" "), F.lit("e"), f(1, 0), f(1, 0))) == 0.0
    assert one(spark, text.semantic_score(F.lit("a"), F.lit("e"), f(1, 0), f(-1, 0))) == 0.0
    with pytest.raises(Exception, match="blank"):
        one(spark, text.semantic_score(F.lit("a"), F.lit(""), f(1, 0), f(1, 0)))


def test_states(spark):
    events = [(1, "queued", 1), (1, "embedding", 2), (1, "failed", 3), (1, "ready", 4), (2, "embedding", 2), (2, "parsing", 3), (3, "saving", 1), (3, "ready", 2), (3, "failed", 3), (4, "failed", 1), (5, "odd", 1)]
    got = {r.k: (r.status, r.stage, r.progress) for r in ingest.states(spark.createDataFrame(events, "k int, s string, at int"), "k", "s", ["at"]).collect()}
    assert got == {1: ("failed", "failed", 35), 2: ("processing", "embedding", 35), 3: ("ready", "ready", 100), 4: ("failed", "failed", 0)}


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1), (2, "d", 1)], "id int, v string, at int").repartition(3)
    assert sorted(map(tuple, metadata.upsert(old, new, "id", "at").where("id = 1").collect())) == [(1, "b", 2)]
    assert sorted(map(tuple, metadata.upsert(old, new, "id").collect())) == [(1, "z", 1), (2, "d", 1)]


def test_insert_refuses_known_keys(spark):
    table = spark.createDataFrame([(1, "a")], "id int, v string")
    assert store.insert(table, spark.createDataFrame([(2, "b")], "id int, v string"), "id").count() == 2
    with pytest.raises(Exception, match="id exists: 1"):
        store.insert(table, spark.createDataFrame([(1, "b")], "id int, v string"), "id").collect()
    rows = spark.createDataFrame([("k", 1)], "kb string, x int")
    tenants = spark.createDataFrame([("k", "m")], "kb string, embedding_model string")
    assert store.same_model(rows, tenants, "m").count() == 1
    with pytest.raises(Exception, match="another embedding model"):
        store.same_model(rows, tenants, "n").collect()


def test_samples(spark, tmp_path):
    write = lambda *lines: (tmp_path / "s.jsonl").write_text("\n".join(lines), encoding="utf-8-sig")
    write('{"question_id": 1, "question": "q", "keywords": ["k"], "should_refuse": true}', "", '{"question_id": "2", "question": "q", "status": "draft"}', '{"question_id": "3", "question": "q", "status": "approved"}')
    samples = evaluation.read_samples(spark, str(tmp_path))
    assert {(r.question_id, r.should_refuse) for r in samples.collect()} == {("1", True), ("3", False)}
    assert evaluation.read_samples(spark, str(tmp_path), True).count() == 3
    assert [r[0] for r in evaluation.select_samples(samples, [" 3 ", "3"]).select("question_id").collect()] == ["3"]
    with pytest.raises(ValueError, match="7, 9"):
        evaluation.select_samples(samples, ["9", "7", "1"])
    for bad, why in (('{"question_id": 1}', "line 2 has no"), ("{", "line 2 is not JSON")):
        write('{"question_id": 1, "question": "q"}', bad)
        with pytest.raises(ValueError, match=why):
            evaluation.read_samples(spark, str(tmp_path))
    write('{"question_id": 1, "question": "q", "status": "draft"}')
    with pytest.raises(ValueError, match="no samples"):
        evaluation.read_samples(spark, str(tmp_path))


def test_results_and_report(spark, tmp_path):
    samples = spark.createDataFrame([("1", "q", None, None, "中文 answer", ["d1"], ["c1"], ["answer", " "], False, None), ("2", "q", None, None, None, [], None, [], True, None), ("3", "q", None, None, "e", ["x"], [], [], False, None), ("4", "q", None, None, "e", [], [], [], False, None)], evaluation.SAMPLE)
    cited = [("d1", "c9")]
    responses = spark.createDataFrame([("1", "Answer 中文", cited, [], ["c1", None], True, 1, 80.0, None), ("2", "未找到相关内容", [], [], [], False, 0, None, None), ("3", "e", None, ["y"], None, True, 1, 99.0, None)], evaluation.RESPONSE)
    results = evaluation.score_responses(samples, responses)
    got = {r.question_id: r for r in results.collect()}
    assert (got["1"].passed, got["1"].document_hit, got["1"].chunk_hit, got["1"].answer_char_f1, got["1"].keyword_recall) == (True, True, True, 1.0, 1.0)
    assert (got["2"].passed, got["2"].document_hit, got["2"].answer_score_passed, got["2"].refusal_correct) == (True, None, None, True)
    assert (got["3"].passed, got["3"].document_hit, got["4"].error, got["4"].passed) == (False, False, "no response", False)
    assert evaluation.score_responses(samples, responses, check_ids=False).where("question_id = '3'").first().passed
    assert evaluation.write_report(results, str(tmp_path / "r"), 0.5, model="m") == 2
    told = json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "r" / "summary"), wholetext=True).collect()))
    assert told["model"] == "m" and told["summary"]["passed_count"] == 2 and told["summary"]["pass_rate"] == 0.6667
    assert [evaluation.gate({"error_count": e, "pass_rate": p}, 0.5) for e, p in ((1, 1.0), (0, 0.4), (0, None), (0, 0.5))] == [2, 1, 1, 0]


def test_remote_gateway():
    asked, waits = [], []

    def post(url, key, payload):
        asked.append((url.rsplit("/", 1)[-1], payload))
        n = len(asked)
        if n == 1:
            return 429, {"Retry-After": "99"}, b""
        if n == 2:
            return 503, {}, b""
        if "response_format" in payload:
            return 400, {}, b"no schema"
        if url.endswith("completions"):
            return 200, {}, json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode()
        return 200, {}, json.dumps({"data": [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(payload["input"])))]}).encode()

    made = gateway.RemoteGateway("http://x/", "k", "chat", "emb", post=post, wait=waits.append)
    assert made.complete([{"role": "user", "content": "q"}], schema={"a": 1}, temperature=0) == "hi"
    assert waits == [8.0, 2.0] and [p.get("response_format") is None for _, p in asked] == [False, False, False, True]
    assert made.embed([str(i) for i in range(40)]) == [[float(i)] for i in range(32)] + [[float(i)] for i in range(8)]
    for data in ([{"index": 0, "embedding": []}], [{"index": 0, "embedding": []}, {"index": 0, "embedding": []}]):
        with pytest.raises(ValueError):
            gateway.in_order(data, 2)
    failing = gateway.RemoteGateway("u", "k", "c", "e", post=lambda *a: (500, {}, b"down"), wait=waits.append)
    with pytest.raises(RuntimeError, match="500 down"):
        failing.embed(["a"])
    assert waits[2:] == [1.0, 2.0, 4.0]
    assert isinstance(gateway.gateway({}), gateway.HashingGateway)
    with pytest.raises(ValueError, match="key, chat_model"):
        gateway.gateway({"provider": "remote", "url": "u", "embedding_model": "e"})
    assert set(gateway.probe({"a": lambda: 1, "b": lambda: 1 / 0, "c": lambda: [][1]})) == {"b", "c"}


def test_embedded_rows(spark):
    df = spark.createDataFrame([(1, "a b a", "old"), (2, None, "old")], "id int, t string, embedding string")
    got = {r.id: r.embedding for r in gateway.embed(df, gateway.HashingGateway(), "t").collect()}
    assert sum(v * v for v in got[1]) == pytest.approx(1) and got[2] == [0.0] * 16


def test_citations(spark):
    rows = [("d1", "c1", "t", 1, 0.5, None), ("d1", "c2", "t", 1, 0.4, None), (None, "c3", "t2", None, 0.3, None), ("", "", "", None, None, None), (None, "c4", None, None, None, None)]
    df = spark.createDataFrame([(rows, [(None, None, "", None, None, None), (None, "k", "", None, None, None)])], f"hits {answers.CITATIONS}, files {answers.CITATIONS}")
    every = answers.all_citations(F.col("hits"), answers.attachment_citations(F.lit(2), F.lit("f.txt"), F.col("files")))
    got = df.select(answers.citations_of(answers.citations_json(every)).alias("c")).first().c
    assert [(c.chunk_id, c.temporary) for c in got] == [("c1", None), ("c3", None), ("c4", None), ("attachment:2:0", True)]
    assert one(spark, answers.citations_json(F.lit(None).cast(answers.CITATIONS))) == "[]"
    assert one(spark, answers.citations_of(F.lit(None).cast("string"))) == []


def test_formulas(spark):
    cases = {r"a \( x \) b": "a $x$ b", r"\[ y" + "\n\\]": "\n$$\ny\n$$\n", r"`\(x\)` \(z\)": r"`\(x\)` $z$", r"(\alpha+1) and (plain)": r"$\alpha+1$ and (plain)", "~~~\n(\\pi)\n~~~": "~~~\n(\\pi)\n~~~", "": ""}
    for raw, want in cases.items():
        assert one(spark, text.dollar_formulas(F.lit(raw))) == want


def test_exported_samples(spark):
    asked = []

    def post(answer, status=200):
        def run(url, key, payload):
            asked.append((url, payload))
            return status, {}, json.dumps(answer).encode()

        return run

    two = {"data": {"samples": [{"question_id": 1, "question": "a", "keywords": ["k", 2]}, {"question_id": "x", "question": "b", "status": "draft"}], "metadata": {"v": 3}}}
    samples, about = evaluation.export_samples(spark, "http://h/", every=True, post=post(two))
    assert [(r.question_id, r.keywords, r.status) for r in samples.orderBy("question_id").collect()] == [("1", ["k", "2"], None), ("x", [], "draft")]
    assert about == {"v": 3}
    samples, _ = evaluation.export_samples(spark, "http://h", [" x ", "x", ""], post=post(two))
    assert [r.question_id for r in samples.collect()] == ["x"]
    scope = [("http://h/api/datasets/export", {"format": "jsonl", "scope": "all"}), ("http://h/api/datasets/export", {"format": "jsonl", "scope": "selected", "questionIds": ["x"]})]
    assert asked == scope
    for answer, status, why in (({}, 200, "no samples"), ({"data": {"samples": []}}, 200, "no samples"), ({"data": {"samples": [{"question": "a"}]}}, 200, "sample 1"), ({"data": {"samples": [3]}}, 200, "sample 1"), ({}, 503, "503")):
        with pytest.raises(ValueError, match=why):
            evaluation.export_samples(spark, "http://h", post=post(answer, status))
    with pytest.raises(ValueError, match="y"):
        evaluation.export_samples(spark, "http://h", ["y"], post=post(two))


def test_objects(spark, tmp_path):
    own = objects.Objects(spark, f"file://{tmp_path}")
    big = bytes(range(256)) * 10_000
    assert own.put("a/b.bin", io.BytesIO(big)) == len(big)
    assert own.put("empty", b"") == 0
    with own.fetch("a/b.bin") as f:
        assert f.read() == big
    assert own.digest("a/b.bin") == hashlib.sha256(big).hexdigest()
    assert own.digest("empty") == hashlib.sha256(b"").hexdigest()
    own.put("a/b.bin", b"new")
    assert b"".join(own.pieces("a/b.bin")) == b"new"
    own.delete("a/b.bin")
    own.delete("a/b.bin")
    assert not own.exists("a/b.bin")
    with pytest.raises(FileNotFoundError):
        own.fetch("a/b.bin")
    for name in ("", "/a", "a/../b"):
        with pytest.raises(ValueError):
            own.put(name, b"")


def test_collections(spark, tmp_path):
    own = objects.Objects(spark, f"file://{tmp_path}")
    made = {"size": 2, "metric": "cosine", "index": {"cells": 16}}
    assert objects.ensure_collection(own, "c", 2, cells=16) == made
    assert objects.ensure_collection(own, "c", 2) == made
    assert objects.ensure_collection(own, "c", 2, probes=4)["index"] == {"cells": 16, "probes": 4}
    with pytest.raises(ValueError, match="not 3"):
        objects.ensure_collection(own, "c", 3)
    with pytest.raises(ValueError):
        objects.ensure_collection(own, "d", 0)
    points = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<double>")
    assert objects.of_size(points.limit(1), 2).count() == 1
    for bad in ("size(embedding) = 1", "embedding is null"):
        with pytest.raises(Exception, match="vectors of 2"):
            objects.of_size(points.where(bad), 2).collect()
