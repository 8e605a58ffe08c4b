import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.packages import ABCD, INVOICE, main, package, para, run
from vellumite import errors as E
from vellumite.facade import Document
from vellumite.functions.text import expand_visible_text, normalized, parse_markers
from vellumite.models import BATCH_SCHEMA, EditOperation, operations_from_json, validate_batch
from vellumite.operators.inline import Paragraph, apply_text_op, raw_paragraphs
from vellumite.sources.content import ContentResolverConfig, json_path, resolve
from vellumite.models import ContentItem, content_ref
from vellumite.sources.docx import scan_xml


@pytest.fixture
def opened(tmp_path):
    def make(body, name="x.docx"):
        package(body, tmp_path / name)
        return Document.open(tmp_path / name)

    return make


def texts(doc):
    return [r.text for r in doc._state.rows]


def test_reads(opened):
    doc = opened(para("First paragraph.") + para("A heading.", "Heading1") + para("Third paragraph."))
    assert doc.get_visible_text() == "First paragraph.\nA heading.\nThird paragraph."
    assert doc.paragraph_count() == 3
    page = doc.list_paragraphs(2, 1, max_chars=4)
    assert [p.text for p in page.paragraphs] == ["A he"] and page.pagination.total == 3
    assert doc.count_matches("paragraph") == 2
    assert doc.find_text("nothing") is None
    with pytest.raises(E.AmbiguousTextMatchError):
        doc.find_text("paragraph")
    assert len(doc.find_text("paragraph", occurrence=-1)) == 2
    with pytest.raises(E.TextNotFoundError):
        doc.find_text("paragraph", occurrence=2)
    with pytest.raises(E.ParagraphNotFoundError):
        doc.get_paragraph("p_000009")
    with pytest.raises(E.InvalidPatternError):
        doc.grep_paragraphs("(", regex=True)
    with pytest.raises(ValueError):
        doc.list_paragraphs(0)


def test_structured_blocks_count_but_do_not_show(opened):
    doc = opened(para("A") + f"<w:sdt><w:sdtContent>{para('B')}</w:sdtContent></w:sdt>" + para("C"))
    assert texts(doc) == ["A", "C"]
    assert [p.location.global_ordinal for p in doc.list_paragraphs().paragraphs] == [1, 3]


def test_table_places():
    rows = {r["text"]: r["table_context"] for r in scan_xml(main(INVOICE).encode())}
    names = ("table_index", "row_index", "physical_cell_index", "logical_column_index", "grid_span", "grid_before", "vertical_merge", "nesting_depth", "paragraph_index_in_cell")
    assert {t: tuple(c[k] for k in names) for t, c in rows.items() if c} == {
        "number": (0, 0, 0, 0, 1, 0, "none", 0, 0),
        "date": (0, 0, 0, 0, 1, 0, "none", 0, 1),
        "item": (0, 0, 1, 1, 3, 0, "restart", 0, 0),
        "sum": (0, 0, 2, 4, 1, 0, "none", 0, 0),
        "seven": (0, 1, 0, 2, 1, 2, "none", 0, 0),
        "screws": (0, 1, 1, 3, 1, 2, "continue", 0, 0),
        "left": (0, 2, 0, 0, 1, 0, "none", 0, 0),
        "deepest": (2, 0, 0, 0, 1, 0, "none", 2, 0),
        "beside": (2, 0, 1, 1, 1, 0, "none", 2, 0),
        "middle": (1, 0, 1, 1, 1, 0, "none", 1, 0),
        "below": (0, 2, 0, 0, 1, 0, "none", 0, 1),
        "second table": (3, 0, 0, 0, 1, 0, "none", 0, 0),
    }
    assert rows["thanks"] is None


def test_projections():
    xml = main("<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr>" + run("Left") + "<w:r><w:tab/><w:t>Middle</w:t><w:br/><w:t>[[DOCX:</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins>" + run("new") + "</w:ins></w:p>")
    r = scan_xml(xml.encode())[0]
    assert r["text"] == "Left\tMiddle\n[[DOCX:new"
    assert r["marked_text"] == "Left[[DOCX:TAB]]Middle[[DOCX:LINE_BREAK]]\\[[DOCX:new"
    assert r["protected"] == ["revision_ins", "revision_del"]
    assert r["segments"][-1]["structures"] == ["w:ins"]


@pytest.mark.parametrize("bad", [b"no zip", "<w:p>", '<!DOCTYPE x [<!ENTITY a "b">]>'])
def test_invalid_packages(tmp_path, bad):
    path = tmp_path / "bad.docx"
    if isinstance(bad, bytes):
        path.write_bytes(bad)
    elif bad.startswith("<!"):
        package("", path, declaration=bad)
    else:
        package(bad, path)
    with pytest.raises(E.InvalidDocumentError):
        Document.open(path)
    with pytest.raises(E.DocumentNotFoundError):
        Document.open(tmp_path / "none.docx")


OPS = EditOperation


@pytest.mark.parametrize(
    "ops,blame",
    [
        ([OPS.replace_para("p_000001", ["X"]), OPS.replace_para("p_000001", ["Y"])], 1),
        ([OPS.replace_para("p_000001", ["X"]), OPS.delete_para("p_000001")], 1),
        ([OPS.insert_para_after("p_000001", ["X"]), OPS.delete_para("p_000001")], 0),
        ([OPS.insert_para_after("p_000001", ["X"]), OPS.delete_para("p_000009")], 1),
        ([OPS.insert_para_after("p_000001", ["X"]), OPS.replace_text("p_000002", "zzz", "y")], 1),
        ([OPS.delete_para(["p_000001", "p_000002"]), OPS.insert_para_before("p_000002", ["X"])], 1),
    ],
)
def test_refused_batches(opened, ops, blame):
    doc = opened(ABCD)
    with pytest.raises(E.BatchOperationError) as e:
        doc.batch_edit(ops)
    assert e.value.operation_index == blame
    assert texts(doc) == ["A", "B", "C", "D"]
    assert [x["status"] for x in doc.change_log()] == ["failed"]


@pytest.mark.parametrize(
    "ops,expected",
    [
        ([OPS.insert_para_before("p_000001", ["Z1", "Z2"]), OPS.delete_para("p_000001")], "Z1 Z2 B C D"),
        ([OPS.insert_para_after("p_000001", ["Y"]), OPS.replace_para("p_000001", ["X"])], "X Y B C D"),
        ([OPS.insert_para_after("p_000001", ["X", "Y"]), OPS.insert_para_after("p_000001", ["Z"])], "A X Y Z B C D"),
        ([OPS.insert_para_before("p_000004", ["X"]), OPS.insert_para_before("p_000004", ["Y\n\nZ"])], "A B C X Y Z D"),
        ([OPS.replace_text("p_000002", "B", "b"), OPS.replace_text("p_000002", "b", "bb")], "A bb C D"),
    ],
)
def test_batches(opened, ops, expected):
    doc = opened(ABCD)
    doc.batch_edit(ops)
    assert " ".join(texts(doc)) == expected
    doc.save()
    assert " ".join(texts(Document.open(doc.source_path))) == expected


def test_style_donors(opened):
    doc = opened('<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' + run("Bold", "<w:rPr><w:b/></w:rPr>") + "</w:p>" + para("plain"))
    made = doc.insert_para_after("p_000001", ["x"])[0]
    assert "Heading1" in made.read(raw=True) and "<w:b/>" in made.read(raw=True)
    before = doc.insert_para_before("p_000002", ["y"])[0]
    assert "Heading1" in before.read(raw=True)


def test_text_edits_keep_structure(opened):
    body = f'<w:p>{run("left")}<w:r><w:tab/></w:r>{run("right", "<w:rPr><w:b/></w:rPr>")}</w:p><w:p><w:hyperlink>{run("link")}</w:hyperlink>{run(" tail")}</w:p>'
    doc = opened(body)
    p = doc.get_paragraph_object("p_000001")
    p.replace_text("left", "LEFT")
    assert p.read() == "LEFT\tright"
    p.insert_text_after("LEFT", "[[DOCX:TAB]]")
    assert p.read() == "LEFT\t\tright"
    p.insert_text_before("right", "a\nb ")
    assert p.read() == "LEFT\t\ta\nb right" and p.read(raw=True).count("<w:b/>") == 2
    p.delete_text("gh")
    assert p.read() == "LEFT\t\ta\nb rit"
    with pytest.raises(E.InvalidContentError):
        p.replace_text("LEFT", "[[DOCX:FOO]]")
    with pytest.raises(E.UnsupportedStructureError):
        p.replace_text({"pattern": r"T\[\[", "regex": True}, "x")
    with pytest.raises(E.UnsupportedStructureError) as e:
        doc.get_paragraph_object("p_000002").replace_text("link tail", "x")
    assert e.value.structures == ("w:hyperlink",)
    assert doc.replace_all("LEFT", "left") == 1


def test_replace_across_runs():
    p = Paragraph(f'<w:p xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{run("ab")}{run("cd", "<w:rPr><w:i/></w:rPr>")}{run("ef")}</w:p>')
    apply_text_op(p, "replace_text", "bcde", False, "X", None)
    assert p.marked_text() == "aXf" and p.xml().count("<w:r>") == 3 and "<w:i/>" not in p.xml()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab c", min_size=1, max_size=4), min_size=1, max_size=5), st.data())
def test_edits_match_a_plain_string(parts, data):
    whole = "".join(parts)
    runs = "".join(f'<w:r><w:t xml:space="preserve">{x}</w:t></w:r>' for x in parts)
    p = Paragraph(f'<w:p xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{runs}</w:p>')
    a = data.draw(st.integers(0, len(whole) - 1))
    b = data.draw(st.integers(a + 1, len(whole)))
    op = data.draw(st.sampled_from(["replace_text", "delete_text", "insert_text_before", "insert_text_after"]))
    content = "" if op == "delete_text" else "XY"
    p.edit(op, a, b, content)
    expected = {"replace_text": whole[:a] + content + whole[b:], "delete_text": whole[:a] + whole[b:], "insert_text_before": whole[:a] + content + whole[a:], "insert_text_after": whole[:b] + content + whole[b:]}[op]
    assert p.marked_text() == expected


def test_save_round_trip(opened, tmp_path):
    doc = opened(INVOICE + '<w:p><w:r><w:t xml:space="preserve">é &amp; x</w:t></w:r></w:p>')
    before = doc._main
    doc.insert_para_after("p_000002", ["in the cell"])
    done = doc.save()
    assert done.backup_path and zipfile.is_zipfile(done.backup_path)
    with zipfile.ZipFile(doc.source_path) as z:
        main_xml = z.read("word/document.xml")
        assert z.namelist() == ["[Content_Types].xml", "_rels/.rels", "word/document.xml"]
    body = main_xml.split(b"?>\n", 1)[1]
    cut = body.index(b"in the cell")
    start, end = body.rindex(b"<w:p", 0, cut), body.index(b"</w:p>", cut) + 6
    assert body[:start] + body[end:] == before
    again = Document.open(doc.source_path)
    context = again.list_paragraphs().paragraphs[2].location.table_context
    assert (context.table_index, context.paragraph_index_in_cell) == (0, 2)
    doc.source_path.write_bytes(doc.source_path.read_bytes() + b" ")
    with pytest.raises(E.SourceChangedError):
        doc.save()


def test_sections_and_copies(opened):
    doc = opened(para("T", "Heading1") + para("a") + para("S", "heading2") + para("b") + para("U", "Heading1") + para("c"))
    found = doc.list_sections()
    assert [(s.heading_text, len(s.body_ids)) for s in found] == [("T", 3), ("S", 1), ("U", 1)]
    assert doc.get_section("p_000003").body_ids == ("p_000004",)
    with pytest.raises(ValueError):
        doc.get_section("p_000002")
    other = opened(ABCD, "y.docx")
    made = doc.insert_para_after("p_000006", doc.copy_paragraphs_from(other, "p_000002", "p_000003"), raw=True)
    assert [p.read() for p in made] == ["B", "C"]
    with pytest.raises(ValueError):
        doc.copy_paragraphs_from(other, "p_000003", "p_000002")
    with pytest.raises(E.InvalidContentError):
        raw_paragraphs("<w:tbl/>")


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("三十日,共60天", "三十日，共 60 天"),
        ("hello, world.", "hello, world."),
        ("请看 https://example.com/a?x=1&y=2 网页", "请看 https://example.com/a?x=1&y=2 网页"),
        ("联系 admin@example.com 邮箱", "联系 admin@example.com 邮箱"),
        ("调用 `run(a, b)` 方法", "调用 `run(a, b)` 方法"),
        ("  中文,共60天  ", "  中文，共 60 天  "),
        ("好的.再见", "好的。再见"),
        ("pi = 3.14 大约", "pi = 3.14 大约"),
        ("Mr. Smith 到访", "Mr. Smith 到访"),
        ("你好   ABC 世界", "你好 ABC 世界"),
        ("附件(见后);共2页", "附件（见后）；共 2 页"),
    ],
)
def test_normalize(raw, expected):
    assert normalized(raw) == expected


def test_text_functions():
    assert expand_visible_text("a\r\nb\nc\n\nd\n\n\ne") == ["a\nb\nc", "d", "e"]
    assert parse_markers("a[[DOCX:TAB]]\\[[DOCX:b") == [("text", "a"), ("marker", "TAB"), ("text", "[[DOCX:b")]
    with pytest.raises(E.InvalidContentError):
        parse_markers("[[DOCX:TAB")


def test_batch_json():
    good = {"operations": [{"op_id": "1", "op": "replace_text", "target_id": "p_000001", "find": {"pattern": "a"}, "content_literal": "b"}, {"op_id": "2", "op": "delete_para", "target_ids": ["p_000002"]}]}
    assert [o.op for o in operations_from_json(good)] == ["replace_text", "delete_para"]
    assert BATCH_SCHEMA["additionalProperties"] is False
    for bad in ({}, {"operations": []}, {"operations": [{"op": "x"}]}, {"operations": [good["operations"][0] | {"raw": True}]}, {"operations": [good["operations"][0] | {"content_ref": {"type": "file", "path": "x"}}]}, {"operations": [good["operations"][1] | {"target_ids": ["a", "a"]}]}, {"operations": [good["operations"][0] | {"occurrence": -2}]}):
        with pytest.raises(E.ValidationError):
            validate_batch(bad)


def test_content_sources(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": [1, true, null, {"k": "x", "v": "y"}]}}')
    (tmp_path / "t.txt").write_bytes("é".encode("latin-1"))
    inside = tmp_path / "in"
    inside.mkdir()
    (inside / "ok.txt").write_text("ok")
    (inside / "link.txt").symlink_to(tmp_path / "t.txt")
    narrow = ContentResolverConfig(workspace=tmp_path, input_roots=(inside,))
    assert resolve([ContentItem.of({"type": "file", "path": "in/ok.txt"})], narrow) == ["ok"]
    for path in ("t.txt", "in/link.txt", "in/../t.txt", str(tmp_path / "t.txt")):  # the workspace itself is no input root
        with pytest.raises(E.InvalidContentError):
            resolve([ContentItem.of({"type": "file", "path": path})], narrow)
    config = ContentResolverConfig(workspace=tmp_path, input_roots=(tmp_path,), allow_commands=True)
    items = [ContentItem("x"), {"type": "jsonpath", "source": "a.json", "path": "$.a.b[1]"}, {"type": "jsonpath", "source": "a.json", "path": "$.a.b[?(@.k=='x')].v"}, {"type": "file", "path": "t.txt", "encoding": "latin-1"}, {"type": "command", "argv": ["printf", "hi\\n\\n"]}]
    assert resolve([ContentItem.of(x) for x in items], config) == ["x", "true", "y", "é", "hi\n"]
    bad = [{"type": "jsonpath", "source": "a.json", "path": "$.a"}, {"type": "jsonpath", "source": "a.json", "path": "$.a.b[2]"}, {"type": "jsonpath", "source": "a.json", "path": "$.a.b[*]"}, {"type": "file", "path": "../../etc/passwd"}, {"type": "command", "argv": ["false"]}, {"type": "command", "argv": ["sleep", "5"], "timeout_seconds": 0.1}]
    for x in bad:
        with pytest.raises(E.InvalidContentError):
            resolve([ContentItem(content_ref=content_ref(x))], config)
    assert json_path({"a": {"k": 1}, "b": [{"k": 2}]}, "$..k") == [1, 2]


@pytest.mark.parametrize(
    "path,expected",
    [
        ("$.s[0].n", ["ant"]),
        ("$.s[-1].n", ["bee"]),
        ("$.s[0:2].w", [3, 5]),
        ("$.s[::2].n", ["ant", "bee"]),
        ("$.s[1:].n", ["asp", "bee"]),
        ("$.s[0,2].n", ["ant", "bee"]),
        ("$.s[0]['n','w']", ["ant", 3]),
        ("$.s[0].n,w", ["ant", 3]),
        ("$.s[*].w", [3, 5, 4]),
        ("$..n", ["ant", "asp", "bee"]),
        ("$.s[?(@.w > 3)].n", ["asp", "bee"]),
        ("$.s[?(@.w >= 4 & @.n =~ '^a')].n", ["asp"]),
        ("$.s[?(@.n != 'ant')].w", [5, 4]),
        ("$.s[?(@.x)].n", ["bee"]),
        ("$.s[?(@.x.y == true)].n", ["bee"]),
        ("$..y.`parent`.`parent`.n", ["bee"]),
        ("$.s.`len`", [3]),
        ("$['s'][1][\"n\"]", ["asp"]),
        ("$.none", []),
        ("$.s[9]", []),
    ],
)
def test_json_paths(path, expected):
    data = {"s": [{"n": "ant", "w": 3}, {"n": "asp", "w": 5}, {"n": "bee", "w": 4, "x": {"y": True}}]}
    assert json_path(data, path) == expected


def test_json_paths_that_are_none():
    for path in ("s", "$.s[", "$.s[a]", "$s s", "$.s[?(w > 3)]", "$."):
        with pytest.raises(E.InvalidContentError):
            json_path({"s": [{"w": 1}]}, path)


def test_errors_as_values():
    import pickle

    e = E.BatchOperationError(operation_index=1, op_id="x", reason="r", rolled_back=True)
    assert pickle.loads(pickle.dumps(e)).to_dict() == e.to_dict() == {"code": "batch_operation_error", "operation_index": 1, "op_id": "x", "reason": "r", "rolled_back": True}
