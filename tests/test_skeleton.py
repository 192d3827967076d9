"""New texts in the form of a skeleton file."""

import io
import zipfile

from pyspark.sql import functions as F

from tidemark.functions.vocab import FINDINGS, SECTIONS
from tidemark.sources import docx, skeleton

HEADS = {k: h for h, k in reversed(SECTIONS)}
A, B, LAST, ABSTRACT = SECTIONS[0][1], SECTIONS[1][1], SECTIONS[3][1], SECTIONS[4][1]


def made(lines):
    to = io.BytesIO()
    docx.write(to, lines)
    return to.getvalue()


def plan():
    return made([("הנדון: אבחון", False), ("תאריך: x", False), (f"{HEADS[A]}:", True), ("old one", False), ("old two", False), (HEADS[FINDINGS], True), (HEADS[ABSTRACT], True), ("short", False), (HEADS[LAST], True), ("old end", False), ("בברכה", False), ("name", False)])


def test_bodies_are_replaced_up_to_the_signature():
    out, missing = skeleton.filled(plan(), {A: " new\n\n lines \x00", B: "nowhere", LAST: ""}, {"zz": "last", "שטף": "b", "הבנת שפה": "a\nc", "empty": " "}, titles={A: "רקע חדש"}, drop=[ABSTRACT], preamble=[("תאריך", "תאריך: 1/2/2025")])
    assert missing == [B]
    assert docx.parse(out)[0] == ["הנדון: אבחון", "תאריך: 1/2/2025", "רקע חדש", "new", "lines", HEADS[FINDINGS], "הבנת שפה – ", "a", "c", "שטף – ", "b", "zz – ", "last", HEADS[LAST], "בברכה", "name"]
    document = zipfile.ZipFile(io.BytesIO(out)).read("word/document.xml").decode()
    assert document.count("Heading1") >= 3
    same, none = skeleton.filled(plan(), {}, {})
    assert docx.parse(same) == docx.parse(plan()) and none == []


def test_forms_are_taken_from_the_body_or_the_heading_without_bold():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    bold = "<w:rPr><w:b/><w:sz w:val='30'/></w:rPr>"
    xml = f"<w:document {w}><w:body><w:p><w:pPr><w:jc w:val='right'/></w:pPr><w:r>{bold}<w:t>{HEADS[A]}</w:t></w:r></w:p><w:tbl/><w:p><w:r>{bold}<w:t>{HEADS[LAST]}</w:t></w:r></w:p><w:p><w:pPr><w:jc w:val='left'/></w:pPr><w:r><w:rPr><w:i/></w:rPr><w:t>x</w:t></w:r></w:p><w:sectPr/></w:body></w:document>"
    out = skeleton.rewritten(xml.encode(), {A: "one", LAST: "two"}, {})[0].decode()
    new = lambda text: out[: out.index(f">{text}<")].rsplit("<ns0:p>", 1)[-1] if "<ns0:p>" in out else out[: out.index(f">{text}<")].rsplit("<w:p>", 1)[-1]
    assert "right" in new("one") and ":b " not in new("one").replace("/>", " ") and "30" in new("one") and "left" in new("two") and ":i" in new("two")
    assert out.index("tbl") < out.index(HEADS[LAST]) and "sectPr" in out


def test_files_count_once_the_manifest_names_them(spark, tmp_path):
    rows = [(1, "a.docx", plan(), {A: "x"}, {}), (2, "a.docx", plan(), {A: "y"}, None), (2, "a.docx", plan(), {A: "y"}, {}), (3, "bad.docx", b"no zip", {}, {}), (None, "n.docx", plan(), None, {"שטף": "z"})]
    df = spark.createDataFrame(rows, "doc_id long, name string, skeleton binary, sections map<string,string>, domains map<string,string>")
    root = f"file://{tmp_path}/out"
    manifest = skeleton.write(df, root)
    assert {(r["doc_id"], r["error"]) for r in manifest.collect()} == {(1, None), (2, None), (3, "BadZipFile"), (None, None)}
    (tmp_path / "out" / "lost").mkdir()
    (tmp_path / "out" / "lost" / "a.docx").write_bytes(plan())  # what an attempt that died has left
    back = skeleton.read(manifest, root)
    got = sorted(((r["doc_id"], r["line"]) for r in back.select("doc_id", F.posexplode("paragraphs").alias("ord", "line")).filter("ord = 3").collect()), key=str)
    assert got == [(1, "x"), (2, "y"), (2, "y"), (None, "old one")]
    assert skeleton.write(df.limit(0), root).count() == 0
    assert {r["hash"] for r in back.collect()} == {r["hash"] for r in manifest.filter("error is null").collect()}


def test_files_are_read_as_the_manifest_names_them_and_never_listed(spark, tmp_path, monkeypatch):
    rows = [(i, f"s {i % 20}%.docx", plan(), {A: f"x{i}"}, {}) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, name string, skeleton binary, sections map<string,string>, domains map<string,string>").coalesce(1)
    root = f"file://{tmp_path}/out"
    manifest = skeleton.write(df, root)
    assert len(list((tmp_path / "out").iterdir())) == 2  # ten names come twice
    named = {r["doc_id"]: r["path"] for r in manifest.collect()}
    open(named[3].removeprefix("file://"), "wb").close()
    listed = lambda *_: 1 / 0
    monkeypatch.setattr(docx, "listing", listed)
    monkeypatch.setattr(docx, "files", listed)
    gone = manifest.unionByName(manifest.filter("doc_id = 5").selectExpr("null doc_id", "concat(path, 'x') path", "hash", "missing", "error"))
    for most in (1, 1 << 22):
        back = skeleton.read(gone, root, most)
        assert back.columns == ["path", "folder", "hash", "paragraphs", "cells", "error", "doc_id"]
        got = {r["doc_id"]: (r["path"], r["error"], r["paragraphs"] and r["paragraphs"][3], r["folder"]) for r in back.collect()}
        assert got.pop(None)[1:3] == ("FileNotFoundError", None) and got.pop(3)[1:3] == ("BadZipFile", None)
        assert got == {i: (path, None, f"x{i}", path.split("/")[-2]) for i, path in named.items() if i != 3}
