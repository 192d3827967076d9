"""Word files as a data source, read and written."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import docx, word_source

MADE = "name string, paragraphs array<string>, headings array<int>"


@pytest.fixture(scope="module")
def words(spark):
    return word_source.register(spark)


def test_reads_what_the_binary_source_reads(words, tmp_path):
    for i in range(7):
        folder = tmp_path / "in" / f"f{i % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        docx.write(str(folder / f"a{i}.docx"), [(f"head {i}", True), (f"line\t{i}", False), ("", False)])
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "in" / "_draft").mkdir()
    (tmp_path / "in" / "_draft" / "x.docx").write_bytes(b"hidden")
    root = f"file://{tmp_path}/in"
    read = words.read.format("docx").option("partitionBytes", 3 << 20).load(root)
    assert read.rdd.getNumPartitions() > 2
    ours = sorted((r["folder"], r["hash"], tuple(r["paragraphs"] or ()), r["error"]) for r in read.collect())
    theirs = sorted((r["folder"], r["hash"], tuple(r["paragraphs"] or ()), r["error"]) for r in docx.documents(docx.files(words, [root])).filter("path not like '%/_draft/%'").collect())
    assert ours == theirs and len(ours) == 8 and [e for *_, e in ours if e] == ["BadZipFile"]
    assert words.read.format("docx").option("prefix", "a3").load(root).select("folder").collect()[0][0] == "f1"
    assert words.read.format("docx").option("recursive", "false").load(root).count() == 1


def test_a_schema_names_the_columns_that_are_made(words, tmp_path):
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    one = words.read.format("docx").schema("length long, path string").load(str(tmp_path)).collect()
    assert [(r["length"], r["path"].rsplit("/", 1)[1]) for r in one] == [(6, "bad.docx")]
    reader = word_source.WordReader(["path", "length"], {"path": str(tmp_path)})
    (tmp_path / "bad.docx").unlink()
    gone = word_source.Files([(str(tmp_path / "bad.docx"), 6)])
    assert next(reader.read(gone)).num_rows == 1  # listed alone: it is not opened
    with pytest.raises(FileNotFoundError):
        next(word_source.WordReader(["hash"], {"path": str(tmp_path)}).read(gone))
    assert words.read.format("docx").load(str(tmp_path)).count() == 0
    assert words.read.format("docx").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="has no"):
        words.read.format("docx").schema("page int").load(str(tmp_path)).collect()


def test_round_trip_append_and_overwrite(words, tmp_path):
    rows = words.createDataFrame([(f"n{i}.docx", [f"title {i}", "a & b", None], [0]) for i in range(20)] + [("empty.docx", None, None)], MADE).repartition(3)
    out = str(tmp_path / "out")
    rows.write.format("docx").mode("append").save(out)
    back = words.read.format("docx").load(out)
    of = lambda df: sorted((r["n"], r["paragraphs"]) for r in df.select(F.element_at(F.split("path", "/"), -1).alias("n"), "paragraphs").collect())
    assert of(back) == sorted([(f"n{i}.docx", [f"title {i}", "a & b", ""]) for i in range(20)] + [("empty.docx", [])])
    rows.filter("name = 'n1.docx'").write.format("docx").mode("append").save(out)
    assert words.read.format("docx").load(out).count() == 22
    rows.filter("name = 'n2.docx'").write.format("docx").mode("overwrite").save(out)
    assert [n for n, _ in of(words.read.format("docx").load(out))] == ["n2.docx"]


def test_a_failed_write_leaves_nothing_to_read(words, tmp_path):
    out = str(tmp_path / "out")
    bad = words.createDataFrame([("ok.docx", ["x"], None), ("a/b.docx", ["x"], None)], MADE).coalesce(1)
    with pytest.raises(Exception, match="no name"):
        bad.write.format("docx").mode("append").save(out)
    assert words.read.format("docx").load(out).count() == 0
