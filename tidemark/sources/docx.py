"""Word files: paragraphs and first-table cells of each, read by Spark's binary source.

Defined results: a file that is no Word file has an error, null paragraphs and null cells; one without a
table or without paragraphs has empty lists; equal files at two paths are two; a path that is listed by two roots
counts once if the roots are equal; folders without such files give no rows.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the namespace of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Columns of parsed files.
PARSED = "path string, folder string, hash string, paragraphs array<string>, cells array<array<string>>, error string"


#: Columns of Spark's binary source.
LISTED = "path string, modificationTime timestamp, length long, content binary"


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All ``.docx`` files below the roots as the binary source tells them; contents are read if they are asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(list(dict.fromkeys(roots)))


def described(rows: DataFrame) -> DataFrame:
    """Files (path, content) with folder and content hash; lock files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    return rows.filter(~name.startswith("~")).select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.sha2("content", 256).alias("hash"), "content")


def files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """All ``.docx`` files below the roots with folder and content hash; lock files are left out."""
    return described(listing(spark, roots))


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def parse(content: bytes) -> tuple[list[str], list[list[str]]]:
    """Body paragraphs and the rows of the first table."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [_text(p) for p in body.findall(f"{_W}p")]
    table = body.find(f"{_W}tbl")
    rows = [] if table is None else [["\n".join(_text(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
    return paragraphs, rows


def documents(found: DataFrame) -> DataFrame:
    """Parsed files; one that cannot be read has an error and no paragraphs, and stops no other."""

    def run(batches):
        for batch in batches:
            out = []
            for path, folder, hash_, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out.append((path, folder, hash_, *parse(content), None))
                except Exception as error:  # noqa: BLE001  the file is at fault, whatever is wrong with it
                    out.append((path, folder, hash_, None, None, f"{type(error).__name__}"))
            if out:
                types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in PARSED.split(", ")])

    return found.select("path", "folder", "hash", "content").mapInArrow(run, PARSED)


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("path").alias("doc_id"), F.posexplode("paragraphs").alias("ord", "line"))


def cells(docs: DataFrame) -> DataFrame:
    """Rows of the first table with two cells at least."""
    rows = docs.select(F.col("path").alias("doc_id"), F.posexplode("cells").alias("ord", "row")).filter(F.size("row") >= 2)
    return rows.select("doc_id", "ord", F.get("row", F.lit(0)).alias("cell0"), F.get("row", F.lit(1)).alias("cell1"))


def write(path: str, lines: list[tuple[str, bool]]) -> None:
    """A small Word file: ``(text, is a heading)`` paragraphs, in order."""
    from xml.sax.saxutils import escape

    mark = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f'<w:p>{mark if h else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t, h in lines)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
