"""New texts for the sections of Word files, in the form of a skeleton file.

A skeleton's paragraphs are cut into blocks: what stands before the first heading, then each heading with
its body, which ends at the next heading or a signature. Each block gives the paragraphs of the new
file: bodies are replaced in the form of their first paragraph, or of the heading without bold; some
sections go; the rest, tables and signatures among it, stays as it is. Files are written in tasks, each
attempt in folders of its own, and count once the manifest that Spark commits names them. They are read in
tasks that get the manifest's rows, so no list of files is ever held by the driver.

Defined results: a section without a new text keeps its heading alone; a new text for a section that
the skeleton lacks is not written, and told in ``missing``; blank lines are left out, and so are characters
that XML cannot hold; domains in the order given come first, others by name; a second heading of a key
belongs to the body it stands in; equal rows give files of their own; a file that is gone or damaged has an
error when read; an empty table gives none.
"""

from __future__ import annotations

import copy
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree as E

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.session import saved
from tidemark.functions.vocab import DOMAINS, FINDINGS, SECTIONS, SIGNATURE_MARK, SIGNATURE_START
from tidemark.sources.docx import _W, _text

_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_NO_XML = re.compile("[^\t\n\r\u0020-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _form(paragraph: E.Element | None, bold: bool = True) -> tuple[E.Element | None, E.Element | None]:
    """Properties of a paragraph and of its first run; without ``bold`` the run's marks of it go."""
    if paragraph is None:
        return None, None
    run = copy.deepcopy(paragraph.find(f"{_W}r/{_W}rPr"))
    if run is not None and not bold:
        for tag in ("b", "bCs"):
            for mark in run.findall(f"{_W}{tag}"):
                run.remove(mark)
    return copy.deepcopy(paragraph.find(f"{_W}pPr")), run


def _paragraph(text: str, form: tuple, bold: bool = False) -> E.Element:
    out = E.Element(f"{_W}p")
    run = E.Element(f"{_W}r")
    for parent, own in ((out, form[0]), (run, form[1])):
        if own is not None:
            parent.append(copy.deepcopy(own))
    if bold:
        own = run.find(f"{_W}rPr")
        own = E.SubElement(run, f"{_W}rPr") if own is None else own
        if own.find(f"{_W}b") is None:
            E.SubElement(own, f"{_W}b")
    E.SubElement(run, f"{_W}t", {_SPACE: "preserve"}).text = _NO_XML.sub("", text)
    out.append(run)
    return out


def _lines(text: str | None) -> list[str]:
    return [x.strip() for x in _NO_XML.sub("", text or "").split("\n") if x.strip()]


def rewritten(document: bytes, sections: dict[str, str], domains: dict[str, str], headings=SECTIONS, titles: dict[str, str] | None = None, drop: Iterable[str] = (), preamble: Iterable[tuple[str, str]] = (), findings: str = FINDINGS, order=DOMAINS, signed: Callable[[str], bool] | None = None) -> tuple[bytes, list[str]]:
    """A skeleton's ``document.xml`` with new texts, and the keys of ``sections`` that it has no heading for.

    ``titles``: headings that are worded anew, by key; ``drop``: keys of sections that go; ``preamble``: (how a
    line before the first heading begins, what stands there instead).
    """
    signed = signed or (lambda line: SIGNATURE_MARK in line or line.startswith(SIGNATURE_START))
    root = E.fromstring(document)
    body = root.find(f"{_W}body")
    blocks: list[tuple[str | None, list[E.Element]]] = [(None, [])]
    seen = set()
    for node in list(body):
        line = _text(node).split("\n", 1)[0].strip() if node.tag == f"{_W}p" else ""
        key = next((k for h, k in headings if line.rstrip(":").strip().startswith(h.rstrip(":"))), None) if line else None
        if key is not None and key not in seen:
            seen.add(key)
            blocks.append((key, []))
        elif blocks[-1][0] is not None and signed(line):
            blocks.append(("", []))  # from a signature on all stays, until the next heading
        blocks[-1][1].append(node)
        body.remove(node)
    out: list[E.Element] = []
    for key, nodes in blocks:
        if key is None:
            for node in nodes:
                line = _text(node).strip() if node.tag == f"{_W}p" else ""
                new = next((text for begins, text in preamble if line.startswith(begins)), None)
                out.append(node if new is None else _paragraph(new, _form(node)))
        elif key == "" or (key not in sections and key not in drop and not (key == findings and domains)):
            out += nodes
        elif key not in drop:
            head, rest = nodes[0], [n for n in nodes[1:] if n.tag == f"{_W}p"]
            donor = next((n for n in rest if _text(n).strip()), None)
            form = _form(head, bold=False) if donor is None else _form(donor)
            out.append(_paragraph((titles or {}).get(key, _text(head).split("\n", 1)[0].strip()), _form(head)))
            out += [_paragraph(x, form) for x in _lines(sections.get(key))]
            if key == findings:
                for name in sorted(domains, key=lambda d: (order.index(d) if d in order else len(order), d)):
                    if lines := _lines(domains[name]):
                        out.append(_paragraph(f"{name} – ", form, bold=True))
                        out += [_paragraph(x, form) for x in lines]
            out += [n for n in nodes[1:] if n.tag != f"{_W}p"]
    body.extend(out)
    return E.tostring(root, encoding="utf-8", xml_declaration=True), sorted(set(sections) - seen)


def filled(content: bytes, *args, **how) -> tuple[bytes, list[str]]:
    """A whole Word file made of a skeleton's; see ``rewritten``."""
    to = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for item in source.infolist():
            part = source.read(item.filename)
            if item.filename == "word/document.xml":
                part, missing = rewritten(part, *args, **how)
            out.writestr(item.filename, part)
    return to.getvalue(), missing


def write(rows: DataFrame, root: str, **how) -> DataFrame:
    """``(doc_id, path, hash, missing, error)``, the manifest of the files made of ``rows`` (doc_id, name, skeleton, sections, domains).

    ``name`` is the file's name without folder; ``skeleton`` a Word file's bytes. A row at fault has an error and no file.
    """

    def run(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            out, own, names = [], "", set()
            for doc, name, content, sections, domains in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    made, missing = filled(content, dict(sections or []), dict(domains or []), **how)
                except Exception as error:  # noqa: BLE001  the row is at fault, whatever is wrong with it
                    out.append((doc, None, None, None, type(error).__name__))
                    continue
                if not own or name in names:  # one folder for the names of a batch, another where one comes again
                    own, names = uuid.uuid4().hex[:12], set()
                    system.create_dir(f"{folder}/{own}", recursive=True)
                names.add(name)
                with system.open_output_stream(f"{folder}/{own}/{name}", compression=None) as to:
                    to.write(made)
                out.append((doc, f"{root}/{own}/{name}", hashlib.sha256(made).hexdigest(), missing, None))
            if out:
                types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "path", "hash", "missing", "error"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", "name", "skeleton", "sections", "domains").mapInArrow(run, f"doc_id {kind}, path string, hash string, missing array<string>, error string")
    return saved(made, "manifest")


def read(manifest: DataFrame, root: str, most: int = 1 << 22) -> DataFrame:
    """The files below ``root`` that a manifest names, with doc_id, as ``docx.documents`` gives them; what lost attempts left is not among them.

    About ``most`` bytes of files are in a task's memory at a time, one file at least.
    """
    from tidemark.sources import docx

    def run(batches):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)

        def told(doc, path):
            own, hash_ = path.split("/")[-2], None
            try:
                with system.open_input_stream(folder + path.removeprefix(root), compression=None) as source:
                    content = source.read()
                hash_ = hashlib.sha256(content).hexdigest()
                return len(content), (path, own, hash_, *docx.parse(content), None, doc)
            except Exception as error:  # noqa: BLE001  the file is at fault, whatever is wrong with it
                return 0, (path, own, hash_, None, None, type(error).__name__, doc)

        for batch in batches:
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string(), batch.schema.field(0).type]
            give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)  # noqa: B023, E731
            out, held = [], 0
            for doc, path in zip(*(c.to_pylist() for c in batch.columns)):
                size, row = told(doc, path)
                out.append(row)
                held += size
                if held >= most:
                    yield give(out)
                    out, held = [], 0
            if out:
                yield give(out)

    schema = f"{docx.PARSED}, doc_id {manifest.schema['doc_id'].dataType.simpleString()}"
    names = [x.split()[0] for x in schema.split(", ")]
    # opening a file costs more than its row's bytes tell, so rows are dealt to all tasks
    rows = manifest.filter("path is not null").select("doc_id", "path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return rows.mapInArrow(run, schema)
