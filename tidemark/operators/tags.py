"""From token labels of an entity model to spans, within a row: no text or token is moved.

Labels are B or I and a type (``B-PER``, ``B_PERS``) or anything else for outside. A token carries on
the entity of the token before it if it has the same type and is an I, or a B that only white space
separates; else an I begins an entity like a B. Other labels, and special tokens (both offsets 0),
end it.

Defined results: null or empty tokens, or a null text, have no spans; tokens stand in the order given
and offsets count characters; equal rows have equal spans; tokens of no width between others end an entity only if
their label does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import free_names
from tidemark.operators.boundary import Factory
from tidemark.operators.deid import text_windows
from tidemark.operators.known import portions

#: ``blank``: nothing but white space stands between a token and the one before.
TOKENS = "array<struct<start:int,end:int,label:string,blank:boolean>>"
_READ = "struct<start:int,end:int,type:string,inside:boolean,blank:boolean>"
#: Bytes of text whose tokens are in memory at a time; a longer window is taken by itself.
PORTION = 1 << 18
#: Spans are looked up in pieces of 2 ** PIECE characters.
PIECE = 8
#: Names that models give to types.
TYPE_NAMES = {"PERS": "PER"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, for which the value is worked out once a row, however often it is used, within other lambdas, too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, tokens: Column, types: list[str] | None = None, names: dict[str, str] = TYPE_NAMES) -> Column:
    """``array<struct<start, end, label, text>>`` of the entities that ``tokens`` tag in ``text``; of ``types``, if given.

    Each token meets its neighbours in arrays shifted by one, and the text is cut once into pieces in which
    spans are looked up, so the work is linear in the tokens and the text.
    """
    named = lambda kind: F.coalesce(*[F.when(kind == old, new) for old, new in names.items()], kind)
    special = lambda t: (t["start"] == 0) & (t["end"] == 0)
    tags = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(~special(t), F.regexp_extract(t["label"], r"^([BI][-_].+)$", 1)).alias("tag"), t["blank"].alias("blank")))
    kind = lambda t: F.when(t["tag"] != "", named(F.substring(t["tag"], F.lit(3), F.length(t["tag"]))))
    read = F.transform(tags, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), kind(t).alias("type"), t["tag"].startswith("I").alias("inside"), t["blank"].alias("blank")))
    none = F.array(F.lit(None).cast(_READ))
    on = lambda a, b: F.coalesce((a["type"] == b["type"]) & (b["inside"] | b["blank"]), F.lit(False))

    def joined(read: Column) -> Column:
        rest = F.greatest(F.size(read) - 1, F.lit(0))
        edges = lambda near, joined: F.filter(F.zip_with(read, near, lambda t, o: F.when(t["type"].isNotNull() & ~joined(t, o), t)), lambda t: t.isNotNull())
        first = edges(F.concat(none, F.slice(read, F.lit(1), rest)), lambda t, o: on(o, t))
        last = edges(F.concat(F.slice(read, F.lit(2), rest), none), on)
        return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"), a["type"].alias("label")))

    whole = _once(read, joined)
    if types is not None:
        whole = F.filter(whole, lambda s: s["label"].isin(types))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE}}}"), F.lit(0))
    return _once(pieces, lambda p: F.transform(whole, lambda s: s.withField("text", _cut(p, s["start"], s["end"]))))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` to ``end`` of a text in pieces."""
    first = F.greatest(F.shiftright(start, PIECE), F.lit(0))
    near = F.slice(pieces, first + 1, F.greatest(F.shiftright(end - 1, PIECE) - first + 1, F.lit(0)))
    return F.substring(F.array_join(near, ""), start - F.shiftleft(first, PIECE) + 1, end - start)


def _tokens(texts: list[str], found: Iterable[list[tuple[int, int, str]]]) -> pa.Array:
    """What a model found in each text, as TOKENS."""
    upto, starts, ends, labels, blank = [0], [], [], [], []
    for text, own in zip(texts, found):
        before = 0
        for start, end, label in own:
            starts.append(start)
            ends.append(end)
            labels.append(label)
            blank.append(not text[before:start].strip())
            before = end
        upto.append(len(starts))
    fields = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(labels, pa.string()), pa.array(blank, pa.bool_())]
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "label", "blank"]))


def tagged(docs: DataFrame, factory: Factory, size: int = 800, overlap: int = 150) -> DataFrame:
    """``(doc_id, start, window, tokens)``: what a model says of the tokens of each window of a text; offsets count from the window's start.

    Tokens take many times the memory of their text, so the model is asked for, and tells, about PORTION bytes of text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            for part in portions(batch, 2, PORTION):
                texts = part.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, _tokens(texts, model(texts))], ["doc_id", "start", "window", "tokens"])

    rows = text_windows(docs, size, overlap)
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, `window` string, tokens {TOKENS}")


def entities(docs: DataFrame, factory: Factory, size: int = 800, overlap: int = 150, types: tuple[str, ...] = ("PER", "ORG")) -> DataFrame:
    """``(doc_id, start, end, label, text)`` of the entities of whole texts; what two windows tell is told once, by the window that has it deeper inside."""
    (own,) = free_names(docs, "_span")
    last = docs.select("doc_id", F.length("text").alias("_n")).distinct()
    rows = tagged(docs, factory, size, overlap).join(last, "doc_id").withColumn(own, F.explode(spans(F.col("window"), F.col("tokens"), list(types))))
    half, begin = overlap // 2, F.col(own)["start"]
    mine = ((begin >= half) | (F.col("start") == 0)) & ((begin < size - overlap + half) | (F.col("start") + size >= F.col("_n")))
    shift = lambda c: (F.col("start") + F.col(own)[c]).alias(c)
    return rows.filter(mine).select("doc_id", shift("start"), shift("end"), F.col(own)["label"].alias("label"), F.col(own)["text"].alias("text")).distinct()
