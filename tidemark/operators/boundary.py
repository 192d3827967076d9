"""Edges to models: embeddings, entities, answers and judgements, with models as factories.

A factory is called once in each task and gives a function on a list of inputs, so a model is
loaded where it runs and sees batches. Without a model the offline factories here stand in.

Defined results: a null or empty text has no entities and no embedding; a row whose answer fails or is empty has the status
``error``; rows with equal doc_id and text have their entities told once; other columns come through; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.deid import text_windows

Factory = Callable[..., Callable[[list], list]]


def hashing_embedder(size: int = 64) -> Factory:
    """Signed counts of hashed words; the same on every machine and for documents and queries."""

    def make(input_type: str = "document"):
        def embed(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                v = [0.0] * size
                for word in text.split():
                    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                    v[h % size] += 1.0 if h >> 63 else -1.0
                out.append(v)
            return out

        return embed

    return make


def gazetteer(names: list[str], label: str = "PER") -> Factory:
    """Finds given names as whole words: ``(start, end, label)`` of each."""

    def make():
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        return lambda texts: [[(m.start(), m.end(), label) for m in pattern.finditer(t)] for t in texts]

    return make


def embed(rows: DataFrame, column: str, factory: Factory, input_type: str | None = None) -> DataFrame:
    """Adds ``embedding``; a null or empty text has none. ``input_type`` (document, query), if given, goes to the factory."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, embedding array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory() if input_type is None else factory(input_type)
        for frame in frames:
            full = frame[column].map(bool)
            values = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            for i, v in zip(frame.index[full], model(frame.loc[full, column].tolist())):
                values.at[i] = v
            yield frame.assign(embedding=values)

    return rows.mapInPandas(run, schema)


def entities(docs: DataFrame, factory: Factory, size: int = 800, overlap: int = 150, letters: str | None = None) -> DataFrame:
    """``(doc_id, start, end, label, text)`` of entities in overlapping windows, each once.

    A window owns the entities that begin in its middle, up to half an overlap from its edges (the
    first and the last window from the text's edges), so what an edge cuts is told by the neighbour
    that has it whole.
    Kept are entities of two characters at least that stand as whole words in the document's text;
    ``letters``: a pattern that one of their characters must match.
    """
    windows = text_windows(docs, size, overlap).withColumnRenamed("window", "part")
    half = overlap // 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            out = []
            for doc, start, part, last, found in zip(frame["doc_id"], frame["start"], frame["part"], frame["last"], model(frame["part"].tolist())):
                out += [(doc, start + a, start + b, label) for a, b, label in found if a < b <= len(part) and (a >= half or start == 0) and (a < size - overlap + half or last)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "label"]).astype({"start": "int64", "end": "int64"})

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    lengths = docs.select("doc_id", F.length("text").alias("n")).distinct()
    windows = windows.join(lengths, "doc_id").withColumn("last", F.col("start") + F.lit(size) >= F.col("n"))
    found = windows.select("doc_id", "start", "part", "last").mapInPandas(run, f"doc_id {doc_type}, start long, end long, label string").distinct()
    rows = found.join(docs.select("doc_id", "text"), "doc_id")
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    before, after = F.substring("text", F.col("start"), F.when(F.col("start") > 0, 1).otherwise(0)), F.substring("text", F.col("end") + 1, F.lit(1))
    whole = ~before.rlike(r"(?U)\w") & ~after.rlike(r"(?U)\w")
    rows = rows.withColumn("value", value).filter(whole & (F.col("end") - F.col("start") >= 2))
    if letters:
        rows = rows.filter(F.col("value").rlike(letters))
    return rows.select("doc_id", "start", "end", "label", F.col("value").alias("text"))


def answers(prompts: DataFrame, factory: Factory, column: str = "prompt") -> DataFrame:
    """Adds ``answer`` and ``status``; an error or an empty answer stops no other row."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, answer string, status string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            texts = frame[column].tolist()
            try:
                got = [x or None for x in model(texts)]
            except Exception:  # noqa: BLE001  whatever a remote model raises: then one by one
                got = [_alone(model, text) for text in texts]
            yield frame.assign(answer=got, status=["ok" if g else "error" for g in got])

    return prompts.mapInPandas(run, schema)


def _alone(model: Callable[[list], list], text: str):
    try:
        return model([text])[0] or None
    except Exception:  # noqa: BLE001
        return None


def evaluated(questions: DataFrame, answer: Factory, judge: Factory) -> DataFrame:
    """``questions`` (question, expected_answer) with answer, status and the judge's four scores; an error scores zero."""
    told = answers(questions, answer, "question")
    judged = answers(told.withColumnRenamed("answer", "_given").withColumnRenamed("status", "_status").withColumn("_prompt", F.to_json(F.struct("question", F.coalesce("_given", F.lit("[error]")).alias("answer"), "expected_answer"))), judge, "_prompt")
    return judged.select(*questions.columns, F.col("_given").alias("answer"), F.col("_status").alias("status"), scores(F.col("answer")).alias("scores"))


def averages(rows: DataFrame, *by: str) -> DataFrame:
    """The mean of each score and how many rows were judged, whose scores are not all zero; by ``by``."""
    names = ["relevance", "faithfulness", "completeness", "fluency"]
    return rows.groupBy(*by).agg(*[F.round(F.avg(f"scores.{n}"), 6).alias(n) for n in names], F.count_if(F.greatest(*[F.col(f"scores.{n}") for n in names]) > 0).alias("n_judged"))


def scores(answer: Column) -> Column:
    """Four scores of a judge from 1 to 5; zeros where its answer does not parse."""
    names = ["relevance", "faithfulness", "completeness", "fluency"]
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), ", ".join(f"{n} int" for n in names))
    return F.struct(*[F.coalesce(F.when(parsed[n].between(1, 5), parsed[n]), F.lit(0)).alias(n) for n in names])
