"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns;
``run`` writes each stage's result as Parquet in the shared folder and gives what is read back to
the next stage. The last stage returns the packed pieces.

Defined results, of all stages: a null or empty text is kept as it is, and packed as its end id
alone; a row without doc_id is kept by every stage that its text does not fail; rows are never
merged, so repeated rows pass together, but for ``one_of_each_group``; extra columns come through
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.session import ship
from tidemark.llm import decontaminate, lsh_forest, packing, suffix_dedup, toxicity
from tidemark.llm.queries import held_out, table, tokenizer
from tidemark.llm.store import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model learns from the labelled rows of four folds.

    A text without words, or a null one, has the score of no hits. Equal texts share their fate.
    """
    ship(spark)
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.below(docs, model, 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id.

    Where rows share an id, each text is judged by itself; of rows with one id and one text, one stays.
    """
    return lsh_forest.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id has.

    No row goes. Rows with one id leave each other's text alone; a row without id comes after all others.
    """
    return suffix_dedup.cleaned(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Each row is judged by its text, whatever rows share its id. Null and empty items fit nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens, rows with one id in order of text."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Stages that learn, hash or tokenise have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
