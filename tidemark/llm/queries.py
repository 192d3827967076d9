"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import oracles

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(doc_id="doc_id"):
    """Whether a row is kept from training; one without doc_id counts as the empty text, so it is."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simple8b import read_ids, write_ids

    return read_ids(write_ids(table(spark, sf_dir, "documents"), tokenizer()))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc_bundles import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lsh_forest import join

    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer())


def op7_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_digest import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_score_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.score_index import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fill_in_middle import restored, transform

    rows = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simple8b, op3_warc_bundles, op4_suffix_dedup, op5_lsh_forest, op6_window_packing, op7_license_digest, op8_quality_rules, op9_toxicity, op10_decontamination, op11_importance, op12_score_index, op13_fill_in_middle)}
ORACLES: dict[str, str] = {
    "op1_url_filter": oracles.url_filter(RULES), "op3_warc_bundles": oracles.WARC, "op4_suffix_dedup": oracles.SUFFIX,
    "op5_lsh_forest": oracles.JACCARD, "op7_license_digest": oracles.license_digest(), "op10_decontamination": oracles.LEAKS,
    "op11_importance": oracles.IMPORTANCE, "op12_score_index": oracles.TOP_K, "op13_fill_in_middle": oracles.MIDDLE,
}
