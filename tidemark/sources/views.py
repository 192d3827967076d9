"""The engine's tables, as views over the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.store import upsert


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions_raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("session_date"), F.col("o_orderpriority").alias("text"), F.col("o_orderkey").alias("seq"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return upsert(sessions_raw(spark, d), ["patient_id", "session_date"], ["seq"])


def goals_raw(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("patient_id"), F.col("l_shipdate").cast("date").alias("session_date"), F.col("l_returnflag").alias("text"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("line")
    )


def goals(spark: SparkSession, d: str) -> DataFrame:
    return upsert(goals_raw(spark, d), ["patient_id", "session_date"], ["orderkey", "line", "text"])


def findings(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("event_type").isin("click", "view"), "engagement")
    return table(spark, d, "events").select(
        F.col("user_id").alias("patient_id"), F.col("ts").cast("date").alias("session_date"), F.col("event_type").alias("domain"), parent.alias("parent_domain"),
        F.col("props").alias("text"), F.col("event_id").alias("seq"), F.concat(F.lit("file"), (F.col("event_id") % 50).cast("string")).alias("source"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def template_of(lang: Column) -> Column:
    return F.when(lang == "en", "diagnosis").when(lang == "de", "clinic_visit_summary").otherwise("treatment_plan")


def day_of(doc_id: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 365).cast("int"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    rows = docs.select(
        F.col("source").alias("patient_id"), template_of(F.col("lang")).alias("template"), day_of(F.col("doc_id")).alias("session_date"), F.concat(F.lit("s"), F.col("ord").cast("string")).alias("section"),
        F.col("line").alias("text"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_file"), F.col("doc_id").alias("seq"),
    )
    return upsert(rows, ["patient_id", "template", "session_date", "section"], ["seq"])


def patient_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections with numbers for patients."""
    return sections(spark, d).withColumn("patient_id", F.regexp_extract("patient_id", "[0-9]+", 0).cast("long"))


def session_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, each of the session whose number is three times its own."""
    own = vectors(spark, d).select("vec_id", "chunk_type", "embedding", (F.col("vec_id") * 3).alias("seq"))
    return own.join(sessions(spark, d).select("seq", "patient_id", "session_date"), "seq").drop("seq")


def attributes(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return named.unpivot(["c_custkey"], ["display_name", "segment", "nation"], "field_name", "value").withColumnRenamed("c_custkey", "patient_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v, F.col("label").cast("long").alias("patient_id"), day_of(v).alias("session_date"), F.when(v % 2 == 0, "session_summary").otherwise("goals_row").alias("chunk_type"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def params(spark: SparkSession, d: str) -> DataFrame:
    """One row for each user turn: intent, template, topic and dates follow from its number."""
    k = F.col("conv_id") * 31 + F.col("turn")
    word = F.element_at(F.split("text", " "), 1)
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    return table(spark, d, "conversations").filter("role = 'user'").select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), (k % 150).alias("patient_id"),
        pick(5, ["summarize", "find_specific", "check_domain", "compare_progress", "other"]).alias("intent"), pick(4, ["diagnosis", "clinic_visit_summary", "treatment_plan", None]).alias("template"),
        F.when(k % 3 == 0, F.concat(F.lit(' "'), pick(7, ["click", "view", "engagement", "purchase", "signup", "search", "none"]), F.lit('", '))).when(k % 3 == 1, word).alias("topic"),
        F.when(k % 2 == 0, F.date_add(F.lit("1995-01-01").cast("date"), (k % 1500).cast("int"))).alias("date_from"), F.when(k % 7 == 0, (k % 12 + 1).cast("int")).alias("session_limit"),
        F.when(k % 4 == 0, F.date_add(F.lit("1995-01-01").cast("date"), (k % 1500 + 400).cast("int"))).alias("date_to"),
    )
