"""Temporal retrieval: ranges, latest N, as-of, before and after, documents with findings, hierarchy.

Defined results: a null date is in no range with a bound; a null key matches none in joins; ties go by
the columns named, the largest first; repeated rows stay repeated; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.columns import free_names
from tidemark.functions.text import has_text


def in_range(date: Column, low=None, high=None) -> Column:
    """Inclusive bounds, each optional; dates are ISO strings or columns."""
    out = F.lit(True)
    if low is not None:
        out = out & (date >= (low if isinstance(low, Column) else F.lit(low).cast("date")))
    if high is not None:
        out = out & (date <= (high if isinstance(high, Column) else F.lit(high).cast("date")))
    return out


def latest_n(rows: DataFrame, key: str, n: int, date: str = "session_date", ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The latest ``n`` rows of each key with their place, 1 for the oldest of them."""
    w = Window.partitionBy(key).orderBy(F.desc(date), *[F.desc(t) for t in ties])
    (rank,) = free_names(rows, "_rank")
    rows = rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return rows.withColumn("place", (F.max(rank).over(Window.partitionBy(key)) - F.col(rank) + 1).cast("long")).drop(rank)


def recent_window(rows: DataFrame, key: str, n: int, date: str = "session_date", ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    """First and last date of the latest ``n`` rows of each key."""
    return latest_n(rows, key, n, date, ties).groupBy(key).agg(F.min(date).alias("date_from"), F.max(date).alias("date_to"))


def as_of(left: DataFrame, right: DataFrame, key: str, date: str, value: str, ties: list[str], bucket: str = "month") -> DataFrame:
    """For each left row the latest right value on or before its date; null without one.

    Both sides are laid in one order and the value carried forward, so no row meets more than its
    predecessor. The order is cut into buckets of time, so a key with very many rows is spread over
    tasks; what a bucket starts with comes from a small table of the last value of each bucket.
    """
    v, side, part = free_names(left, "_value", "_side", "_part")
    cut = F.trunc(F.col(date), bucket)
    r = right.select(key, date, *ties, F.struct(F.col(value).alias("is")).alias(v), F.lit(1).alias(side)).withColumn(part, cut)
    l = left.withColumn(side, F.lit(2)).withColumn(part, cut)  # noqa: E741
    last = r.groupBy(key, part).agg(F.max_by(v, F.struct(date, *ties)).alias(v))
    asked = l.select(key, part).distinct().withColumn(v, F.lit(None).cast(r.schema[v].dataType))
    buckets = last.unionByName(asked).groupBy(key, part).agg(F.first(v, ignorenulls=True).alias(v))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    opening = buckets.select(key, part, F.last(v, ignorenulls=True).over(before).alias(v), F.lit(0).alias(side)).filter(F.col(v).isNotNull())
    both = l.unionByName(r, allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    order = [F.col(date).asc_nulls_first(), F.col(side), *[F.col(t).asc_nulls_first() for t in ties]]
    w = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(v, F.last(v, ignorenulls=True).over(w))
    return both.filter(F.col(side) == 2).withColumn(value, F.col(v)["is"]).select(*left.columns, value)


def compare_split(rows: DataFrame, reference: Column, date: str = "session_date") -> DataFrame:
    """Strictly before, or on and after, the reference date."""
    return rows.withColumn("side", F.when(F.col(date) < reference, "before").otherwise("after"))


def compare_status(rows: DataFrame, key: str, reference: Column) -> DataFrame:
    """Counts on both sides of each key, and which of four outcomes a comparison has."""
    side = compare_split(rows, reference)
    out = side.groupBy(key).agg(F.count_if(F.col("side") == "before").alias("n_before"), F.count_if(F.col("side") == "after").alias("n_after"))
    none_before, none_after = F.col("n_before") == 0, F.col("n_after") == 0
    return out.withColumn("status", F.when(none_before & none_after, "no_data").when(none_before, "no_before").when(none_after, "no_after").otherwise("ok"))


def latest_documents(sections: DataFrame) -> DataFrame:
    """All sections of the latest date of each patient and template, by one window."""
    (own,) = free_names(sections, "_last")
    last = F.max("session_date").over(Window.partitionBy("patient_id", "template"))
    return sections.withColumn(own, last).filter(F.col("session_date") == F.col(own)).drop(own)


def base_documents(sections: DataFrame, priority: list[str]) -> DataFrame:
    """For each patient, template and date of the first template in ``priority`` that it has, latest first."""
    rank = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("template"))
    docs = sections.filter(F.col("template").isin(priority)).withColumn("_p", rank)
    best = F.max_by(F.struct("template", "session_date"), F.struct(-F.col("_p"), F.col("session_date")))
    return docs.groupBy("patient_id").agg(best.alias("_b")).select("patient_id", "_b.template", "_b.session_date")


def findings_of(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings on the dates of documents, each once."""
    return findings.join(documents.select("patient_id", "session_date").distinct(), ["patient_id", "session_date"])


def domain_lookup(findings: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of each query's topic, as a domain or as the parent of domains; ``queries``: query_id, patient_id, topic.

    Exact and parent matches are two equi-joins, so neither turns into a nested loop.
    """
    exact = queries.join(findings.withColumn("topic", F.col("domain")), ["patient_id", "topic"])
    below = queries.join(findings.filter("parent_domain is not null").withColumn("topic", F.col("parent_domain")), ["patient_id", "topic"])
    return exact.unionByName(below)


def with_fallback(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Each query and the source that answers it: its domain rows with text, or else vectors."""
    answered = found.filter(has_text(F.col("text"))).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(answered, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("source", F.when(F.col("n") > 0, "domain").otherwise("vector"))


def hydrate(hits: DataFrame, sessions: DataFrame, goals: DataFrame) -> DataFrame:
    """Texts of vector hits: sessions by equal date, goals as of the date; hits without a row go.

    ``hits``: vec_id, patient_id, session_date, chunk_type; the small side decides the join.
    """
    said = hits.filter("chunk_type = 'session_summary'").join(sessions.select("patient_id", "session_date", "text"), ["patient_id", "session_date"])
    aims = as_of(hits.filter("chunk_type = 'goals_row'"), goals.select("patient_id", "session_date", "text", "orderkey", "line"), "patient_id", "session_date", "text", ["orderkey", "line"])
    return said.select(*hits.columns, "text").unionByName(aims.filter("text is not null").select(*hits.columns, "text"))


def first_root(files: DataFrame, roots: list[str], key: str = "folder") -> DataFrame:
    """For each key the path below the first root, in the order given, that has it."""
    place = F.coalesce(*[F.when(F.col("path").startswith(r), F.lit(i)) for i, r in enumerate(roots)])
    return files.withColumn("_p", place).filter("_p is not null").groupBy(key).agg(F.min_by("path", F.struct("_p", "path")).alias("path"))


def within(rows: DataFrame) -> Column:
    """Whether ``session_date`` lies within the row's optional ``date_from`` and ``date_to``."""
    day = F.col("session_date")
    return (F.col("date_from").isNull() | (day >= F.col("date_from"))) & (F.col("date_to").isNull() | (day <= F.col("date_to")))


def sessions_for(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(query_id, session_date, text)``: a query's latest ``session_limit`` sessions, or those within its dates.

    ``queries``: query_id, patient_id, session_limit, date_from, date_to; any limit, each its own.
    """
    own = queries.select("query_id", "patient_id", "session_limit", "date_from", "date_to").join(sessions, "patient_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("session_date"), F.desc("seq"))
    limited = own.filter("session_limit is not null").withColumn("_rn", F.row_number().over(w)).filter("_rn <= session_limit")
    ranged = own.filter(F.col("session_limit").isNull() & within(own))
    return limited.select("query_id", "session_date", "text").unionByName(ranged.select("query_id", "session_date", "text"))


def documents_for(queries: DataFrame, sections: DataFrame, findings: DataFrame) -> DataFrame:
    """``(query_id, side, session_date, text)``: documents of a query's template, with the findings of their dates.

    The latest document where a limit or no first date is given, else those within the dates.
    """
    own = queries.select("query_id", "patient_id", "template", "session_limit", "date_from", "date_to").join(sections, ["patient_id", "template"])
    newest = F.max("session_date").over(Window.partitionBy("query_id"))
    latest = F.col("session_limit").isNotNull() | F.col("date_from").isNull()
    own = own.withColumn("_last", newest).filter(F.when(latest, F.col("session_date") == F.col("_last")).otherwise(within(own)))
    dates = own.select("query_id", "patient_id", "session_date").distinct()
    found = dates.join(findings.select("patient_id", "session_date", "text"), ["patient_id", "session_date"])
    side = lambda rows, name: rows.select("query_id", F.lit(name).alias("side"), "session_date", "text").filter(has_text(F.col("text")))
    return side(own, "document").unionByName(side(found, "finding"))


def domains_for(queries: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with text of each query's topic, and the queries that have none, which vectors answer."""
    rows = domain_lookup(findings, queries.select("query_id", "patient_id", F.col("used_topic").alias("topic")))
    rows = rows.filter(has_text(F.col("text"))).select("query_id", F.lit("domain").alias("side"), "session_date", "text")
    return rows, queries.join(rows.select("query_id").distinct(), "query_id", "left_anti")


def vectors_for(queries: DataFrame, vectors: DataFrame | None, sessions: DataFrame, goals: DataFrame, k: int = 10) -> DataFrame:
    """The texts of each query's ``k`` nearest vectors within its dates, a limit standing for the dates of its latest sessions.

    ``queries`` also has ``query``, its vector. Without an index (None) all sessions within the dates
    are the answer; a query that the index has nothing for gets no rows.
    """
    from tidemark.operators.vector import top_k_batch

    if vectors is None:
        return sessions_for(queries.withColumn("session_limit", F.lit(None).cast("int")), sessions).filter(has_text(F.col("text"))).select("query_id", F.lit("session").alias("side"), "session_date", "text")
    recent = sessions_for(queries.filter("session_limit is not null"), sessions).groupBy("query_id").agg(F.min("session_date").alias("_from"), F.max("session_date").alias("_to"))
    asked = queries.join(recent, "query_id", "left").withColumn("date_from", F.coalesce("_from", "date_from")).withColumn("date_to", F.coalesce("_to", "date_to"))
    best = top_k_batch(vectors, asked.select("query_id", "patient_id", "date_from", "date_to", "query"), k)
    hits = best.select("query_id", "vec_id").join(vectors.select("vec_id", "patient_id", "session_date", "chunk_type"), "vec_id")
    return hydrate(hits, sessions, goals).select("query_id", F.lit("vector").alias("side"), "session_date", "text")


def with_topic_vectors(queries: DataFrame, factory) -> DataFrame:
    """``queries`` with ``query``, the vector of ``used_topic`` as a model embeds questions, and ``status``: one without a topic is ``empty_topic``.

    Such a question is not to be searched for: the vector of no text is near to anything.
    """
    from tidemark.operators.boundary import embed

    blank = ~has_text(F.trim(F.coalesce("used_topic", F.lit(""))))
    (topic,) = free_names(queries, "_topic")
    rows = embed(queries.withColumn(topic, F.when(~blank, F.col("used_topic"))), topic, factory, "query")
    return rows.withColumn("status", F.when(F.col("embedding").isNull(), "empty_topic").otherwise("ok")).withColumnRenamed("embedding", "query").drop(topic)


def outcomes(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``queries`` with ``status``: ok; no_results; or, of a comparison, no_before or no_after."""
    n = rows.groupBy("query_id").agg(F.count("*").alias("_n"), F.count_if(F.col("side") == "before").alias("_before"), F.count_if(F.col("side") == "after").alias("_after"))
    out = queries.join(n, "query_id", "left")
    compared = F.col("strategy") == "compare"
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "no_results").when(compared & (F.col("_before") == 0), "no_before").when(compared & (F.col("_after") == 0), "no_after").otherwise("ok")
    return out.withColumn("status", status).drop("_n", "_before", "_after")
