"""Parsers on small fixtures with the default vocabularies."""

from pyspark.sql import functions as F

from tidemark.functions.text import parse_day
from tidemark.functions.vocab import DOMAINS, HEADER_A, SECTIONS
from tidemark.operators import parse

H = [h for h, _ in SECTIONS]


def lines(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc_id string, ord int, line string")


def test_sections_with_signature_alias_and_repeats(spark):
    rows = lines(spark, ["before", H[0] + ":", " a ", "", "b", "בברכה", "lost", H[5], "c", H[0] + " again", "d"])
    got = {r["section"]: r["text"] for r in parse.section_texts(parse.classify(rows)).collect()}
    assert got == {SECTIONS[0][1]: "a\nb\nd", SECTIONS[1][1]: "c"}


def test_domains_inline_text_parents_and_scope(spark):
    d = DOMAINS
    rows = lines(spark, [H[0], f"{d[0]}: not here", H[2], f"{d[0]}: one", "two", f"{d[1]} - three", f"{d[3]} – four", d[2], f"{d[12]}"])
    c = parse.classify(rows)
    got = {r["domain"]: (r["text"], r["parent_domain"]) for r in parse.domain_texts(c).collect()}
    assert got == {d[0]: ("one\ntwo", None), d[1]: ("three", None), d[3]: ("four", d[2]), d[12]: ("", None)}
    assert {r["section"]: r["text"] for r in parse.section_texts(c).collect()} == {SECTIONS[0][1]: f"{d[0]}: not here"}


def test_header_first_non_empty_match_wins(spark):
    rows = lines(spark, ["שם: אלף", "שם: בית", "ת.ז.: 12", "תאריך: 01/02/2026"] + [""] * 8 + ["HMO: late"])
    got = parse.header_fields(rows, HEADER_A, 10).first().asDict()
    assert (got["name"], got["national_id"], got["date"], got["hmo_name"]) == ("אלף", "12", "01/02/2026", None)


def test_dates(spark):
    texts = ["07/03/2025", "7/3/2025", "07.03.2025", " 7.3.2025 ", "31/02/2025", "7/13/2025", "7/3/25", "7/3/2025 x", "", None]
    got = [r[0] and r[0].isoformat() for r in spark.createDataFrame([(t,) for t in texts], "x string").select(parse_day(F.col("x"))).collect()]
    assert got == ["2025-03-07"] * 4 + [None] * 6


def test_blocks_and_fallback(spark):
    rows = lines(spark, ["pre", "1/2/2025", "a", "b", "2/2/2025", "3/2/2025", "c", "1/2/2025", "z"]).unionByName(lines(spark, ["x", " ", "y"], "e"))
    got = sorted((r["doc_id"], str(r["session_date"]), r["text"]) for r in parse.dated_blocks(rows, F.lit("2020-01-01").cast("date")).collect())
    assert got == [("d", "2025-02-01", "a\nb"), ("d", "2025-02-01", "z"), ("d", "2025-02-03", "c"), ("e", "2020-01-01", "x\ny")]


def test_goal_rows_and_rejects(spark):
    cells = spark.createDataFrame([("date", "goal"), ("", ""), ("1/2/2025", " go "), ("1/2/2025", ""), ("", "x")], "cell0 string, cell1 string")
    good, bad = parse.goal_rows(cells)
    assert [(str(r["session_date"]), r["text"]) for r in good.collect()] == [("2025-02-01", "go")]
    assert sorted(r["reason"] for r in bad.collect()) == ["date", "date", "text"]
