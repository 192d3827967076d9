"""Telephone numbers by counted digits, header fields by labels."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.vocab import PHONE
from tidemark.operators import parse


@pytest.mark.parametrize("text", ["052-1234567", "052 123 4567", "0521234567", "+972-52-1234567", "+972521234567", "03-1234567", "031234567", "+972 3 123 4567", "0 5 2 1 2 3 4 5 6 7"])
def test_numbers_are_found_whole(text):
    assert re.search(PHONE, f"call {text}.")[0] == text


@pytest.mark.parametrize("text", ["052123456789", "05--21234567", "1234567", "+973521234567", "10521234567", "0521234"])
def test_other_digits_are_none(text):
    assert not re.search(PHONE, text)


def test_labels_and_their_values(spark):
    lines = ["Name: Dana : x", " NAME Dana", "Named: no", "my Name: no", "Name:", "Date 1/2/2025", "Date : 1/2/2025", ": x", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord int, line string").coalesce(1)
    line = F.trim("line")
    got = [tuple(r) for r in df.orderBy("ord").select(parse.labelled(line, ["name"], False), parse.labelled(line, ["date"])).collect()]
    assert got == [("Dana : x", None), ("Dana", None), (None, None), (None, None), ("", None), (None, None), (None, "1/2/2025"), (None, None), (None, None), (None, None)]
