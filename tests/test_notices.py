"""Dates, sums, kinds and respondents of notices."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.functions import notices

D = datetime.date
CASES = [
    # label, text -> date, amount, currency, kind, name, type
    ("SEC v. Foo Capital LLC", "On 3rd Sept. 2021 it was fined £1,250.50 and US$2 bn; earlier $3k.", D(2021, 9, 3), 2e9, "USD", "fine", "Foo Capital LLC", "firm"),
    ("Ann Lee (CRD #77)", "March 5, 2020: barred, and pays a penalty of EUR 5 m", D(2020, 3, 5), 5e6, "EUR", "prohibition", "Ann Lee", "individual"),
    ("", "The court orders Blue Harbour to pay €10. 02/13/2019", D(2019, 2, 13), 10.0, "EUR", "other", "Blue Harbour", "individual"),
    (None, "Acted against Blue Harbour Payments for lapses on 31/02/2019 and 2019-02-30, then 7 May 2018", D(2018, 5, 7), None, None, "other", "Blue Harbour Payments", "firm"),
    ("X1", "Suspension; a voluntary requirement; GBP 10 and £10", None, 10.0, "GBP", "suspension", "X1", "unknown"),
    ("", None, None, None, None, "other", "", "unknown"),
    ("Globe", "Former trader. Public statement, May 1 2020", D(2020, 5, 1), None, None, "censure", "Globe", "individual"),
]


@pytest.fixture(scope="module")
def read(spark):
    t = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "id int, label string, text string")
    return {r.id: r for r in t.select("id", notices.decided_on(F.col("text")).alias("d"), notices.largest_amount(F.col("text")).alias("m"), notices.kind(F.col("text")).alias("k"), notices.respondent(F.col("label"), F.col("text")).alias("r")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_notice(read, i):
    r, (_, _, day, amount, currency, kind, name, type_) = read[i], CASES[i]
    assert r.d == day
    assert ((r.m.amount, r.m.currency) if r.m else (None, None)) == (amount, currency)
    assert (r.k, r.r["name"], r.r["type"]) == (kind, name, type_)
