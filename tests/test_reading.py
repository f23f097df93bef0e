"""Addressees and conditions are read from the words of a duty."""

from __future__ import annotations

import pytest

from lexloom.functions import reading

CASES = [
    # subject, action, condition -> roles, (kind, fact, expect, addressee)
    ("The controller and the processors", "keep a register", "", ["controller", "processor"], []),
    ("every organisation", "keep a register", "", [], []),
    ("it", "keep a register", "where a covered entity maintains records", ["covered entity"], [("question", "maintains records", True, "covered entity")]),
    ("personal data", "be kept safe", "", [], []),
    ("a firm that holds client money and deals on its own account", "report", "", ["firm"], [("question", "holds client money and deals on its own account", True, None)]),
    ("The carrier", "report", "unless the carrier has no fleet; when it starts", ["carrier"], [("question", "has no fleet", False, None), ("trigger", None, None, None)]),
    ("the carrier, where applicable, or any such depot", "report", "where applicable", ["carrier", "depot"], [("trigger", None, None, None)]),
    ("the carrier", "report", "if an organisation uses cranes", ["carrier"], [("question", "uses cranes", True, None)]),
    ("the carrier", "report", "if they use cranes; if the weather turns bad", ["carrier"], [("question", "use cranes", True, None), ("trigger", None, None, None)]),
    (None, "report", None, [], []),
    ("", None, "", [], []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, *c[:3]) for i, c in enumerate(CASES)]
    return {r.id: r for r in reading.read(spark.createDataFrame(rows, "id int, subject string, action string, condition string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reading(found, i):
    r = found[i]
    assert [x.role for x in r.roles] == CASES[i][3]
    assert [(c.kind, c.fact, c.expect, c.addressee) for c in r.conditions] == CASES[i][4]


def test_predicates(spark):
    duty = spark.createDataFrame([(1, "the depot or the carriers", "report", "if they use cranes", "uk"), (2, None, None, None, None)], "id int, subject string, action string, condition string, j string")
    from pyspark.sql import functions as F

    read = reading.read(duty.drop("j")).join(duty.select("id", "j"), "id")
    got = sorted(tuple(r) for r in reading.predicates(read, "id", F.col("j")).collect())
    assert [g[1:3] for g in got][1:] == [("jurisdiction", "UK"), ("subject", "carrier|depot")]
    assert got[0][1] == "condition" and got[0][2].endswith(" use crane") and got[0][2].startswith("COND-") and got[0][3] is True
