"""Properties of single operators on small hand-made inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import grammar as g
from lexloom.functions import text as tx
from lexloom.operators.compose import minimise
from lexloom.operators.similarity import similar_pairs
from lexloom.operators.versions import as_of, diff, in_force, scd2
from lexloom.plans.fixpoint import follow, least_reachable
from lexloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "modality", "confidence"), [
    ("Every depot shall keep a register of incoming pallets.", "shall", 0.65),
    ("A carrier must not open sealed cargo without consent.", "must-not", 0.75),
    ("The harbour authority shall publish a tide table every month.", None, None),
    ("Staff should attend fire training when they join the depot.", None, None),
    ("Too short, must.", None, None),
])
def test_duty(spark, text, modality, confidence):
    found = g.duty(F.lit(text), F.lit(""))
    assert one(spark, found) == modality
    assert one(spark, g.confidence(F.lit(text), found)) == confidence


def test_structure_of_a_leading_condition(spark):
    parts = g.structure(F.lit("Where an operator stores fuel on site, it shall inspect each tank weekly."))
    row = spark.range(1).select(*[c.alias(k) for k, c in parts.items()]).first()
    assert (row.subject, row.modal, row.action) == ("it", "shall", "inspect each tank weekly")
    assert row.condition == "Where an operator stores fuel on site"


@pytest.mark.parametrize(("word", "stem"), [("policies", "policy"), ("processes", "process"), ("access", "access"), ("procedures", "procedur"), ("gas", "gas")])
def test_stem(spark, word, stem):
    assert one(spark, tx.stem(F.lit(word))) == stem


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 8), st.sets(st.integers(0, 6)), max_size=9), st.lists(st.integers(0, 6), max_size=2), st.sets(st.integers(0, 6)))
def test_minimise_covers_and_is_minimal(candidates, required, curated):
    picks, _ = minimise(candidates, required, curated)
    assert set(required) <= set(picks)
    covered = lambda chosen: {d for d, b in candidates.items() if b & chosen}
    everything = {d for d, b in candidates.items() if b}
    assert covered(set(picks)) == everything
    for b in set(picks) - set(required):
        assert covered(set(picks) - {b}) != everything


def test_similar_pairs_against_all_pairs(spark):
    words = [set("abcdefgh"), set("abcdefg"), set("abcdefghi"), set("xyz"), set("xy"), set(), set("q")]
    df = spark.createDataFrame([(i, sorted(w)) for i, w in enumerate(words)], "k int, w array<string>")
    got = {(r.a, r.b) for r in similar_pairs(df, "k", F.col("w"), 0.6).collect()}
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and a | b and len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_components_and_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    roots = {r.node: r.root for r in least_reachable(chain, "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[102] == roots[101] == 100
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(33)] + [(50, 999)], "n long, p long")
    top = {r.node: r.root for r in follow(parents, "n", "p").collect()}
    assert set(top[i] for i in range(33)) == {0} and top[50] == 50


def test_diff_scd2_in_force_and_as_of(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", None), ("d", 4)], "k string, v int")
    assert {(r.k, r.change) for r in diff(old, new, "k", "v").collect()} == {("a", "removed"), ("b", "amended"), ("d", "added")}
    day = lambda n: dt.datetime(2024, 1, n)
    rows = scd2(spark.createDataFrame([("x", 1, day(1)), ("x", 2, day(5)), ("y", 3, day(2))], "r string, i int, valid_from timestamp"), "r", "valid_from", "i")
    assert {r.i for r in in_force(rows, F.lit(day(5))).collect()} == {2, 3}
    facts = spark.createDataFrame([("x", 1, day(4)), ("x", 2, day(5)), ("z", 3, day(9))], "r string, f int, at timestamp")
    found = as_of(facts, rows.select("r", "i", "valid_from"), "r", "at", "valid_from", "i", ["i"])
    assert {(r.f, r.g_i) for r in found.collect()} == {(1, 1), (2, 2), (3, None)}


def test_html_blocks():
    html = "<html><nav>menu</nav><body><h1>Title</h1><p>one<p>two <b>bold</b><script>var t='</p>';</script><ul><li>a<li>b</ul></body></html>"
    assert readers.blocks_of(html) == [("h1", "Title"), ("p", "one"), ("p", "two bold"), ("li", "a"), ("li", "b")]
    assert readers.blocks_of("") == []


def test_local_files_stay_below_their_root(spark, tmp_path):
    inside = tmp_path / "root"
    inside.mkdir()
    (inside / "a.txt").write_text("x")
    assert readers.local_files(spark, str(inside), str(inside)).count() == 1
    with pytest.raises(ValueError):
        readers.local_files(spark, str(tmp_path), str(inside))


def test_release_and_artifact_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, body string")
    readers.store_artifacts(df, "body", str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    readers.publish(df, str(tmp_path / "out"), "r1")
    assert spark.read.json(str(tmp_path / "out/r1/manifest")).first()["rows"] == 3
