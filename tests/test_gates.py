"""Every gate is green on sound input and red on each fault that it is there to find."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from lexloom.operators import evals


def rows(df):
    return [r.asDict() for r in df.collect()]


def one(df):
    (r,) = rows(df)
    return r


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_fidelity(spark):
    spans = frame(spark, "k int, span string", (1, "Each carrier must report"), (1, "within  two days"), (1, "***"), (2, "a lost one"), (3, None))
    trees = frame(spark, "k int, text string", (1, "x Each carrier\nmust report within two days"), (3, "y"))
    got = {r["k"]: r for r in rows(evals.fidelity(spans, trees, "k"))}
    assert got[1]["passed"] and got[1]["score"] == 1 and got[1]["missing"] == 0
    assert not got[2]["passed"] and got[2]["score"] == 0 and got[2]["missing"] == 1
    assert got[3]["passed"]
    cut = frame(spark, "k int, text string", (1, "Each carrier must report"))
    assert not {r["k"]: r for r in rows(evals.fidelity(spans, cut, "k"))}[1]["passed"]
    assert {r["k"]: r for r in rows(evals.fidelity(spans, cut, "k", 0.5))}[1]["passed"]


def test_strides(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2 + F.when(F.col("id") < 20, 2).otherwise(0)).alias("g"))
    n = {r["g"]: r["n"] for r in rows(evals.strided(df, "g", "id").groupBy("g").agg(F.count("*").alias("n")))}
    assert n[2] == n[3] == 10 and n[0] == n[1] and 50 <= n[0] <= 60


def test_round_trip(spark):
    texts = frame(spark, "k int, text string", (1, "one\ntwo"))
    good = frame(spark, "k int, start_ int, end_ int, text string", (1, 0, 3, "one"), (1, 4, 7, "two"))
    assert one(evals.round_trip(good, texts, "k"))["passed"]
    for bad in ((1, 5, 7, "two"), (1, 4, 7, "Two"), (2, 0, 3, "one")):
        assert not all(r["passed"] for r in rows(evals.round_trip(good.union(frame(spark, "k int, start_ int, end_ int, text string", bad)), texts, "k")))


def test_changes_and_their_replay(spark):
    old, new = frame(spark, "ref string, body int", ("a", 1), ("b", 2), ("c", None), ("d", 4)), frame(spark, "ref string, body int", ("a", 1), ("b", 3), ("c", None), ("e", 5))
    found = evals.changes(old, new, ["ref"], "body")
    kinds = {r["ref"]: r["kind"] for r in rows(found)}
    assert kinds == {"a": "unchanged", "b": "amended", "c": "unchanged", "d": "removed", "e": "added"}
    recorded = frame(spark, "ref string, kind string", ("b", "amended"), ("d", "removed"), ("e", "added"))
    assert one(evals.change_replay(recorded, found, ["ref"])) == {"recorded": 3, "replayed": 3, "missing": 0, "extra": 0, "passed": True}
    assert one(evals.change_replay(recorded.where("ref <> 'd'"), found, ["ref"]))["missing"] == 1
    assert one(evals.change_replay(recorded.union(frame(spark, "ref string, kind string", ("a", "amended"))), found, ["ref"]))["extra"] == 1
    right = one(evals.accuracy(found, found, ["ref"]))
    assert right["passed"] and right["accuracy"] == 1
    wrong = one(evals.accuracy(found.where("ref <> 'a'"), found, ["ref"]))
    assert not wrong["passed"] and wrong["right"] == 4
    assert not one(evals.accuracy(found.limit(0), found.limit(0), ["ref"]))["passed"]


def test_provenance(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = frame(spark, "g string, t string, h string", ("a", "x", sha("x")), ("b", "y", sha("z")), ("c", "y", None), ("d", None, sha("")))
    assert {r["g"]: r["passed"] for r in rows(evals.provenance(kept, "g", "t", "h"))} == {"a": True, "b": False, "c": False, "d": False}


def test_hits(spark):
    golden = frame(spark, "query_id int, doc_id int", (1, 10), (1, 11), (2, 20))
    ranked = frame(spark, "query_id int, doc_id int, place int", (1, 11, 5), (2, 20, 6))
    assert one(evals.hits_at(golden, ranked)) == {"queries": 2, "hits": 1, "score": 0.5, "passed": False}
    assert one(evals.hits_at(golden, ranked, k=6))["passed"]
    assert one(evals.hits_at(golden.limit(0), ranked)) == {"queries": 0, "hits": 0, "score": None, "passed": False}


def test_boundaries(spark):
    golden, parsed = frame(spark, "k int, u int", (1, 1), (1, 2), (2, 1)), frame(spark, "k int, u int", (1, 1), (1, 2), (1, 2), (2, 9), (3, 1))
    got = {r["k"]: r for r in rows(evals.boundary_f1(golden, parsed, "k", "u"))}
    assert got[1]["f1"] == 1 and got[1]["passed"] and got[2]["f1"] == 0 and not got[2]["passed"] and got[3]["precision_"] == 0
    assert not one(evals.suite(evals.boundary_f1(golden, parsed, "k", "u"), "f1", 0.98))["passed"]
    assert one(evals.suite(evals.boundary_f1(golden, golden, "k", "u"), "f1", 0.98)) == {"documents": 2, "mean": 1.0, "passed": True}
    assert not one(evals.suite(evals.boundary_f1(golden.limit(0), golden.limit(0), "k", "u"), "f1", 0.98))["passed"]


def test_confusion(spark):
    judged = frame(spark, "s boolean, t boolean", *[(True, True)] * 3, (True, False), (False, True), (None, None))
    assert one(evals.confusion(judged, "s", "t")) == {"tp": 3, "fp": 1, "fn": 1, "precision_": 0.75, "recall_": 0.75, "passed": True}
    assert not one(evals.confusion(judged, "s", "t", least_precision=0.8))["passed"]
    assert not one(evals.confusion(judged, "s", "t", least_recall=0.8))["passed"]
    assert not one(evals.confusion(judged.limit(0), "s", "t"))["passed"]


def test_coverage_and_ends(spark):
    wanted, have = frame(spark, "g string, k int", ("a", 1), ("a", 2), ("b", 3), ("b", None)), frame(spark, "k int", (1,), (2,), (2,), (3,), (None,))
    got = {r["g"]: r for r in rows(evals.coverage(wanted, have, "k", "g"))}
    assert got["a"]["passed"] and got["a"]["share"] == 1 and got["b"]["covered"] == 1 and not got["b"]["passed"]
    assert one(evals.coverage(wanted, have, "k", least=0.75))["passed"]
    ends = {r["edge"]: r for r in rows(evals.dangling({"x": wanted.where("g = 'a'"), "y": wanted}, have, "k"))}
    assert ends["x"]["passed"] and ends["y"]["dangling"] == 1 and not ends["y"]["passed"]


def test_concepts(spark):
    run = "one two three four five six seven eight"
    concepts = frame(spark, "concept string, text string", ("a", run + " nine"), ("b", run), ("c", "short"), ("d", None))
    members = frame(spark, "concept string, member int, text string", ("a", 1, "zero " + run.upper()), ("a", 2, "own words"), ("b", 3, run[4:]), ("d", 4, run))
    got = {r["concept"]: (r["members"], r["leaks"], r["passed"]) for r in rows(evals.concept_integrity(concepts, members))}
    assert got == {"a": (2, 1, False), "b": (1, 0, True), "c": (0, 0, False), "d": (1, 0, True)}


def test_lint(spark):
    schema = "k int, kind string, ref string, label string, text string"
    assert rows(evals.lint(frame(spark, schema, (1, "clause", "a", "1.", "Text"), (1, "clause", "b", None, "Text"), (1, "note", None, "", "Text"), (2, "clause", "a", "", "x")), "k")) == []
    found = rows(evals.lint(frame(spark, schema, (1, "clause", "a", "", "x"), (1, "clause", "a", "", "y"), (1, "clause", None, "", "z"), (2, "clause", "c", "1.", " 1. Text")), "k"))
    assert sorted((r["k"], r["ref"], r["problem"], r["n"]) for r in found if r["ref"]) == [(1, "a", "duplicate ref", 2), (2, "c", "label repeated", 1)]
    assert [(r["k"], r["problem"]) for r in found if not r["ref"]] == [(1, "no ref")]


def test_projections(spark):
    schema = "k int, pos int, text string"
    whole = frame(spark, schema, (1, 0, "a"), (1, 1, "b"), (2, 0, None))
    assert all(r["passed"] for r in rows(evals.reread(whole, whole, "k")))
    for other in (whole.where("pos = 0"), whole.withColumn("text", F.upper("text")), whole.union(frame(spark, schema, (3, 0, "c")))):
        assert not all(r["passed"] for r in rows(evals.reread(whole, other, "k")))
    assert one(evals.bijection(whole, whole, ["k", "pos"]))["passed"]
    assert one(evals.bijection(whole, whole.union(whole.limit(1)), ["k", "pos"]))["twice"] == 1
    lost = one(evals.bijection(whole, whole.where("pos = 0"), ["k", "pos"]))
    assert (lost["both"], lost["only_left"], lost["only_right"], lost["passed"]) == (2, 1, 0, False)
    assert one(evals.same_rows(whole, whole))["passed"]
    assert one(evals.same_rows(whole.union(whole.limit(1)), whole)) == {"missing": 0, "extra": 1, "passed": False}


def test_rates_and_numbers(spark):
    everything = spark.range(100)
    assert one(evals.duplicate_rate(everything.limit(0), everything, "id"))["passed"]
    assert not one(evals.duplicate_rate(everything.limit(1), everything, "id"))["passed"]
    assert not one(evals.duplicate_rate(everything.limit(0), everything.limit(0), "id"))["passed"]
    told = frame(spark, "k int, t string, ok array<string>", (1, "7 of 12,500 units", ["7", "12500"]), (2, "7 of 8", ["7"]), (3, None, []))
    assert {r["k"]: (r["stated"], r["foreign"], r["passed"]) for r in rows(evals.numbers_echo(told, "k", "t", F.col("ok")))} == {1: (2, 0, True), 2: (2, 1, False), 3: (0, 0, True)}
    edges = frame(spark, "obligation_id int, block_id int", (1, 1), (1, 2), (2, 2))
    assert one(evals.reuse(edges)) == {"reuse": 1.5, "explosion": False}
    assert one(evals.reuse(edges, most=0.5))["explosion"]


def test_noise_is_keyed(spark):
    from lexloom.operators.risk import noised

    counts = frame(spark, "c string, b int, n long", *[(f"c{i % 7}", i, 100) for i in range(400)], (None, 1, 100))
    first = {(r["c"], r["b"]): r["noised"] for r in rows(noised(counts, ["c", "b"], "s", 0.5))}
    again = {(r["c"], r["b"]): r["noised"] for r in rows(noised(counts.repartition(5), ["c", "b"], "s", 0.5))}
    other = {(r["c"], r["b"]): r["noised"] for r in rows(noised(counts, ["c", "b"], "t", 0.5))}
    assert first == again and sum(first[k] == other[k] for k in first) == 0
    apart = [abs(x - 100) for x in first.values()]
    assert 1.6 < sum(apart) / len(apart) < 2.4  # the mean of |Laplace| is its scale
