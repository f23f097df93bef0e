"""Groups of copies, hubs and products: what meets what, and odd rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lexloom import registry
from lexloom.functions import text as tx
from lexloom.operators import retrieval, similarity

QUERIES = registry.queries()


def tables(folder, **frames):
    for name, frame in frames.items():
        frame.to_parquet(folder / f"{name}.parquet")
    return str(folder)


def got(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parts(n, **more):
    return pd.DataFrame({"p_partkey": range(n), "p_name": "a b", "p_brand": "Brand#1", "p_type": "SMALL", "p_size": 1, "p_retailprice": 1.0} | more)


def customers(rows):
    return pd.DataFrame([(k, n, "BUILDING", 1.0) for k, n in rows], columns=["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]).astype({"c_nationkey": "Int64"})


@pytest.fixture
def copies(tmp_path):
    """Thirty copies, two near copies of them, a pair of copies and rows without words or language."""
    text = " ".join(f"word{i}" for i in range(40))
    texts = [("en", text)] * 30 + [("en", text + " other"), ("en", text + " another"), ("en", "nothing alike here"), ("en", "here alike nothing"), ("en", ""), (None, text), ("de", text)]
    rows = pd.DataFrame([(i, t, lang, "s0", len(t)) for i, (lang, t) in enumerate(texts)], columns=["doc_id", "text", "lang", "source", "n_chars"])
    return tables(tmp_path, documents=rows)


def test_copies_meet_by_their_representative(spark, copies):
    members, linked = similarity.similar_classes(spark.read.parquet(f"{copies}/documents.parquet"), "doc_id", tx.duty_words(similarity.F.col("text")), 0.92, "lang")
    rep = {r.k: r.rep for r in members.collect()}
    assert rep == {i: 0 for i in range(30)} | {30: 30, 31: 31, 32: 32, 33: 32, 36: 36}
    assert sorted((r.a, r.b) for r in linked.collect()) == [(0, 30), (0, 31), (30, 31)]


def test_all_pairs_of_copies_are_returned(spark, copies):
    pairs = {(a, b) for a in range(32) for b in range(a + 1, 32)} | {(32, 33)}
    assert set(got(spark, copies, "d27_duplicate_pairs")) == pairs
    scores = {r[:2]: r[2] for r in got(spark, copies, "d26_word_jaccard")}
    assert set(scores) == pairs and scores[0, 1] == 1.0 and scores[0, 30] == round(40 / 41, 6) and scores[30, 31] == round(40 / 42, 6)


def test_rates_and_components_without_pairs(spark, copies):
    rate = 32 / 37
    assert got(spark, copies, "d29_duplicate_rate") == [(rate,)]
    assert got(spark, copies, "m16_duplicate_rate") == [(False, rate)]
    assert got(spark, copies, "d28_canonical_duplicates") == sorted([(0, i) for i in range(32)] + [(32, 32), (32, 33)], key=str)
    assert similarity._doubled(spark, copies).count() == 32


def test_sweep_is_no_null_aware_join(spark, tmp_path):
    line = pd.DataFrame({"l_orderkey": [1, 1], "l_partkey": [2, 99], "l_suppkey": [5, 7], "l_quantity": [1.0, 1.0]})
    sf = tables(tmp_path, part=parts(12), supplier=pd.DataFrame({"s_suppkey": [5, 6, 7], "s_name": "x", "s_nationkey": 1, "s_acctbal": 1.0}), lineitem=line)
    df = QUERIES["r19_graph_sweep"](spark, sf)
    assert sorted(r.node for r in df.collect()) == ["BLK/6", "BLK/7"]
    assert "isnull((node" not in joins(df).lower()  # NOT IN is broadcast whole


def test_digest_counts_duties_before_profiles(spark, tmp_path):
    sf = tables(tmp_path, part=parts(60, p_brand=["Brand#1", "Brand#9"] * 30), customer=customers([(1, 0), (2, 3), (3, None), (4, 24)]))
    assert got(spark, sf, "n09_watch_digest") == [(0, 0, 3), (0, 1, 2), (0, 1, 4), (1, 2, 1)]
    assert "% 25" not in joins(QUERIES["n09_watch_digest"](spark, sf)).split("Join")[1].splitlines()[0]


def test_concepts_are_counted_before_profiles(spark, tmp_path):
    sf = tables(tmp_path, part=parts(150, p_brand=["Brand#1", None] * 75), customer=customers([(1, 0), (2, 3), (3, None)]))
    assert set(got(spark, sf, "d35_resolve_concept")) == {(c, f, p, s) for c, p, f, s in [("Brand#1", 1, 3, "covered"), (None, 1, 3, "covered"), ("Brand#1", 2, 3, "covered"), (None, 2, 3, "covered"), ("Brand#1", 3, 0, "uncovered"), (None, 3, 0, "uncovered")]}
    assert "Aggregate" in joins(QUERIES["d35_resolve_concept"](spark, sf)).split("Join Cross")[-1]


def test_questions_are_counted_before_profiles(spark, tmp_path):
    sf = tables(tmp_path, part=parts(20, p_size=[1, 2] * 10), customer=customers([(1, 0), (2, 3)]))
    assert got(spark, sf, "p07_open_questions") == [("condition", 4, 1, "fact-2"), ("condition", 4, 2, "fact-1")]
    assert "Aggregate" in joins(QUERIES["p07_open_questions"](spark, sf)).split("Join Cross")[-1]


def test_duplicate_names_meet_the_first_only(spark, tmp_path):
    sf = tables(tmp_path, part=parts(50, p_name=["a b"] * 40 + ["c"] * 9 + [None]))
    assert got(spark, sf, "f13_model_duplicate_names") == sorted([(0, i) for i in range(1, 40)] + [(40, i) for i in range(41, 49)], key=str)
    assert "Aggregate [p_type" in joins(QUERIES["f13_model_duplicate_names"](spark, sf)).split("Join")[1]


def test_verdicts_are_spread_from_classes(spark, tmp_path):
    from lexloom.operators import applicability

    sf = tables(tmp_path, part=parts(120), customer=customers([(k, k % 3) for k in range(12)]))
    patterns, states = applicability._judged(spark, sf)
    slow = sorted(tuple(r) for r in patterns.join(applicability.judge(states), "pattern").select("obligation_id", "profile_id", "verdict").collect())
    assert sorted(got(spark, sf, "g12_applicability")) == slow
    assert "map_from_entries" not in joins(QUERIES["g12_applicability"](spark, sf))


def test_nearest_by_products_in_blocks(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)] if i % 9 else [1.0, 1.0, 1.0, 1.0]) for i in range(200)] + [(200, None), (201, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = retrieval._vector_queries(v.where("vec_id < 200"))
    one = sorted(map(tuple, retrieval.nearest(v, "vec_id", "embedding", q, 5).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "SCORES", 16)
    assert one == sorted(map(tuple, retrieval.nearest(v, "vec_id", "embedding", q, 5).collect()))
    norm = lambda x: sum(y * y for y in x) ** 0.5
    for k, e in [(k, e) for k, e in rows[:200] if k % 20 == 0]:
        scored = sorted((-round(sum(a * b for a, b in zip(e, w, strict=True)) / norm(e) / norm(w), 6), i) for i, w in rows[:200] if norm(w))
        assert [(i, p) for _, i, _, p in sorted((r for r in one if r[0] == k), key=lambda r: r[3])] == [(i, p + 1) for p, (_, i) in enumerate(scored[:5])]


def test_citations_meet_lists_of_duties(spark, tmp_path):
    """The result is spread last: nothing of its size is joined or shuffled again; a citation that occurs twice is one."""
    orders = [(k, c) for k in range(1, 30) for c in (1, 26, 2)][:60] + [(4, 7)]
    parts = [(i, 1 + i % 9) for i in range(1, 2600)]
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey"]).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame(parts, columns=["p_partkey", "p_size"]).to_parquet(tmp_path / "part.parquet")
    df = registry.queries()["j11_resolve_citation"](spark, str(tmp_path))
    plan = [x.strip(" +-:") for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert next(x for x in plan if not x.startswith("Project")).startswith("Generate explode(ids")
    con = duckdb.connect()
    for name in ("orders", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute(registry.oracle_sql()["j11_resolve_citation"]).fetchall()
    assert sorted(map(tuple, df.select("cite_id", "obligation_id", "confidence").collect())) == sorted(want) and want


def test_spreading_is_dealt_by_the_rows_of_the_result(spark, tmp_path, monkeypatch):
    """Profiles alone are few bytes, which adaptive execution would leave to one task."""
    from lexloom.operators import applicability

    monkeypatch.setattr(applicability, "SPREAD", 100, raising=False)
    sf = tables(tmp_path, part=parts(120), customer=customers([(k, k % 3) for k in range(60)]))
    df = QUERIES["g12_applicability"](spark, sf)
    sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 60 * 96 and len(sizes) > 20 and max(sizes) <= 6 * 96


def test_duties_of_a_profile_are_spread_last(spark, tmp_path):
    """What the result has of a duty lies in the list of its class: no row of the result is joined, and stale duties and repeated ones are as in SQL."""
    sf = tables(tmp_path, part=pd.concat([parts(120), parts(24, p_brand="Brand#2")]), customer=customers([(k, k % 3) for k in range(12)]))
    df = QUERIES["g13_obligations_for_profile"](spark, sf)
    plan = [x.strip(" +-:") for x in joins(df).splitlines()]
    assert next(x for x in plan if not x.startswith("Project")).startswith("Generate explode(duties")
    con = duckdb.connect()
    for name in ("part", "customer"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute(registry.oracle_sql()["g13_obligations_for_profile"]).fetchall()
    assert sorted(map(tuple, df.select("profile_id", "stable_id", "source_key").collect())) == sorted(want) and want
