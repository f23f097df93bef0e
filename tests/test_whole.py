"""Queries take in all rows, also those that the SQL beside them leaves out; compared with brute force."""

from __future__ import annotations

import os
import random
import re

import duckdb
import pandas as pd
import pytest

from lexloom import registry
from lexloom.functions import text as tx
from lexloom.operators import similarity

QUERIES = registry.queries()


def got(spark, sf_dir, name):
    df = QUERIES[name](spark, str(sf_dir))
    columns = sorted(df.columns)
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def words(text):
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 2 and w not in tx.DUTY_STOP}


def score(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """Short ones, long ones (near copies among them) and one of unknown length."""
    def text(k, n, odd=()):
        return " ".join(f"word{k}x{i}" for i in range(n)) + " " + " ".join(odd)

    texts = [
        ("de", "s0", text(1, 20)), ("de", "s1", text(1, 20)), ("de", "s0", text(2, 700)), ("de", "s1", text(2, 700, ["other"])), ("de", "s2", text(2, 690)),
        ("de", "s2", text(3, 500)), ("en", "s0", text(3, 500)), ("en", "s1", text(3, 350)), ("en", "s1", text(4, 30)), ("en", "s0", text(4, 30)),
        ("en", "s0", text(5, 400) + " the licence terms"), ("en", "s1", text(6, 5) + " " + text(5, 400) + " the licence terms for " + text(7, 9)), ("fr", "s1", "licence of use"), ("fr", "s0", "no licence"),
    ]
    folder = tmp_path_factory.mktemp("documents")
    rows = pd.DataFrame([(i, t, lang, source, None if i == 9 else len(t)) for i, (lang, source, t) in enumerate(texts)], columns=["doc_id", "text", "lang", "source", "n_chars"])
    assert (rows.n_chars > 3000).sum() >= 6
    rows.astype({"n_chars": "Int64"}).to_parquet(folder / "documents.parquet")
    return folder, rows


def alike(rows, least, when):
    r = list(rows.itertuples())
    return {(a.doc_id, b.doc_id): score(words(a.text), words(b.text)) for a in r for b in r if a.doc_id < b.doc_id and when(a, b) and score(words(a.text), words(b.text)) >= least}


def test_duplicates_of_all_documents(spark, documents):
    folder, rows = documents
    same = lambda a, b: a.lang == b.lang
    near, close = alike(rows, 0.92, same), alike(rows, 0.8, same)
    assert {(2, 3), (8, 9)} <= set(near)
    assert got(spark, folder, "d26_word_jaccard") == sorted((a, b, round(s, 6)) for (a, b), s in close.items())
    assert got(spark, folder, "d27_duplicate_pairs") == sorted(near)
    root = {i: i for p in near for i in p}
    for _ in root:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert got(spark, folder, "d28_canonical_duplicates") == sorted((c, i) for i, c in root.items())
    assert got(spark, folder, "d29_duplicate_rate") == [(len({b for _, b in near}) / len(rows),)]


def test_equivalences_of_all_documents(spark, documents):
    folder, rows = documents
    assert got(spark, folder, "d30_equivalences_across_sources") == sorted(alike(rows, 0.6, lambda a, b: a.source != b.source))


def test_licensing_clauses_of_all_documents(spark, documents):
    folder, rows = documents
    held = [r for r in rows.itertuples() if "licen" in r.text.lower()]
    want = sorted((a.doc_id,) for a in held if not any(b.doc_id != a.doc_id and len(b.text) < len(a.text) and b.text in a.text for b in held))
    assert (10,) in want and (11,) not in want
    assert got(spark, folder, "g22_licensing_clauses") == want


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SMALL}/{f}')")
    return con


def test_checks_leave_no_rows_out():
    """The SQL beside a query reads the tables that the query reads."""
    for name, sql in registry.oracle_sql().items():
        assert not re.search(r"(n_chars|c_custkey|o_custkey|profile_id|item_id|vec_id) < \d", sql), name


@pytest.mark.parametrize("seed", range(3))
def test_links_are_the_greedy_ones(spark, seed):
    rng = random.Random(seed)
    scored = [(a, 100 + b, rng.randrange(6, 11) / 10) for a in range(12) for b in range(12) if rng.random() < 0.5]
    used, want = set(), []
    for a, b, x in sorted(scored, key=lambda r: (-r[2], r[0], r[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.append((a, b, x))
    found = similarity.link_one_to_one(spark.createDataFrame(scored, "a long, b long, score double"), "a", "b").collect()
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert similarity.link_one_to_one(spark.createDataFrame([], "a long, b long, score double"), "a", "b").count() == 0


def test_supersessions(spark, duck):
    parts: dict = {}
    for order, part, status in duck.sql("select l_orderkey, l_partkey, l_linestatus from lineitem").fetchall():
        parts.setdefault((status, order), set()).add(part)
    old, new = ([(o, w) for (s, o), w in parts.items() if s == status] for status in "FO")
    by_part: dict = {}
    for n, w in new:
        for p in w:
            by_part.setdefault(p, []).append((n, w))
    scored = {(o, n): len(w & x) / min(len(w), len(x)) for o, w in old for p in w for n, x in by_part.get(p, []) if o < n}
    used, want = set(), []
    for o, n in sorted((k for k, x in scored.items() if x >= 0.6), key=lambda k: (-scored[k], k)):
        if ("o", o) not in used and ("n", n) not in used:
            used |= {("o", o), ("n", n)}
            want.append((n, o, scored[o, n]))
    assert got(spark, SMALL, "d38_link_supersessions") == sorted(want) and want


def test_every_customer_is_composed(spark, duck):
    ordering = {r[0] for r in duck.sql("select distinct o_custkey from orders join lineitem on l_orderkey = o_orderkey").fetchall()}
    assert len(ordering) > 40
    picks = QUERIES["p01_minimise"](spark, SMALL).toPandas()
    assert set(picks.profile_id) == ordering
    supplied = duck.sql("select distinct o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey").fetchall()
    by_part: dict = {}
    for part, block in duck.sql("select distinct l_partkey, l_suppkey from lineitem").fetchall():
        by_part.setdefault(part, set()).add(block)
    chosen = picks.groupby("profile_id")["block_id"].agg(set).to_dict()
    assert all(chosen[c] & by_part[p] for c, p in supplied)


def test_pairs_meet_their_sets_in_turns(spark, documents, monkeypatch):
    """As many turns as there are pairs for a set: none is lost between them."""
    _, rows = documents
    monkeypatch.setattr(similarity, "SETS", 1)
    monkeypatch.setattr(similarity, "kept", lambda df, keep=similarity.kept: turns.append(1) or keep(df))
    turns = []
    some = [(i, f"{' '.join(f'word{j}' for j in range(20))} other{i}") for i in range(9)]
    found = similarity.similar_pairs(spark.createDataFrame(some, "doc_id long, text string"), "doc_id", tx.duty_words(tx.F.col("text")), 0.5)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(9) for b in range(a + 1, 9)]
    assert len(turns) == 6 + 4  # 36 pairs of nine sets
