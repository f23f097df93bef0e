"""The pipeline and the queries on the smallest tables."""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lexloom.llm import decontaminate, encoders, queries, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SF_DIR}/{f}')")
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    result = con.sql(queries.ORACLE[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(r[i] for i in at) for r in result.fetchall())


def test_pipeline_against_brute_force(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    rejected = {r.doc_id for r in toxicity.toxicity(spark, docs, queries.table(spark, SF_DIR, "labels")).where("rejected").collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in rejected}
    seen: dict = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in seen.values()}
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = {i: t for i, t in left.items() if find(i) == i}
    items = [decontaminate.shingle_set(r.text, 5) for r in queries.table(spark, SF_DIR, "benchmark").collect()]
    clean = {i: t for i, t in left.items() if not any(q and 10 * len(q & decontaminate.shingle_set(t, 5)) >= 8 * len(q) for q in items)}
    assert set(got) == set(clean)
    order = sorted(clean)
    t = encoders.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for i in order:
        ids = t.encode(clean[i], add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))


TABLES = {"labels": "doc_id long, quality long, toxic long", "benchmark": "item_id long, text string"}


@pytest.mark.parametrize("kind", ["odd", "empty", "nobody left"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """Null and repeated rows, columns that clash with the stages' own, no labels and no items; no documents; none that is kept."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a b", "x", 1, "m"), (1, "a b", "x", 1, "m"), (1, "other words", None, None, None), (None, None, None, None, None), (None, "no id", "x", 2, "m"), (None, words, "x", 2, "m"), (7, words + " end", "x", 2, "m"), (8, "", "x", 2, "m"), (9, "x" * 50_000, "x", 2, "m")]
    data = {"documents": rows if kind == "odd" else [] if kind == "empty" else [(i, words, "x", 1, "m") for i in range(4)], "labels": [], "benchmark": [(1, words)] if kind == "nobody left" else []}
    schemas = TABLES | {"documents": "doc_id long, text string, digest string, mark long, member string"}
    for name, schema in schemas.items():
        spark.createDataFrame(data[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind != "odd":
        assert got == []
        return
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in schemas["documents"].split(", ")], name
    left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    # null equals empty, and id 7 with all its words stays before a row without an id
    assert left == sorted([(1, "a b"), (1, "other words"), (None, None), (None, "no id"), (7, words + " end"), (9, "x" * 50_000)], key=str)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got)[0][0] == -1 and len(got) == len(left)


@pytest.mark.parametrize(("name", "path"), [("op4_token_shards", "word_bpe_49k.json"), ("op5_token_counts", "word_bpe_49k.json"), ("op9_bpe_round_trip", "byte_bpe_50k.json")])
def test_token_queries_against_the_library(spark, name, path):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF_DIR, "documents").collect()}
    t, start = encoders.tokenizer(queries.tokenizer_path(path)), 0
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF_DIR).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids, r = t.encode(texts[i], add_special_tokens=False).ids, got[i]
        raw = lambda x: np.array(x, "<u4").tobytes()
        if name == "op4_token_shards":
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(raw([*ids, 1])))
            start += len(ids) + 1
        elif name == "op5_token_counts":
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[i].encode()), len(ids), len(ids) > 2048)
        else:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_stages_keep_the_columns_of_documents(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns, name
