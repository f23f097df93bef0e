"""Strings that collide under every polynomial modulo 2^64, and hashes that are made to collide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe_words, encoders, line_dedup, ngram_join, queries, sstable, store, substring_dedup, token_counts
from lexloom.llm import textkit as tk

WORD_JSON, BYTE_JSON = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")


def thue_morse(n: int, a: str = "a", b: str = "b", space: str = "") -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return space.join((a, b)[x] for x in bits), space.join((b, a)[x] for x in bits)


LONG = [w for n in (512, 1024, 2048) for w in thue_morse(n)]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_slices_and_windows_differ():
    buf, off = tk.column(pa.array(LONG))
    s, e, _ = tk.spans(buf, off)
    for which in (0, 1):
        assert len(set(tk.slice_hashes(buf, s, e, which=which).tolist())) == len(LONG)
    for n in (64, 1024, 2048):
        buf, off = tk.column(pa.array(thue_morse(n, "x", "y", " ")))
        s, e, first = tk.spans(buf, off)
        h, ok = tk.windows(tk.slice_hashes(buf, s, e), first, n)
        assert len(set(h[ok].tolist())) == 2


@pytest.mark.parametrize("path", [WORD_JSON, BYTE_JSON])
@pytest.mark.parametrize("same_hash", [False, True])
def test_units_are_told_apart_by_their_bytes(monkeypatch, path, same_hash):
    if same_hash:
        monkeypatch.setattr(tk, "slice_hashes", lambda buf, s, e, *a, **k: (e - s).astype(np.uint64) % np.uint64(3))
    texts = [*LONG, "one two three one", "", "six ten one", "a　b c", *LONG[::-1]]
    encoder = encoders.Encoder(path, remembered=500 if same_hash else 1 << 20)
    for part in (texts, texts[::-1], texts):
        ids, bounds = encoder.encode(*tk.column(pa.array(part)))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == encoders.plain(path, part)


@pytest.mark.parametrize("path", [WORD_JSON, BYTE_JSON])
def test_token_operators(spark, path):
    texts = [*LONG, " ".join(LONG), None, "plain words"]
    docs, ids = documents(spark, texts), encoders.plain(path, [t or "" for t in texts])
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path, chunk=700, overlap=32).collect()} == {i: len(x) for i, x in enumerate(ids)}
    assert {r.doc_id: r.n_tokens for r in sstable.token_table(spark, docs, path, end_id=None).collect()} == {i: len(x) for i, x in enumerate(ids)}
    shards = sstable.write_shards(spark, docs, path, store.work_dir(spark, "t"), end_id=None).collect()
    assert {k: v.tolist() for s in shards for k, v in sstable.Reader(s.uri)} == dict(enumerate(ids))
    if path == BYTE_JSON:
        found = bpe_words.round_trip(spark, docs, path).collect()
        assert {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in found} == {i: (x, texts[i] or "") for i, x in enumerate(ids)}


def test_lines_that_only_seem_equal_stay(spark):
    a, b = thue_morse(1024)
    docs = documents(spark, [a, a, a, a, a, b, f"{b}\nx"])
    got = {r.doc_id: (r.n_dropped, r.kept) for r in line_dedup.deduplicated(spark, docs).collect()}
    assert got == {**{i: (1, "") for i in range(4)}, 4: (0, a), 5: (0, b), 6: (0, f"{b}\nx")}


def test_texts_that_only_seem_alike_are_not_linked(spark):
    a, b = thue_morse(2048)
    docs = documents(spark, [a, b, a, *thue_morse(1024, "one", "two", " ")])
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark, docs, words=3, threshold=0.9).collect()}
    assert (got[0], got[1], got[2]) == (0, 1, 0)


def test_a_digest_that_two_sets_share_is_taken_anew(spark, monkeypatch):
    plain = ngram_join._digests
    monkeypatch.setattr(ngram_join, "_spread", lambda u, salt, f=ngram_join._spread: f(u, salt) if salt else np.zeros(len(u), np.uint64))
    assert plain is ngram_join._digests
    docs = documents(spark, ["a b c d e", "f g h i j", "a b c d e", "k l"])
    got = sorted(tuple(r) for r in ngram_join.classes(spark, docs, words=3, threshold=0.9).collect())
    assert got == [(0, 3, 0), (1, 3, 1), (2, 3, 0), (3, 1, 3)]


def test_passages_that_only_seem_equal_stay(spark):
    a, b = thue_morse(1024)
    words = [f"w{i}" for i in range(60)]
    one, two = words[:30] + [a] + words[31:], words[:30] + [b] + words[31:]
    runs = thue_morse(64, "p", "q", " ")
    docs = documents(spark, [" ".join(one), " ".join(two), *runs])
    got = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(spark, docs, window=50).collect()}
    lists = [one, two, *(r.split() for r in runs)]
    first: dict = {}
    for i, w in enumerate(lists):
        gone = set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone.update(range(j, j + 50))
        assert got[i] == len(gone)
    assert got[1] == 0


def test_rows_without_an_id_keep_none(spark):
    line = "a line of more than forty code points, which several documents have"
    docs = spark.createDataFrame([(None, line), (None, line), (-(2**63), line), (1, line), (2, f"{line}\nown")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_dropped) for r in line_dedup.deduplicated(spark, docs, min_docs=3).collect()), key=str) == sorted([(None, 1), (None, 1), (-(2**63), 1), (1, 1), (2, 0)], key=str)
    passage = " ".join(f"w{i}" for i in range(55))
    docs = spark.createDataFrame([(None, passage), (3, passage), (4, "few words")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(spark, docs).collect()} == {None: 0, 3: 55, 4: 0}
    assert docs.where(F.col("doc_id").isNull()).count() == 1


@pytest.mark.parametrize("path", [WORD_JSON, BYTE_JSON, queries.tokenizer_path("piece_bpe_32k.model")])
def test_overlaps_align_at_once_on_plain_text(monkeypatch, path):
    """Chunks end inside words; nothing is encoded twice but the overlaps."""
    seen = []

    class Counted(token_counts.Tokens):
        def __init__(self, path, text, base):
            seen.append(len(text))
            super().__init__(path, text, base)

    monkeypatch.setattr(token_counts, "Tokens", Counted)
    text = " ".join(f"word{i * 7919 % 1000} it's 12.{i % 90}" for i in range(4000))
    assert token_counts.count_long(path, text, 2000, 100) == token_counts.counts_of(path, [text])[0]
    assert sum(seen) < 1.1 * len(text) and len(seen) > 20


def test_overlapping_buckets_are_met_once(spark, monkeypatch):
    """Texts that are alike but seldom linked share many buckets that stay open: these are united, and every link is found."""
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in range(150)]
    texts = []
    for i in range(80):
        w = list(base)
        for at in rng.choice(150, 1 if i % 20 == 0 else 5, replace=False):
            w[at] = f"other{i}x{at}"
        texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    least = list(range(len(sets)))
    for _ in sets:  # the least document that links reach
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    least[i] = min(least[i], least[j])
    rows, plain = {}, ngram_join.written

    def counted(df, path):
        out = plain(df, path)
        if path.endswith("/active"):
            rows[int(path.split("/round-")[1].split("/")[0])] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark, docs, words=5, threshold=0.8).collect()}
    assert got == dict(enumerate(least)) and 1 < len(set(least)) < len(least)
    assert rows[1] > 1000 and sum(n for turn, n in rows.items() if turn > 1) < rows[1] / 2


def test_united_buckets_keep_every_pair(spark, tmp_path, monkeypatch):
    """Each pair of a bucket is in a bucket still, and one of it is a pivot where a larger bucket has taken the others."""
    monkeypatch.setattr(ngram_join, "SLOT", 8)
    rng = np.random.default_rng(6)
    buckets = [set(rng.choice(30, k).tolist()) for k in (20, 18, 12, 9, 9, 7, 5)] + [set(range(40 + 10 * i, 45 + 10 * i)) for i in range(3)] + [{0, 1, 40}, {41, 42, 99}]
    buckets += [set(range(200, 220))] + [set(range(200 + i, 214 + i)) | {220} for i in range(4)]
    active = spark.createDataFrame([(b, 0, 1, m, m) for b, x in enumerate(buckets) for m in x], "bucket long, slot long, slots long, member long, root long")
    out = ngram_join._united(active, f"file://{tmp_path}").collect()
    after = {}
    for r in out:
        after.setdefault(r.bucket, {})[r.member] = r.outside
        assert r.slots == -(-sum(x.bucket == r.bucket for x in out) // 8) and 0 <= r.slot < r.slots
    assert len(after) < len(buckets) and any(v for x in after.values() for v in x.values())
    for x in buckets:
        for a in x:
            for b in x:
                assert any(a in y and b in y and (y[a] is None or y[a] or y[b]) for y in after.values())
