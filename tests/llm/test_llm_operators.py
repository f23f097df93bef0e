"""The ten operators against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexloom.llm import bpe_words, decontaminate, encoders, exact_dedup, line_dedup, ngram_join, ordinal, quality, queries, sstable, store, substring_dedup, token_counts, toxicity
from lexloom.llm import textkit as tk
from lexloom.llm.graph import components

WORD_JSON, BYTE_JSON = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("mark", StringType()), StructField("keep_id", StringType()), StructField("digest", StringType())])


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "m", "k", "d") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=3, n=60):
    """Copies, near copies, shared passages, blank and very long texts, other alphabets, ties."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "δέλτα", "it's", "12.5", "x" * 40, "naïve", "the", "of", "<|endoftext|>"] + [f"w{i}" for i in range(300)]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for _ in range(k))
    base, passage = text(150), text(60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, base.upper()), (6, base.replace(" ", "  ")), (7, "one"), (8, "One"), (9, "one two"), (10, "  a  b  "), (11, text(4000))]
    for i in range(12, n):
        kind = i % 4
        words = base.split(" ")
        if kind == 0:
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words) if kind == 0 else text(30) + passage + text(30) if kind == 1 else text(rng.randrange(1, 90)) if kind == 2 else rng.choice(rows)[1]))
    return rows


EMPTY: list = []


def words_of(text, lower=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    fold = {c: c + 32 for c in range(65, 91)}
    return [x.translate(fold) for x in w] if lower else w


# ---------------------------------------------------------------- shared kernels


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té ", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    import pyarrow as pa

    buf, off = tk.column(pa.array(texts, pa.string()))
    s, e, first = tk.spans(buf, off)
    found = [[buf[a:b].tobytes().decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert found == [words_of(t, False) for t in texts]
    h = tk.slice_hashes(buf, s, e)
    flat = [w for t in found for w in t]
    assert len({int(x) for x in h}) == len(set(flat))
    sets = [len(x) for x in tk.shingle_sets(buf, off, 2)]
    assert sets == [len({tuple(w[i : i + 2]) for i in range(len(w) - 1)}) or min(1, len(w)) for w in map(words_of, texts)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 200)] + [(3000, 3001)]
    found = {r.u: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), store.work_dir(spark, "t")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[1000 + i] == 1000 for i in range(200)) and found[3001] == 3000


# ---------------------------------------------------------------- 1 decontamination


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    docs = corpus()
    items = []
    for i in range(30):
        w = words_of(rng.choice([t for _, t in docs if t and len(words_of(t)) > 60]))
        a = rng.randrange(len(w) - 40)
        part = w[a : a + rng.randrange(4, 40)]
        for _ in range(i % 4):
            part[rng.randrange(len(part))] = "changed"
        items.append((i, " ".join(part)))
    items += [(100, None), (101, ""), (102, "a b c"), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(spark, table(spark, docs), bench, block_items=7).collect())
    want = []
    for d, t in docs:
        have = decontaminate.shingle_set(t or "", 5)
        for i, q in items:
            need = decontaminate.shingle_set(q or "", 5)
            if need and 10 * len(need & have) >= 8 * len(need):
                want.append((d, i, len(need), len(need & have), len(need & have) / len(need)))
    assert got == sorted(want) and len(got) > 10
    kept = decontaminate.without_contaminated(spark, table(spark, docs), bench)
    assert kept.columns == SCHEMA.names and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}
    for a, b in ((EMPTY, items), (docs, EMPTY)):
        assert decontaminate.contaminated(spark, table(spark, a), spark.createDataFrame(b, "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- 2, 3 ordinal regression


def test_grades_are_ordered_and_held_out_error_is_small(spark):
    rng = random.Random(2)
    cues = ["fine", "good", "great", "superb"]

    def doc(i):
        g = i % 4
        return i, " ".join([f"w{rng.randrange(400)}" for _ in range(60)] + [cues[j] for j in range(g + 1) for _ in range(2)]), g

    rows = [doc(i) for i in range(1200)]
    docs = table(spark, [(i, t) for i, t, _ in rows])
    rated = spark.createDataFrame([(i, g) for i, _, g in rows if i < 800] + [(None, 2), (5, None)], "doc_id long, quality int")
    model = ordinal.fit(spark, docs, rated, "quality")
    assert np.all(np.diff(model.cuts) > 0) and list(model.grades) == [0, 1, 2, 3]
    found = {r.doc_id: r for r in quality.quality(spark, docs, rated, least_grade=2).collect()}
    held = [(found[i], g) for i, _, g in rows if i >= 800]
    assert np.mean([abs(r.quality_expected - g) for r, g in held]) < 0.3
    assert np.mean([r.selected == (g >= 2) for r, g in held]) > 0.97
    assert docs.columns == SCHEMA.names


@pytest.mark.parametrize(("name", "operator", "decided", "recall", "precision", "other"), [("toxic", toxicity.toxicity, "rejected", 0.88, 0.92, 0.98), ("quality", quality.quality, "selected", 0.95, 0.97, 0.9)])
def test_decisions_on_held_out_labels(spark, name, operator, decided, recall, precision, other):
    """Two thirds of the labels fit the model; of the last third, what it finds, how much of that is right, and what it leaves alone."""
    d = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    truth = {r.doc_id: bool(r[name]) for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r[decided] for r in operator(spark, docs, labels.where("doc_id % 3 <> 0")).collect()}
    hits = sum(got[i] and t for i, t in truth.items())
    assert hits >= recall * sum(truth.values()) and hits >= precision * sum(got[i] for i in truth)
    assert sum(not got[i] and not t for i, t in truth.items()) >= other * sum(not t for t in truth.values())


def test_the_model_is_the_one_of_a_plain_refit(spark):
    """Features counted and screened by definition, in plain Python, give the same model."""
    d = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    model = ordinal.fit(spark, docs, labels, "quality", min_df=4, screen=3.0)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rated = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts]
    sets = {}
    for i, _ in rated:
        import pyarrow as pa

        sets[i] = set(ordinal.described(*tk.column(pa.array([texts[i]])))[1].tolist())
    y = np.array([g for _, g in rated], float)
    df: dict = {}
    total: dict = {}
    for i, g in rated:
        for k in sets[i]:
            df[k], total[k] = df.get(k, 0) + 1, total.get(k, 0) + g
    keys = sorted(k for k, n in df.items() if n >= 4 and abs(total[k] - n * y.mean()) >= 3 * np.sqrt(n * y.var()))
    assert model.keys.tolist() == keys and len(keys) > 20
    place = {k: j for j, k in enumerate(keys)}
    rows = sorted((i, g, np.array(sorted(place[k] for k in sets[i] if k in place), np.uint32)) for i, g in rated)
    again = ordinal.fit_arrays(np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), np.concatenate([r[2] for r in rows]), np.array([r[1] for r in rows]), np.array([0, 1]), l2=1e-4, steps=200)
    assert np.allclose(again.weights, model.weights, atol=1e-6) and np.allclose(again.cuts, model.cuts, atol=1e-6)


def test_without_ratings_nothing_is_decided(spark):
    docs, none = table(spark, corpus()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.selected and r.quality_expected is None for r in quality.quality(spark, docs, none).collect())
    assert not any(r.rejected for r in toxicity.toxicity(spark, docs, none).collect())
    some = spark.createDataFrame([(3, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(spark, table(spark, EMPTY), some).count() == 0
    assert toxicity.toxicity(spark, docs, some).count() == len(corpus())


# ---------------------------------------------------------------- 4 shards


def test_shards_round_trip(spark):
    docs = corpus() + [(-5, "negative id"), (2**40, "large id"), (7, "same id"), (None, "no id"), (None, "none here either"), (-(2**63), "least id")]
    folder = store.work_dir(spark, "t")
    shards = sstable.write_shards(spark, table(spark, docs), WORD_JSON, folder, shards=4)
    listed = shards.orderBy("shard").collect()
    named = [(i, t or "") for i, t in docs]
    order = lambda i: (i is not None, i or 0)
    ids = {}
    for (i, _), x in zip(named, encoders.plain(WORD_JSON, [t for _, t in named]), strict=True):
        ids.setdefault(i, []).append([*x, 1])
    seen = []
    for s in listed:
        reader = sstable.Reader(s.uri)
        seen += [(k, v.tolist()) for k, v in reader]
        for i in ids:
            found = sorted(v.tolist() for v in reader.get(i))
            assert found in ([], sorted(ids[i]))
        assert reader.get(123456789) == []
        assert (reader.rows, reader.ids) == (s["rows"], s.ids)
        reader.close()
    assert [k for k, _ in seen] == sorted((k for k, _ in named), key=order)
    assert sorted(seen, key=str) == sorted(((i, v) for i, vs in ids.items() for v in vs), key=str)
    rows = sstable.read_shards(spark, shards).orderBy("start").collect()
    start = 0
    for r, (k, v) in zip(rows, seen, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(v), zlib.crc32(np.array(v, "<u4").tobytes()))
        start += len(v)
    assert sstable.token_table(spark, table(spark, EMPTY), WORD_JSON).count() == 0


def test_many_blocks_and_lookups(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 256)
    uri = f"file://{tmp_path}/x.sst"
    rows = [(i * 3 - 500, np.arange(i % 50, dtype="<u2")) for i in range(500)]

    def write(out):
        w = sstable.Writer(out, 2)
        for k, v in rows:
            w.add(k, v)
        w.close()

    store.write_file(uri, write)
    reader = sstable.Reader(uri)
    assert len(reader.index) > 20
    assert all([x.tolist() for x in reader.get(k)] == [v.tolist()] for k, v in rows) and reader.get(-499) == []


# ---------------------------------------------------------------- 5, 9 tokens


@pytest.mark.parametrize("path", [WORD_JSON, BYTE_JSON])
def test_long_texts_are_spliced_exactly(path):
    rng = random.Random(1)
    alphabet = "ab é'sdZ 12.,!\n\t ß  Σ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))) for _ in range(60)] + ["x" * 700, "ab " * 200, " " * 300, "it's don't " * 40]
    for t in texts:
        want = len(encoders.plain(path, [t])[0])
        for chunk, overlap in ((16, 4), (64, 8), (300, 30)):
            assert token_counts.count_long(path, t, chunk, overlap) == want


def test_token_counts(spark):
    docs = corpus()
    got = {r.doc_id: r for r in token_counts.token_counts(table(spark, docs), WORD_JSON, limit=100, chunk=2000, overlap=64).collect()}
    for (i, t), ids in zip(docs, encoders.plain(WORD_JSON, [t or "" for _, t in docs]), strict=True):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 100)
    model = queries.tokenizer_path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, docs), model).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in docs}
    assert token_counts.token_counts(table(spark, EMPTY), WORD_JSON).count() == 0


@pytest.mark.parametrize("shard_bytes", [64 << 20, 500])
def test_bpe_round_trip(spark, shard_bytes):
    docs = corpus() + [(7, "same id again"), (None, "no id")]
    t = encoders.tokenizer(BYTE_JSON)
    got = sorted((r.doc_id or -1, bytes(r.ids), r.decoded) for r in bpe_words.round_trip(spark, table(spark, docs), BYTE_JSON, shard_bytes=shard_bytes).collect())
    want = []
    for i, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i or -1, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe_words.round_trip(spark, table(spark, EMPTY), BYTE_JSON).count() == 0


# ---------------------------------------------------------------- 6 lines


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_perfect_hash(keys, others):
    keys = np.array(sorted(keys), np.uint64)
    h = line_dedup.PerfectHash.of(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    h(np.array(others, np.uint64))


def test_lines_that_share_a_hash_are_kept_apart(tmp_path):
    uri = f"file://{tmp_path}/s.shard"
    keys, mark = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    line_dedup.Shard.write(uri, keys, mark, np.array([5, 6, 7]), np.array([10, 20, 30]))
    count, keeper = line_dedup.Shard(uri).probe(np.array([5, 5, 9, 9, 4], np.uint64), np.array([1, 2, 3, 4, 1], np.uint64))
    assert count.tolist() == [5, 6, 7, 0, 0] and keeper[:3].tolist() == [10, 20, 30]


@pytest.mark.parametrize("shard_bytes", [line_dedup.SHARD_BYTES, 800])
def test_line_dedup_against_brute_force(spark, shard_bytes):
    rng = random.Random(4)
    pool = ["A licence line that many documents have, word for word.", "  a LICENCE line that many documents have, word for word. \t", "short line", "é" * 40, "é" * 39, "Rare line of more than forty code points, yes it is long"]
    docs = [(0, None), (1, ""), (2, "\n"), (3, "\n\n"), (4, "x\n")] + [(i, "\n".join(rng.choice([*pool, f"own line {i}", ""]) for _ in range(rng.randrange(1, 7)))) for i in range(5, 70)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark, table(spark, docs), shard_bytes=shard_bytes).collect()}
    fold = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(fold)
    holders: dict = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert len(gone) >= 2
    assert line_dedup.deduplicated(spark, table(spark, EMPTY)).count() == 0


# ---------------------------------------------------------------- 7 similarity join


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 120), st.floats(0.5, 0.95), st.integers(0, 10**6))
def test_similar_sets_share_a_key(n, t, seed):
    t = round(t, 2)
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, n, np.uint64))
    b = a.copy()
    for _ in range(rng.integers(0, max(1, n // 3) + 1)):  # drop, add or replace
        kind = rng.integers(3)
        if kind < 2 and len(b) > 1:
            b = np.delete(b, rng.integers(len(b)))
        if kind > 0:
            b = np.unique(np.append(b, rng.integers(0, 2**64, 1, np.uint64)))
    both = len(np.intersect1d(a, b))
    if both >= t * (len(a) + len(b) - both):
        keys = [set(ngram_join.set_keys(x, t, ngram_join._spread(x, 0)).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize(("k", "t"), [(3, 0.9), (5, 0.8), (2, 0.5)])
def test_similarity_classes_against_all_pairs(spark, k, t):
    docs = corpus(n=90) + [(7, "one"), (None, "no id at all here")]
    sets = []
    for i, x in docs:
        w = words_of(x)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= round(100 * t) * len(x | y):
                root[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min((x for x in (least.get(find(a)), i) if x is not None), default=None)
    want = sorted(((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)
    got = sorted((tuple(r) for r in ngram_join.classes(spark, table(spark, docs), words=k, threshold=t).collect()), key=str)
    assert got == want
    kept = ngram_join.one_of_each(spark, table(spark, docs), words=k, threshold=t)
    assert kept.columns == SCHEMA.names
    stay = {}
    for a, (i, s) in enumerate(sets):
        if s and (find(a) not in stay or (i is not None and (stay[find(a)] is None or i < stay[find(a)]))):
            stay[find(a)] = i
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*stay.values(), *(i for i, s in sets if not s), 7], key=str)  # 7 is there twice, word for word
    assert ngram_join.classes(spark, table(spark, EMPTY), words=k, threshold=t).count() == 0


# ---------------------------------------------------------------- 8 repeated passages


@pytest.mark.parametrize("window", [50, 12])
def test_repeated_passages_against_brute_force(spark, window):
    docs = corpus(n=80)
    got = {r.doc_id: r for r in substring_dedup.without_repeats(spark, table(spark, docs), window=window).collect()}
    first: dict = {}
    lists = {i: words_of(x, False) for i, x in docs}
    for i in sorted(lists):
        for a in range(len(lists[i]) - window + 1):
            first.setdefault(tuple(lists[i][a : a + window]), i)
    removed = 0
    for i, w in lists.items():
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        removed += sum(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)
        assert sum(b - a for a, b in got[i].spans) == sum(gone)
    assert removed > 500
    assert substring_dedup.without_repeats(spark, table(spark, EMPTY), window=window).count() == 0


def test_lengths_double_until_nothing_is_shared(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    long, short = text(170), text(24)
    docs = [(1, text(5) + " " + long), (2, long + " " + text(9)), (3, short), (4, text(3) + " " + short), (5, text(200))]
    found = {r.doc_id: r.length for r in substring_dedup.repeated_lengths(spark, table(spark, docs), window=20).collect()}
    assert found == {1: 160, 2: 160, 3: 20, 4: 20}


# ---------------------------------------------------------------- 10 exact copies


def weak(text):
    """A digest of three values: almost everything collides."""
    return (F.length(text) % 3).cast("string")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_groups(spark, digest):
    docs = corpus(n=40) + [(7, "one"), (7, "two")]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x or "")
    by: dict = {}
    for i, x in docs:
        by.setdefault(norm(x), []).append(i)
    got = exact_dedup.groups(spark, table(spark, docs), digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((i, min(by[norm(x)]), len(by[norm(x)])) for i, x in docs)
    assert sum(r.kept for r in got) == len(by) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.without_copies(spark, table(spark, docs), digest=digest)
    assert kept.columns == SCHEMA.names
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(by)
    if digest is exact_dedup.sha256:
        assert all(r.digest in {hashlib.sha256(t.encode()).hexdigest() for t in by} for r in got)
        assert exact_dedup.groups(spark, table(spark, EMPTY)).count() == 0


def test_bytes_of_earlier_calls_are_compared(spark):
    state = store.work_dir(spark, "state")
    calls = [[(5, "abc")], [(7, "xyz"), (8, "abc"), (9, "xyz")], [(6, "xyz"), (4, "new"), (10, "a"), (11, None)]]
    seen = []
    for rows in calls:
        seen += rows
        by: dict = {}
        for i, t in seen:
            by.setdefault(t or "", []).append(i)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(spark, table(spark, rows), digest=weak, state=state).collect()}
        assert got == {i: (min(by[t or ""]), len(by[t or ""]), i == min(by[t or ""])) for i, t in rows}


def test_state_knows_earlier_documents(spark):
    state = store.work_dir(spark, "state")
    exact_dedup.groups(spark, table(spark, [(5, "a b"), (6, "c")]), state=state).collect()
    later = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(spark, table(spark, [(7, "a  b"), (8, "d"), (3, "c")]), state=state).collect()}
    assert later[7] == (5, 2, False) and later[8] == (8, 1, True) and later[3][0] == 3


def test_no_python_on_the_main_path(spark):
    plan = exact_dedup.keyed(table(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
