"""The kernels of the similarity join against all pairs, and what the join writes on the way."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexloom.functions import overlap
from lexloom.functions import text as tx
from lexloom.operators import similarity


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 0.8, 0.92, 1.0])
@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_tiles_against_all_pairs(tmp_path, monkeypatch, threshold, cells):
    monkeypatch.setattr(overlap, "CELLS", cells)
    monkeypatch.setattr(overlap, "MEETINGS", 64 if cells == 1 else 1 << 21)
    monkeypatch.setattr(overlap, "SLOTS", 16)  # words of a set share slots
    rng = np.random.default_rng(7)
    words = rng.integers(-(1 << 62), 1 << 62, 400)
    sets = [set(rng.choice(words[: rng.integers(n, 401)], n, replace=False).tolist()) for n in rng.integers(1, 60, 150)]
    for i in range(0, 100, 2):  # near ones of all degrees
        sets[i + 1] = set(list(sets[i])[rng.integers(0, len(sets[i])) :]) | set(rng.choice(words, rng.integers(1, 9)).tolist())
    place, times = np.unique([w & (overlap.PLACES - 1) for s in sets for w in s], return_counts=True)
    rarity = np.zeros(overlap.PLACES, np.uint8)
    rarity[place[times > 1]] = np.round(4 * np.log2(times[times > 1]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array([sorted(s) for s in sets], pa.list_(pa.int64())), pa.array([i % 3 for i in range(150)])], ["k", "h", "tile"])
    pq.write_table(pa.Table.from_batches(list(overlap.from_rare(rarity.tobytes())([batch]))), tmp_path / "t.parquet")
    tasks = [[(0, 0), (0, 1)], [(0, 2), (1, 1), (1, 2), (2, 2)]]
    run = overlap.meeting(tasks, dict.fromkeys(range(3), [f"file://{tmp_path}/t.parquet"]), rarity.tobytes(), threshold)
    got = [(*sorted((a, b)), s) for r in run([pa.RecordBatch.from_pydict({"id": [0, 1]})]) for a, b, s in zip(*r.to_pydict().values(), strict=True)]
    want = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(150) for j in range(i + 1, 150)]
    assert sorted(got) == [p for p in want if p[2] >= threshold] and (got or threshold == 1)


def test_large_sets_that_are_not_alike_are_not_written_as_pairs(spark, monkeypatch):
    """Any two of these have a fifth of their words in common, and nothing larger than the sets is written."""
    written = []
    monkeypatch.setattr(similarity, "kept", lambda df, keep=similarity.kept: written.append(keep(df)) or written[-1])
    rows = [(i, " ".join(f"word{j}" for j in range(200)) + " " + " ".join(f"own{i}x{j} pair{i // 2}x{j}" for j in range(200 if i < 56 else 20))) for i in range(60)]
    found = similarity.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", tx.duty_words(tx.F.col("text")), 0.5)
    sets = [set(t.split()) for _, t in rows]
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5]
    assert sorted((r.a, r.b) for r in found.collect()) == want and len(want) > 5
    assert max(df.count() for df in written) <= 60


def test_a_task_loads_each_tile_once(tmp_path, monkeypatch):
    words = [[11, 12, 13], [11, 12, 14], [11, 13, 14], [12, 13, 14], [21, 22], [21, 22, 23]]
    pq.write_table(pa.table({"k": list(range(6)), "h": pa.array(words, pa.list_(pa.int64())), "tile": [0, 1, 2, 0, 1, 2]}), tmp_path / "t.parquet")
    loaded = []
    monkeypatch.setattr(overlap, "Tile", lambda files, t, *more, load=overlap.Tile: loaded.append(t) or load(files, t, *more))
    run = overlap.meeting([[(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]], dict.fromkeys(range(3), [f"file://{tmp_path}/t.parquet"]), bytes([1]) * overlap.PLACES, 0.5)
    got = [tuple(sorted(p)) for r in run([pa.RecordBatch.from_pydict({"id": [0]})]) for p in zip(*r.select(["a", "b"]).to_pydict().values(), strict=True)]
    assert sorted(got) == [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(4, 5)]
    assert sorted(loaded) == [0, 1, 2]
