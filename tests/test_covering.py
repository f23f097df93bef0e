"""Covers of packed blocks against the plain greedy choice and plain joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import blueprint, compose, covering

TRIPLE = "profile_id long, obligation_id long, block_id long"


@pytest.fixture(scope="module")
def candidates():
    """Dense and sparse profiles, ids that need gaps of one to eight bytes, and a profile that has no id."""
    r = random.Random(5)
    far = [-(1 << 62), -7, 0, 3, 200, 70_000, 1 << 33, (1 << 62) + 5]
    rows = set()
    for p in [*range(40), None]:
        pool = far if p is not None and p % 4 == 0 else range(100 * (p or 0), 100 * (p or 0) + r.randint(3, 25))
        for d in range(r.randint(1, 12)):
            rows |= {(p, 1000 + d, b) for b in r.sample(list(pool), r.randint(1, 3))}
    rows = sorted(rows, key=repr)
    hard = [x for x in rows if r.random() < 0.08]
    curated = {b for _, _, b in rows if r.random() < 0.5}
    return rows, hard, curated


@pytest.mark.parametrize("entries", [1, 1 << 20])
def test_covers_are_the_greedy_ones(spark, candidates, monkeypatch, entries):
    rows, hard, curated = candidates
    blocks = spark.createDataFrame([(b, "curated" if b in curated else "derived") for b in {b for _, _, b in rows}], "block_id long, status string")
    monkeypatch.setattr(covering, "ENTRIES", entries)
    found = compose.compose(spark.createDataFrame(rows + rows[:9], TRIPLE), spark.createDataFrame(hard, TRIPLE), blocks).collect()
    # nothing is equal to a null: the profile without an id has no required block
    for p in {p for p, _, _ in rows}:
        of = {}
        for _, d, b in (x for x in rows if x[0] == p):
            of.setdefault(d, set()).add(b)
        must = [b for q, _, b in sorted((x for x in hard if x[0] == p), key=lambda x: x[1:]) if q is not None]
        want, _ = compose.minimise(of, must, curated)
        assert [(x.block_id, x.position, x.basis) for x in sorted((x for x in found if x.profile_id == p), key=lambda x: x.position)] == [(b, i + 1, "required" if b in must else "selected") for i, b in enumerate(want)]


def test_problems_are_those_of_joins(spark, candidates):
    rows, hard, _ = candidates
    r = random.Random(6)
    known = spark.createDataFrame(rows, TRIPLE)
    needed = spark.createDataFrame(hard, TRIPLE)
    chosen = {(p, b) for p, _, b in rows if r.random() < 0.4} | {(3, 999_999), (77, 4), (2, None), (None, 5)}
    picks = spark.createDataFrame(sorted(chosen, key=repr), "profile_id long, block_id long")
    duties = known.select("profile_id", "obligation_id").union(spark.createDataFrame([(3, 5000), (88, 1001), (1, None)], "profile_id long, obligation_id long")).distinct()
    live = spark.createDataFrame([(1000 + i,) for i in range(0, 12, 2)], "obligation_id long")
    want = blueprint.problems(picks, duties, known, needed, live)
    keys = ["profile_id", "obligation_id"]
    packs = covering.packed(known.select(*keys, "block_id").join(needed.toDF("p", "d", "b"), F.expr("profile_id <=> p and obligation_id <=> d and block_id <=> b"), "left").select(*keys, "block_id", F.when(F.col("b").isNotNull(), covering.HARD).otherwise(0).alias("mark")), keys)
    held = duties.join(packs.withColumnsRenamed({"profile_id": "p", "obligation_id": "d"}), F.expr("profile_id <=> p and obligation_id <=> d"), "left").drop("p", "d").join(live.withColumn("live", F.lit(True)), "obligation_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    key = lambda df: sorted(map(tuple, df.select("profile_id", "problem", "ref").collect()), key=repr)
    assert key(covering.problems(held, picks)) == key(want)


def test_packs_open_again(spark, candidates):
    rows, _, _ = candidates
    of = [(d, b, b % 4) for d, b in sorted({(d, b) for _, d, b in rows})] + [(9999, None, 0)]
    packs = covering.packed(spark.createDataFrame(of, "obligation_id long, block_id long, mark int"), ["obligation_id"])
    held = packs.withColumn("profile_id", F.lit(1).cast("long")).orderBy("obligation_id").toArrow()
    o = covering.Opened(held)
    assert list(zip(held.column("obligation_id").to_numpy()[o.row].tolist(), o.ids.tolist(), o.marks.tolist())) == [x for x in of if x[1] is not None]
    assert o.n.tolist()[-1] == 0
