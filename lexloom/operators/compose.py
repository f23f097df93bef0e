"""Composition: covering programs, their proofs, diffs and explanations (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import blueprint, covering
from lexloom.plans.fixpoint import few
from lexloom.plans.portable import Suite, joined, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles


def minimise(candidates: dict, required: list, curated: set) -> tuple[list, list]:
    """Picked blocks in order, required ones first, and those pruned.

    ``candidates`` maps each duty to the blocks that satisfy it.  Greedy cover
    of what the required blocks leave: most duties first, curated before
    derived, then the least id.  Picks whose duties others satisfy too are
    pruned, last pick first.  Counts are kept per block, so a pick costs the
    duties that it covers and not a scan of all pairs.
    """
    picks = list(dict.fromkeys(required))
    chosen = set(picks)
    by_block: dict = {}
    for duty, blocks in candidates.items():
        for b in blocks:
            by_block.setdefault(b, set()).add(duty)
    left = {d for d, blocks in candidates.items() if blocks and not chosen & blocks}
    gain = {b: len(ds & left) for b, ds in by_block.items()}
    while left:
        best = min((b for b, n in gain.items() if n), key=lambda b: (-gain[b], b not in curated, b))
        picks.append(best)
        for d in by_block[best] & left:
            left.discard(d)
            for b in candidates[d]:
                gain[b] -= 1
    chosen, pruned = set(picks), []
    for b in reversed(picks[len(dict.fromkeys(required)):]):
        if all(candidates[d] & (chosen - {b}) for d in by_block[b]):
            chosen.discard(b)
            pruned.append(b)
    return [b for b in picks if b in chosen], pruned


def compose(candidates: DataFrame, required: DataFrame, blocks: DataFrame) -> DataFrame:
    """``profile_id, block_id, position, basis`` for every profile.

    ``candidates(profile_id, obligation_id, block_id)`` and ``required`` of the
    same columns.  Greedy choice is sequential within a profile and
    independent between profiles; it is that of :func:`minimise`, made for
    many profiles at once over packed blocks (:mod:`covering`).
    """
    keys = ["profile_id", "obligation_id"]
    held = candidates.join(blocks.select("block_id", (F.col("status") == "curated").alias("curated")), "block_id")
    held = held.join(required.select(*keys, "block_id").distinct().withColumn("hard", F.lit(True)), [*keys, "block_id"], "left")
    marked = held.groupBy(*keys, "block_id").agg(_mark().alias("mark"))
    return covering.picks(covering.packed(marked, keys))


def _mark():
    return F.when(F.bool_or("curated"), covering.CURATED).otherwise(0) + F.when(F.bool_or("hard"), covering.HARD).otherwise(0)


def _duties(spark, sf_dir) -> DataFrame:
    """Profiles are customers, duties their ordered parts: each once, dealt by duty, where their blocks meet them."""
    o, line = relation(spark, sf_dir, "orders"), relation(spark, sf_dir, "lineitem")
    wanted = o.select("o_orderkey", F.col("o_custkey").alias("profile_id"))
    met = line.select("l_orderkey", F.col("l_partkey").alias("obligation_id")).join(wanted, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("profile_id", "obligation_id").repartition("obligation_id").distinct()


def _needs(spark, sf_dir) -> DataFrame:
    """``obligation_id, block_id, hard``: candidates are the parts' suppliers, each once for a part."""
    line = relation(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("obligation_id"), F.col("l_suppkey").alias("block_id"), (F.col("l_quantity") >= 50).alias("hard"))
    return line.repartition("obligation_id").groupBy("obligation_id", "block_id").agg(F.bool_or("hard").alias("hard"))


def _composed(spark, sf_dir) -> DataFrame:
    """Duties of all profiles with their packed blocks; a duty whose blocks are all unknown has none."""
    known = relation(spark, sf_dir, "block").groupBy("block_id").agg(F.bool_or(F.col("status") == "curated").alias("curated"), F.lit(True).alias("known"))
    met = _needs(spark, sf_dir).join(few(known), "block_id", "left")
    marked = met.groupBy("obligation_id", F.when(F.col("known"), F.col("block_id")).alias("block_id")).agg(_mark().alias("mark"))
    return _duties(spark, sf_dir).join(covering.packed(marked, ["obligation_id"]).hint("shuffle_hash"), "obligation_id")


_CAND = """
    duty AS (SELECT DISTINCT o_custkey AS profile_id, l_partkey AS obligation_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey),
    cand AS (SELECT d.profile_id, d.obligation_id, r.block_id FROM duty d JOIN {requires} r ON r.obligation_id = d.obligation_id),
    hard AS (SELECT d.profile_id, d.obligation_id, r.block_id FROM duty d JOIN {hard_requires} r ON r.obligation_id = d.obligation_id)"""


@S.checked("p01_minimise")
def _p01(spark, sf_dir):
    return covering.picks(_composed(spark, sf_dir))


@S.checked("p02_compose", f"WITH {_CAND} SELECT profile_id, count(DISTINCT obligation_id) AS duties, true AS all_covered FROM cand GROUP BY profile_id")
def _p02(spark, sf_dir):
    """Every duty that has a candidate is satisfied by a picked block."""
    return covering.judged(_composed(spark, sf_dir)).select("profile_id", "duties", "all_covered")


@S.checked("p12_minimality", f"WITH {_CAND} SELECT DISTINCT profile_id, cast(0 AS BIGINT) AS redundant FROM cand")
def _p12(spark, sf_dir):
    """Selected blocks without which nothing is uncovered: there must be none."""
    return covering.judged(_composed(spark, sf_dir)).select("profile_id", "redundant")


def _list(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


_AT = "array_to_string(list_sort(list(DISTINCT {0})), ',')"


@S.checked("p04_coverage", f"""SELECT d.profile_id, d.obligation_id, CASE WHEN count(p.block_id) > 0 THEN 'covered' ELSE 'gap' END AS state, coalesce({_AT.format('p.block_id')}, '') AS satisfied_by, coalesce({_AT.format('h.l_suppkey')}, '') AS required_blocks
    FROM {{duty}} d LEFT JOIN {{requires}} r ON r.obligation_id = d.obligation_id LEFT JOIN {{pick}} p ON p.profile_id = d.profile_id AND p.block_id = r.block_id LEFT JOIN (SELECT l_partkey, l_suppkey FROM {{lineitem}} WHERE l_quantity >= 50) h ON h.l_partkey = d.obligation_id GROUP BY d.profile_id, d.obligation_id""")
def _p04(spark, sf_dir):
    found = blueprint.coverage_rows(*(relation(spark, sf_dir, n) for n in ("duty", "candidate", "needed", "pick")))
    return found.select("profile_id", "obligation_id", "state", _list("satisfied_by").alias("satisfied_by"), _list("required_blocks").alias("required_blocks"))


_PROOF = """
    m AS (SELECT c.profile_id, c.obligation_id, c.block_id, count(*) OVER (PARTITION BY c.profile_id, c.obligation_id) AS n FROM {candidate} c WHERE EXISTS (SELECT 1 FROM {pick} p WHERE p.profile_id = c.profile_id AND p.block_id = c.block_id)),
    g AS (SELECT p.profile_id, p.block_id, p.basis, coalesce(sum((m.n = 1)::INTEGER), 0)::BIGINT AS gaps, coalesce(sum((m.n > 1)::INTEGER), 0)::BIGINT AS still FROM {pick} p LEFT JOIN m ON m.profile_id = p.profile_id AND m.block_id = p.block_id GROUP BY p.profile_id, p.block_id, p.basis)"""


def _proofs(spark, sf_dir):
    return blueprint.proofs(relation(spark, sf_dir, "pick"), relation(spark, sf_dir, "candidate"))


@S.checked("p05_load_bearing", f"WITH {_PROOF} SELECT profile_id, block_id FROM g WHERE basis = 'required' OR gaps > 0")
def _p05(spark, sf_dir):
    return _proofs(spark, sf_dir).where("load_bearing").select("profile_id", "block_id")


@S.checked("p06_minimality_proof", f"WITH {_PROOF} SELECT profile_id, block_id, gaps AS gaps_if_removed, still AS still_covered, basis = 'selected' AND gaps = 0 AS redundant FROM g")
def _p06(spark, sf_dir):
    return _proofs(spark, sf_dir).select("profile_id", "block_id", "gaps_if_removed", "still_covered", "redundant")


@S.checked("p13_blueprint_check", """
    SELECT profile_id, 'item without duty' AS problem, block_id AS ref FROM {other} p WHERE NOT EXISTS (SELECT 1 FROM {candidate} c WHERE c.profile_id = p.profile_id AND c.block_id = p.block_id)
    UNION ALL SELECT profile_id, 'duty without item', obligation_id FROM {duty} d WHERE NOT EXISTS (SELECT 1 FROM {requires} r JOIN {other} p ON p.block_id = r.block_id WHERE r.obligation_id = d.obligation_id AND p.profile_id = d.profile_id)
    UNION ALL SELECT DISTINCT n.profile_id, 'required not picked', n.block_id FROM {needed} n WHERE n.block_id % 10 = 3
    UNION ALL SELECT profile_id, 'duty not live', obligation_id FROM {duty} WHERE obligation_id % 11 = 0""".replace("{other}", "(SELECT profile_id, block_id FROM {pick} WHERE block_id % 10 <> 3 UNION SELECT profile_id, -1 FROM {profile} WHERE profile_id % 40 = 0)"))
def _p13(spark, sf_dir):
    """A composition that has lost some items and has some that nobody asked for."""
    needs, duties = _needs(spark, sf_dir), _duties(spark, sf_dir)
    marked = needs.select("obligation_id", "block_id", F.when(F.col("hard"), covering.HARD).otherwise(0).alias("mark"))
    live = relation(spark, sf_dir, "obligation").where("status <> 'stale'").select("obligation_id").distinct().withColumn("live", F.lit(True))
    rows = duties.join(covering.packed(marked, ["obligation_id"]).hint("shuffle_hash"), "obligation_id", "left").join(live, "obligation_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    # the composition "pick", whose items are chosen duty by duty: its least block, and those it must have
    chosen = needs.groupBy("obligation_id").agg(F.array_union(F.collect_set(F.when(F.col("hard"), F.col("block_id"))), F.array_compact(F.array(F.when(F.col("obligation_id") % 9 != 0, F.min("block_id"))))).alias("items"))
    picks = duties.join(chosen.hint("shuffle_hash"), "obligation_id").select("profile_id", F.explode("items").alias("block_id")).where("block_id % 10 <> 3").distinct()
    extra = relation(spark, sf_dir, "profile").where("profile_id % 40 = 0").select("profile_id", F.lit(-1).cast("bigint").alias("block_id"))
    return covering.problems(rows, picks.union(extra).distinct())


@S.checked("p08_store_supersede", """
    WITH k AS (SELECT o_custkey AS fingerprint, o_orderkey AS blueprint, o_orderpriority AS h, o_orderdate AS made, row_number() OVER w AS i FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    n AS (SELECT a.* FROM k a LEFT JOIN k b ON b.fingerprint = a.fingerprint AND b.i = a.i - 1 WHERE b.h IS NULL OR b.h <> a.h),
    r AS (SELECT *, (SELECT count(*) FROM n b WHERE b.fingerprint = n.fingerprint AND b.i <= n.i) AS version, (SELECT min(b.i) FROM n b WHERE b.fingerprint = n.fingerprint AND b.i > n.i) AS j FROM n)
    SELECT r.fingerprint, r.version, r.blueprint, k.blueprint AS superseded_by FROM r LEFT JOIN k ON k.fingerprint = r.fingerprint AND k.i = r.j""")
def _p08(spark, sf_dir):
    made = relation(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fingerprint"), F.col("o_orderkey").alias("blueprint"), F.col("o_orderpriority").alias("composition_hash"), F.col("o_orderdate").alias("made"))
    return blueprint.stored(made).select("fingerprint", F.col("version").cast("bigint").alias("version"), "blueprint", "superseded_by")


@S.checked("p18_explain_item", """
    WITH d AS (SELECT l_suppkey AS block_id, l_partkey AS o, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) x),
    t AS (SELECT block_id, max(n) AS n, string_agg(concat('OBL-', lpad(o::VARCHAR, 6, '0')), ', ' ORDER BY i) FILTER (WHERE i <= 3) AS names FROM d GROUP BY block_id)
    SELECT s_suppkey AS block_id, coalesce(concat('Covers ', n, CASE WHEN n = 1 THEN ' duty: ' ELSE ' duties: ' END, names, CASE WHEN n > 3 THEN concat(' and ', n - 3, ' more') ELSE '' END, '.'), 'Covers no duty.') AS text FROM {supplier} LEFT JOIN t ON t.block_id = s_suppkey
    """.replace("coalesce(concat(", "CASE WHEN n IS NULL THEN 'Covers no duty.' ELSE concat(").replace(", '.'), 'Covers no duty.') AS text", ", '.') END AS text"))
def _p18(spark, sf_dir):
    """Duties in the order of their ids: names have six digits and no more."""
    return blueprint.explained(relation(spark, sf_dir, "block"), _named_duties(spark, sf_dir), by="obligation_id")


def _named_duties(spark, sf_dir):
    return relation(spark, sf_dir, "requires").join(relation(spark, sf_dir, "obligation").select("obligation_id", "stable_id"), "obligation_id").select("block_id", "obligation_id", "stable_id")


@S.checked("p21_citations_ok", """
    WITH d AS (SELECT l_suppkey AS block_id, l_partkey AS o, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) x), c AS (SELECT block_id, count(*) AS cited, count(*) FILTER (WHERE o % 40 = 0) AS foreign_ FROM d WHERE i <= 3 GROUP BY block_id)
    SELECT s_suppkey AS block_id, coalesce(cited, 0) AS cited, coalesce(foreign_, 0) AS foreign_, coalesce(cited > 0 AND foreign_ = 0, false) AS ok FROM {supplier} LEFT JOIN c ON c.block_id = s_suppkey""")
def _p21(spark, sf_dir):
    """Explanations against blueprints that one duty in forty has left."""
    known = _named_duties(spark, sf_dir).where("cast(substring(stable_id, 5, 9) as int) % 40 <> 0")
    return blueprint.citations_ok(_p18(spark, sf_dir), "block_id", "text", known, "stable_id").withColumnRenamed("foreign", "foreign_")


@S.checked("p23_performance_overlay", """
    WITH r AS (SELECT o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}),
    i AS (SELECT c_custkey AS profile_id, p.o_orderpriority AS item FROM {customer} CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {orders}) p),
    c AS (SELECT profile_id, count(*) FILTER (WHERE coalesce(o_orderstatus, '') <> 'P') AS required, count(o_orderstatus) AS observed, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed FROM i LEFT JOIN r ON r.o_custkey = profile_id AND r.o_orderpriority = item AND r.n = 1 GROUP BY profile_id)
    SELECT profile_id, required, observed, passed, CASE WHEN required > 0 THEN passed / required END AS score FROM c""")
def _p23(spark, sf_dir):
    """Priorities are a profile's items and its orders the observations of them."""
    o = relation(spark, sf_dir, "orders")
    outcome = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "P", "not_applicable").otherwise("failed")
    seen = o.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("item"), outcome.alias("outcome"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderkey").alias("id"))
    items = relation(spark, sf_dir, "profile").select("profile_id").crossJoin(F.broadcast(o.select(F.col("o_orderpriority").alias("item")).distinct()))
    return blueprint.performance(items, seen)


@S.checked("p07_open_questions", "SELECT a.profile_id, e.basis, e.key1 AS question, count(DISTINCT e.obligation_id) AS duties FROM (SELECT DISTINCT profile_id FROM {answer}) a CROSS JOIN {edge} e LEFT JOIN {answer} s ON s.profile_id = a.profile_id AND s.basis = e.basis AND s.akey = e.key1 WHERE e.basis = 'condition' AND s.akey IS NULL GROUP BY a.profile_id, e.basis, e.key1")
def _p07(spark, sf_dir):
    """Duties are counted once for each question; profiles meet questions, not duties."""
    answers = relation(spark, sf_dir, "answer").select("profile_id", "basis", F.col("akey").alias("question")).distinct()
    asked = relation(spark, sf_dir, "edge").where("basis = 'condition'").groupBy("basis", F.col("key1").alias("question")).agg(F.countDistinct("obligation_id").alias("duties"))
    open_ = answers.select("profile_id").distinct().crossJoin(asked).join(answers, ["profile_id", "basis", "question"], "left_anti")
    return open_.select("profile_id", "basis", "question", "duties")


@S.checked("p03_store_composition", f"WITH {_CAND} SELECT profile_id, count(DISTINCT block_id) AS blocks, [[sha2(||sha256(]]{joined('cast(block_id AS VARCHAR(9))')}[[, 256)||)]] AS composition_hash FROM cand GROUP BY profile_id")
def _p03(spark, sf_dir):
    """The blocks of a profile's duties as they are, known or not."""
    blocks = covering.packed(_needs(spark, sf_dir).select("obligation_id", "block_id", F.lit(0).alias("mark")), ["obligation_id"])
    return covering.hashed(_duties(spark, sf_dir).join(blocks.hint("shuffle_hash"), "obligation_id"))


S.portable("p09_fingerprint", f"SELECT profile_id, [[sha2(||sha256(]]{joined('concat(basis, akey)')}[[, 256)||)]] AS fingerprint FROM {{answer}} GROUP BY profile_id")
S.portable("p10_composition_hash", f"SELECT l_orderkey AS blueprint, [[sha2(||sha256(]]{joined('cast(l_suppkey AS VARCHAR(9))')}[[, 256)||)]] AS composition_hash FROM {{lineitem}} GROUP BY l_orderkey")
S.portable("p11_blueprint_history", "SELECT o_custkey, o_orderkey, cast(o_orderdate AS DATE) AS made FROM {orders} WHERE o_custkey IN (3, 5, 7) ORDER BY made, o_orderkey")
_TWO = """
    before AS (SELECT l_suppkey AS block_id, count(DISTINCT l_partkey) AS duties, max(l_quantity) >= 50 AS hard FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_suppkey % 4 <> 0 GROUP BY l_suppkey),
    after_ AS (SELECT l_suppkey AS block_id, count(DISTINCT l_partkey) AS duties, max(l_quantity) >= 50 AS hard FROM {lineitem} WHERE l_shipdate < TIMESTAMP '1999-01-01 00:00:00' AND l_suppkey % 5 <> 0 GROUP BY l_suppkey)"""
@S.checked("p14_diff_compositions", f"""WITH {_TWO.replace('[[', '').replace(']]', '')}
    SELECT coalesce(b.block_id, a.block_id) AS block_id, CASE WHEN b.block_id IS NULL THEN 'added' WHEN a.block_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN b.block_id IS NULL OR a.block_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.duties <> b.duties THEN 'duties' END, CASE WHEN a.hard <> b.hard THEN 'hard' END) END AS fields
    FROM before b FULL OUTER JOIN after_ a ON a.block_id = b.block_id WHERE a.block_id IS NULL OR b.block_id IS NULL OR a.duties <> b.duties OR a.hard <> b.hard""")
def _p14(spark, sf_dir):
    line = relation(spark, sf_dir, "lineitem")
    made = lambda until, odd: line.where((F.col("l_shipdate") < F.lit(until).cast("timestamp")) & (F.col("l_suppkey") % odd != 0)).groupBy(F.col("l_suppkey").alias("block_id")).agg(F.countDistinct("l_partkey").alias("duties"), (F.max("l_quantity") >= 50).alias("hard"))
    found = blueprint.differences(made("1997-01-01", 4), made("1999-01-01", 5), ["block_id"], ["duties", "hard"])
    return found.withColumn("fields", F.array_join("fields", ","))


S.portable("p15_diff_blueprints", f"WITH {_TWO} SELECT CASE WHEN b.block_id IS NULL THEN 'added' WHEN a.block_id IS NULL THEN 'removed' WHEN a.duties <> b.duties THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM before b FULL OUTER JOIN after_ a ON a.block_id = b.block_id GROUP BY 1")
S.portable("p16_what_changed", "SELECT source_id, count(*) AS changed FROM {new_version} n WHERE NOT EXISTS (SELECT 1 FROM {old_version} o WHERE o.ref = n.ref AND o.body = n.body) GROUP BY source_id")
S.portable("p17_recompose_queue", "SELECT DISTINCT o.o_custkey AS profile_id FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {obligation} b ON b.obligation_id = l.l_partkey WHERE b.status = 'stale'")


@S.checked("p19_cited_ids", "SELECT clause_id, array_to_string(list_sort(regexp_extract_all(text, '([0-9]{3,})', 1)), ',') AS cited FROM {clause}")
def _p19(spark, sf_dir):
    return relation(spark, sf_dir, "clause").select("clause_id", F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit(r"([0-9]{3,})"), F.lit(1))), ",").alias("cited"))


S.portable("p20_rubric", "SELECT clause_id, (CASE WHEN length(text) > 60 THEN 1 ELSE 0 END + CASE WHEN instr(text, 'must') + instr(text, 'shall') > 0 THEN 1 ELSE 0 END + CASE WHEN text LIKE '%.' THEN 1 ELSE 0 END + CASE WHEN instr(text, cast(clause_id AS VARCHAR(19))) > 0 THEN 1 ELSE 0 END + CASE WHEN instr(text, 'authority') = 0 THEN 1 ELSE 0 END) / cast(5 AS DOUBLE) AS score FROM {clause}")
S.portable("p22_evidence_gaps", "SELECT c.source_key, c.clause_id FROM {clause} c WHERE c.text = 'Reserved.' AND c.source_key IN (SELECT source_key FROM {clause} GROUP BY source_key HAVING count(*) > 100)")
S.portable("p24_accept_observation", "SELECT e.event_id, m.item, m.item IS NULL AS unmapped FROM {events} e LEFT JOIN (SELECT 'error' AS alias, 'fine' AS item UNION ALL SELECT 'click', 'prohibition' UNION ALL SELECT 'view', 'censure') m ON m.alias = e.event_type")
S.portable("p25_conformance", "SELECT source_key, bool_and(length(text) > 0) AS level1, bool_and(length(text) > 0) AND count(DISTINCT version_year) > 3 AS level2, bool_and(length(text) > 0) AND count(DISTINCT version_year) > 3 AND count(*) > 500 AS level3 FROM {clause} GROUP BY source_key")
