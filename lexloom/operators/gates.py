"""Quality gates over the tables: operators of :mod:`lexloom.operators.evals`, and aggregates in SQL (M, B13-B20).

The SQL beside an operator says what its figures must be from how the input
was made (which blocks were lost, which hashes broken), not by the same joins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import duties, evals, retrieval, similarity
from lexloom.plans.portable import Suite, joined, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles


def _whole(blocks, by=("doc_id",), sep="\n"):
    """The blocks of each document in order, as one text."""
    return blocks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), sep).alias("text"))


def _fidelity(spark, sf_dir, docs):
    spans = relation(spark, sf_dir, "original").join(docs.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("text", "span")
    return evals.fidelity(spans, _whole(relation(spark, sf_dir, "stored")), "doc_id")


_TOKENS = "len(regexp_extract_all(lower({0}), '([a-z0-9]+)', 1))"
_FOLD = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
# a span that was stored elsewhere in the document is held all the same
_HELD = f"""
    whole AS (SELECT doc_id, {_FOLD.format("string_agg(text, chr(10) ORDER BY pos)")} AS text FROM {{stored}} GROUP BY doc_id),
    f AS (SELECT o.doc_id, count(*) AS spans, sum({_TOKENS.format('o.text')}) AS n, sum(CASE WHEN coalesce(strpos(w.text, {_FOLD.format('o.text')}) > 0, false) THEN {_TOKENS.format('o.text')} ELSE 0 END) AS got,
        count(*) FILTER (WHERE {_TOKENS.format('o.text')} > 0 AND NOT coalesce(strpos(w.text, {_FOLD.format('o.text')}) > 0, false)) AS missing FROM {{original}} o LEFT JOIN whole w ON w.doc_id = o.doc_id GROUP BY o.doc_id),
    g AS (SELECT doc_id, spans, missing, CASE WHEN n > 0 THEN got / n ELSE 1 END AS score FROM f)"""


@S.checked("b13_fidelity", f"WITH {_HELD} SELECT doc_id, spans, missing, score, score >= 0.995 AS passed FROM g")
def _b13(spark, sf_dir):
    return _fidelity(spark, sf_dir, relation(spark, sf_dir, "documents"))


@S.checked("m01_fidelity_sample", f"""WITH {_HELD}, k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {{documents}}),
    s AS (SELECT doc_id, source FROM k WHERE i % greatest(1, floor(n / greatest(ceil(n * 0.1), 50)))::BIGINT = 0)
    SELECT source, count(*) AS sampled, avg(score) AS score, avg(score) >= 0.995 AS passed FROM s JOIN g USING (doc_id) GROUP BY source""")
def _m01(spark, sf_dir):
    docs = evals.strided(relation(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    found = _fidelity(spark, sf_dir, docs).join(docs, "doc_id")
    return found.groupBy("source").agg(F.count("*").alias("sampled"), F.avg("score").alias("score"), evals.passes(F.avg("score"), 0.995).alias("passed"))


@S.checked("m03_roundtrip", "SELECT s.doc_id, count(*) AS nodes, count(*) FILTER (WHERE s.doc_id % 31 = 6 AND s.pos = 0) AS wrong, count(*) FILTER (WHERE s.doc_id % 31 = 6 AND s.pos = 0) = 0 AS passed FROM {stored} s GROUP BY s.doc_id")
def _m03(spark, sf_dir):
    """Stored blocks against the spans that they have in the original's text."""
    from lexloom.plans.segment import span_layout

    original = relation(spark, sf_dir, "original")
    spans = span_layout(original.withColumnRenamed("pos", "seq"), "doc_id").withColumnRenamed("seq", "pos")
    return evals.round_trip(relation(spark, sf_dir, "stored").join(spans, ["doc_id", "pos"]), _whole(original), "doc_id")


_KINDS = """
    k AS (SELECT coalesce(o.ref, n.ref) AS ref, coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.ref IS NULL THEN 'added' WHEN n.ref IS NULL THEN 'removed' WHEN o.body = n.body THEN 'unchanged' ELSE 'amended' END AS kind
        FROM {old_version} o FULL OUTER JOIN {new_version} n ON n.ref = o.ref)"""


def _changes(spark, sf_dir):
    return evals.changes(relation(spark, sf_dir, "old_version"), relation(spark, sf_dir, "new_version"), ["ref"], "body")


@S.checked("m04_change_replay", f"""WITH {_KINDS}, c AS (SELECT count(*) AS replayed, count(*) FILTER (WHERE source_id % 9 = 0) AS lost, count(*) FILTER (WHERE source_id % 9 <> 0 AND source_id % 11 = 5 AND kind = 'removed') AS other FROM k WHERE kind <> 'unchanged')
    SELECT replayed - lost AS recorded, replayed, lost + other AS missing, other AS extra, lost + other = 0 AS passed FROM c""")
def _m04(spark, sf_dir):
    return evals.change_replay(relation(spark, sf_dir, "recorded_change"), _changes(spark, sf_dir), ["ref"])


@S.checked("m05_provenance", "SELECT source, count(*) AS artifacts, count(*) FILTER (WHERE doc_id % 97 = 5 OR doc_id % 101 = 7 OR text IS NULL) AS broken, count(*) FILTER (WHERE doc_id % 97 = 5 OR doc_id % 101 = 7 OR text IS NULL) = 0 AS passed FROM {documents} GROUP BY source")
def _m05(spark, sf_dir):
    return evals.provenance(relation(spark, sf_dir, "artifact"), "source", "text", "recorded")


@S.checked("m06_retrievability", f"""WITH {retrieval._BM25}, gold AS (SELECT item_id AS query_id, doc_id FROM {{benchmark}} b JOIN {{documents}} d ON contains(d.text, b.text) WHERE item_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM bm), h AS (SELECT DISTINCT gold.query_id FROM gold JOIN r ON r.query_id = gold.query_id AND r.doc_id = gold.doc_id WHERE place <= 5),
    n AS (SELECT (SELECT count(DISTINCT query_id) FROM gold) AS queries, (SELECT count(*) FROM h) AS hits)
    SELECT queries, hits, CASE WHEN queries > 0 THEN hits / queries END AS score, coalesce(CASE WHEN queries > 0 THEN hits / queries END >= 0.95, false) AS passed FROM n""")
def _m06(spark, sf_dir):
    """Every twentieth item as a query: a document that has it, word for word, must be among the first five."""
    items = relation(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("wanted"))
    golden = relation(spark, sf_dir, "documents").join(retrieval._few(items), F.contains("text", "wanted")).select("query_id", "doc_id")
    ranked = retrieval.top(retrieval._bm(spark, sf_dir).withColumn("score", F.round("score", 9)), "query_id", "score", "doc_id", 5)
    return evals.hits_at(golden, ranked)


_F1 = "b AS (SELECT o.doc_id, count(*) AS golden, count(*) FILTER (WHERE NOT (o.doc_id % 29 = 4 AND o.pos % 5 = 2)) AS hit FROM {original} o GROUP BY o.doc_id)"


def _boundaries(spark, sf_dir):
    return evals.boundary_f1(relation(spark, sf_dir, "original"), relation(spark, sf_dir, "stored"), "doc_id", "pos")


@S.checked("m10_boundary_f1", f"WITH {_F1} SELECT doc_id, hit, golden, hit AS parsed, CASE WHEN hit > 0 THEN 1.0::DOUBLE ELSE 0 END AS precision_, hit / golden AS recall_, 2 * hit / (golden + hit) AS f1, 2 * hit / (golden + hit) >= 0.98 AS passed FROM b")
def _m10(spark, sf_dir):
    return _boundaries(spark, sf_dir)


@S.checked("m11_boundary_suite", f"WITH {_F1} SELECT count(*) AS documents, round(avg(2 * hit / (golden + hit)), 9) AS mean, avg(2 * hit / (golden + hit)) >= 0.98 AS passed FROM b")
def _m11(spark, sf_dir):
    return evals.suite(_boundaries(spark, sf_dir), "f1", 0.98).withColumn("mean", F.round("mean", 9))


@S.checked("m12_basis_integrity", f"WITH {_KINDS} SELECT source_id, count(*) AS wanted, count(*) FILTER (WHERE kind = 'unchanged') AS covered, count(*) FILTER (WHERE kind = 'unchanged') / count(*) AS share, count(*) FILTER (WHERE kind <> 'unchanged') = 0 AS passed FROM k WHERE kind <> 'added' GROUP BY source_id")
def _m12(spark, sf_dir):
    """What was quoted from the old version still resolves in the new one, with the same hash."""
    basis = lambda name: relation(spark, sf_dir, name).withColumn("basis", F.sha2(F.concat_ws("/", "ref", F.col("body").cast("string")), 256))
    return evals.coverage(basis("old_version"), basis("new_version"), "basis", "source_id")


@S.checked("m13_extraction_quality", f"""WITH t AS (SELECT clause_id, {duties._EXPECT} IS NOT NULL AS duty FROM {{clause}}), c AS (SELECT count(*) FILTER (WHERE duty AND clause_id % 40 <> 9) AS tp, count(*) FILTER (WHERE duty AND clause_id % 40 = 9) AS fp, count(*) FILTER (WHERE NOT duty AND clause_id % 40 = 3) AS fn FROM t)
    SELECT tp, fp, fn, tp / (tp + fp) AS precision_, tp / (tp + fn) AS recall_, tp / (tp + fp) >= 0.75 AND tp / (tp + fn) >= 0.7 AS passed FROM c""")
def _m13(spark, sf_dir):
    """The grammar against reviewers who call some clauses duties that are none, and some duties none."""
    found = duties.extracted(relation(spark, sf_dir, "clause"))
    truth = F.expr(f"({duties._EXPECT}) IS NOT NULL")
    golden = F.when(F.col("clause_id") % 40 == 3, True).when(F.col("clause_id") % 40 == 9, False).otherwise(truth)
    return evals.confusion(found.select(F.col("modality").isNotNull().alias("said"), golden.alias("truth")), "said", "truth")


@S.checked("m14_normative_coverage", f"""WITH t AS (SELECT clause_id, source_key, {duties._EXPECT} AS m FROM {{clause}}), c AS (SELECT source_key, count(*) AS wanted, count(*) FILTER (WHERE clause_id IN (SELECT p_partkey FROM {{part}} WHERE p_partkey % 11 <> 0)) AS covered FROM t WHERE m IS NOT NULL GROUP BY source_key)
    SELECT source_key, wanted, covered, covered / wanted AS share, covered / wanted >= 0.99 AS passed FROM c""")
def _m14(spark, sf_dir):
    normative = duties.extracted(relation(spark, sf_dir, "clause")).where("modality is not null").select("source_key", F.col("clause_id").alias("obligation_id"))
    return evals.coverage(normative, relation(spark, sf_dir, "obligation").where("status <> 'stale'"), "obligation_id", "source_key", 0.99)


@S.checked("m16_duplicate_rate", f"WITH {similarity._PAIRS}, r AS (SELECT count(DISTINCT b) / (SELECT count(*) FROM {{documents}}) AS rate FROM p WHERE score >= 0.92) SELECT rate, rate < 0.01 AS passed FROM r")
def _m16(spark, sf_dir):
    docs = relation(spark, sf_dir, "documents")
    return evals.duplicate_rate(similarity._doubled(spark, sf_dir), docs, "b")


@S.checked("m17_change_inference", f"""WITH {_KINDS}, c AS (SELECT count(*) AS golden, count(*) FILTER (WHERE source_id % 30 <> 4 OR kind = 'unchanged') AS right_ FROM k)
    SELECT golden, right_ AS "right", right_ / golden AS accuracy, right_ / golden >= 0.95 AS passed FROM c""")
def _m17(spark, sf_dir):
    """Inferred kinds against labels in which one source in thirty is called unchanged throughout."""
    found = _changes(spark, sf_dir)
    source = F.substring_index("ref", "/", 1).cast("long")
    return evals.accuracy(found, found.withColumn("kind", F.when(source % 30 == 4, "unchanged").otherwise(F.col("kind"))), ["ref"])


@S.checked("m18_l3_completeness", "WITH c AS (SELECT count(*) AS wanted, count(*) FILTER (WHERE p_partkey IN (SELECT l_partkey FROM {lineitem})) AS covered FROM {part}) SELECT wanted, covered, covered / wanted AS share, covered = wanted AS passed FROM c")
def _m18(spark, sf_dir):
    return evals.coverage(relation(spark, sf_dir, "obligation"), relation(spark, sf_dir, "requires"), "obligation_id")


@S.checked("m20_reuse", "SELECT count(DISTINCT (l_partkey, l_suppkey)) / count(DISTINCT l_suppkey) AS reuse, count(DISTINCT l_suppkey) > 10 * count(DISTINCT l_partkey) AS explosion FROM {lineitem}")
def _m20(spark, sf_dir):
    return evals.reuse(relation(spark, sf_dir, "requires"))


@S.checked("m22_referential", "SELECT 'requires' AS edge, count(*) AS edges, count(*) FILTER (WHERE obligation_id % 11 = 0) AS dangling, count(*) FILTER (WHERE obligation_id % 11 = 0) = 0 AS passed FROM {requires} UNION ALL SELECT 'applies', count(*), count(*) FILTER (WHERE obligation_id % 11 = 0), count(*) FILTER (WHERE obligation_id % 11 = 0) = 0 FROM {edge}")
def _m22(spark, sf_dir):
    """Edges to duties that are stale, or unknown, hang in the air."""
    live = relation(spark, sf_dir, "obligation").where("status <> 'stale'")
    return evals.dangling({"requires": relation(spark, sf_dir, "requires"), "applies": relation(spark, sf_dir, "edge")}, live, "obligation_id")


@S.checked("m23_concept_integrity", """
    WITH f AS (SELECT source, min(doc_id) AS doc_id FROM {documents} GROUP BY source), w AS (SELECT d.source, d.doc_id, f.doc_id IS NOT NULL AS head, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS w FROM {documents} d LEFT JOIN f ON f.doc_id = d.doc_id AND f.source = d.source),
    i AS (SELECT source, doc_id, head, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM w), g AS (SELECT DISTINCT source, doc_id, head, array_to_string(w[i : i + 7], ' ') AS g FROM i),
    l AS (SELECT a.source, count(DISTINCT a.doc_id) AS leaks FROM g a JOIN g b ON b.source = a.source AND b.g = a.g AND b.head AND NOT a.head GROUP BY a.source), m AS (SELECT source, count(*) FILTER (WHERE NOT head) AS members FROM w GROUP BY source)
    SELECT m.source AS concept, members, coalesce(leaks, 0) AS leaks, members > 0 AND coalesce(leaks, 0) = 0 AS passed FROM m LEFT JOIN l ON l.source = m.source""")
def _m23(spark, sf_dir):
    """The first document of a source words its concept, the others are its members."""
    docs = relation(spark, sf_dir, "documents")
    first = docs.groupBy(F.col("source").alias("concept")).agg(F.min("doc_id").alias("doc_id"))
    concepts = docs.join(first, "doc_id").select("concept", "text")
    members = docs.join(first.select("doc_id"), "doc_id", "left_anti").select(F.col("source").alias("concept"), F.col("doc_id").alias("member"), "text")
    return evals.concept_integrity(concepts, members)


@S.checked("m32_number_echo", """SELECT clause_id, len(n) AS stated, len(list_distinct(list_filter(n, lambda x: x <> clause_id::VARCHAR))) AS foreign_, len(list_filter(n, lambda x: x <> clause_id::VARCHAR)) = 0 AS passed FROM (SELECT clause_id, regexp_extract_all(text, '([0-9]+)', 1) AS n FROM {clause}) x""")
def _m32(spark, sf_dir):
    """A clause may state its own number; what else it states is foreign."""
    found = evals.numbers_echo(relation(spark, sf_dir, "clause"), "clause_id", "text", F.array(F.col("clause_id").cast("string")))
    return found.withColumnRenamed("foreign", "foreign_")


@S.checked("b14_lint", """
    WITH n AS (SELECT source_key, clause_id % 12 AS t, CASE WHEN clause_id % 23 = 0 THEN NULL WHEN clause_id % 37 = 1 THEN 'sec-1' ELSE ref END AS ref FROM {clause})
    SELECT source_key, ref, 'duplicate ref' AS problem, count(*) AS n FROM n WHERE ref = 'sec-1' GROUP BY source_key, ref HAVING count(*) > 1
    UNION ALL SELECT source_key, NULL, 'no ref', count(*) FROM n WHERE ref IS NULL AND t <> 11 GROUP BY source_key
    UNION ALL SELECT source_key, ref, 'label repeated', count(*) FROM n WHERE t = 11 GROUP BY source_key, ref""")
def _b14(spark, sf_dir):
    return evals.lint(relation(spark, sf_dir, "node"), "source_key")


_LOST = "(doc_id % 29 = 4 AND pos % 5 = 2)"


@S.checked("b17_original_reread", f"SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE {_LOST} OR (doc_id % 31 = 6 AND pos = 0)) AS mismatches, count(*) FILTER (WHERE {_LOST} OR (doc_id % 31 = 6 AND pos = 0)) = 0 AS passed FROM {{original}} GROUP BY doc_id")
def _b17(spark, sf_dir):
    return evals.reread(relation(spark, sf_dir, "original"), relation(spark, sf_dir, "stored"), "doc_id")


@S.checked("b18_projection_bijection", f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_LOST}) AS lost FROM {{original}}) SELECT n - lost AS both_, lost AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS twice, lost = 0 AS passed FROM c")
def _b18(spark, sf_dir):
    found = evals.bijection(relation(spark, sf_dir, "original"), relation(spark, sf_dir, "stored"), ["doc_id", "pos"])
    return found.withColumnRenamed("both", "both_")


@S.checked("b19_projection_matches", f"WITH c AS (SELECT count(*) FILTER (WHERE {_LOST}) AS lost, count(*) FILTER (WHERE NOT {_LOST} AND doc_id % 31 = 6 AND pos = 0) AS other FROM {{original}}) SELECT lost + other AS missing, other AS extra, lost + other = 0 AS passed FROM c")
def _b19(spark, sf_dir):
    return evals.same_rows(relation(spark, sf_dir, "stored"), relation(spark, sf_dir, "original"))



_PASS = "cast({0} AS DOUBLE) / nullif({1}, 0)"
S.portable("m02_completeness", "SELECT source_id, count(n_ref) / cast(count(*) AS DOUBLE) >= 0.995 AS passed FROM (SELECT o.source_id, n.ref AS n_ref FROM {old_version} o LEFT JOIN {new_version} n ON n.ref = o.ref) x GROUP BY source_id")
S.portable("m07_closure", "SELECT l_orderkey % 10 AS bucket, count(CASE WHEN o.o_orderkey IS NULL THEN 1 END) AS unexplained FROM {lineitem} l LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P' GROUP BY l_orderkey % 10")
S.portable("m08_family_completeness", "SELECT r.r_name, cast(count(DISTINCT s.s_nationkey) AS DOUBLE) / count(DISTINCT n.n_nationkey) AS completeness FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey LEFT JOIN {supplier} s ON s.s_nationkey = n.n_nationkey GROUP BY r.r_name")
S.portable("m09_currency", "SELECT record_id, [[percentile(lag_h, 0.5)||quantile_cont(lag_h, 0.5)]] AS median_hours, [[percentile(lag_h, 0.5)||quantile_cont(lag_h, 0.5)]] <= 24 AS passed FROM (SELECT record_id, coalesce(cast([[unix_seconds(cast(valid_from AS TIMESTAMP)) - unix_seconds(cast(lag(valid_from) OVER w AS TIMESTAMP))||epoch(date_trunc('second', valid_from))::BIGINT - epoch(date_trunc('second', lag(valid_from) OVER w))::BIGINT]] AS DOUBLE) / 3600, 0) AS lag_h FROM {history} WINDOW w AS (PARTITION BY record_id ORDER BY valid_from, id)) x GROUP BY record_id")
S.portable("m15_review_precision", "SELECT avg(cast(quality AS DOUBLE)) AS precision_, avg(cast(quality AS DOUBLE)) >= 0.95 AS passed FROM {labels} WHERE toxic = 0")
S.portable("m19_characteristics", "SELECT kind, avg(CASE WHEN status = 'curated' THEN cast(1 AS DOUBLE) ELSE 0 END) >= 0.95 AS passed FROM {block} GROUP BY kind")
S.portable("m21_expert_precision", "SELECT d.source, avg(cast(l.quality AS DOUBLE)) AS precision_ FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.source")
S.portable("m24_licence_grounding", "SELECT p_type AS licence, count(*) AS anchors, count(CASE WHEN s_suppkey IS NULL THEN 1 END) AS missing FROM {part} LEFT JOIN {supplier} ON s_suppkey = p_partkey % 120 GROUP BY p_type")
S.portable("m25_applicability_edges", "SELECT e.basis, count(*) AS edges, count(CASE WHEN o.status = 'stale' THEN 1 END) AS dead FROM {edge} e JOIN {obligation} o ON o.obligation_id = e.obligation_id GROUP BY e.basis")
S.portable("m26_junction_completeness", "SELECT b.kind, avg(CASE WHEN h.block_id IS NULL THEN cast(0 AS DOUBLE) ELSE 1 END) AS lit FROM {block} b LEFT JOIN (SELECT DISTINCT block_id FROM {hard_requires}) h ON h.block_id = b.block_id GROUP BY b.kind")
S.portable("m27_citation", "SELECT avg(CASE WHEN instr(text, cast(clause_id AS VARCHAR(19))) > 0 THEN cast(1 AS DOUBLE) ELSE 0 END) AS cited FROM {clause}")
S.portable("m28_composition_completeness", "SELECT o_custkey % 20 AS bucket, cast(count(r.block_id) AS DOUBLE) / count(*) AS ratio FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey LEFT JOIN {hard_requires} r ON r.obligation_id = l_partkey AND r.block_id = l_suppkey GROUP BY o_custkey % 20")
S.portable("m29_minimality", "SELECT block_id, count(CASE WHEN n = 1 THEN 1 END) > 0 AS bears FROM (SELECT block_id, count(*) OVER (PARTITION BY obligation_id) AS n FROM {requires}) x GROUP BY block_id")
S.portable("m30_reference_f1", "SELECT round(cast(2 * count(CASE WHEN h.block_id IS NOT NULL AND r.block_id IS NOT NULL THEN 1 END) AS DOUBLE) / (count(h.block_id) + count(r.block_id)), 6) AS f1 FROM {requires} r FULL OUTER JOIN {hard_requires} h ON h.obligation_id = r.obligation_id AND h.block_id = r.block_id")
S.portable("m31_explanation", "SELECT round(sum(length(text) * CASE WHEN text LIKE '%.' THEN cast(1 AS DOUBLE) ELSE 0 END) / sum(length(text)), 6) AS weighted FROM {clause}")
S.portable("m33_linker", "SELECT avg(CASE WHEN o.status <> 'stale' THEN cast(1 AS DOUBLE) ELSE 0 END) AS precision_, count(CASE WHEN o.obligation_id IS NULL THEN 1 END) AS dangling FROM {outcome} e LEFT JOIN {obligation} o ON o.obligation_id = e.obligation_id")
S.portable("m34_brier_published", "SELECT round(avg((value / 100 - CASE WHEN event_type = 'error' THEN cast(1 AS DOUBLE) ELSE 0 END) * (value / 100 - CASE WHEN event_type = 'error' THEN cast(1 AS DOUBLE) ELSE 0 END)), 6) AS brier FROM {events}")
S.portable("m35_k_anonymity", "SELECT bool_and(n >= 5) AS passed, count(*) AS cohorts FROM (SELECT cohort, count(DISTINCT member) AS n FROM {input} GROUP BY cohort) x")
S.portable("m36_reidentification", "SELECT count(*) AS at_risk FROM (SELECT a.cohort, b.cohort AS other, count(*) AS n FROM (SELECT DISTINCT cohort, member FROM {input}) a JOIN (SELECT DISTINCT cohort, member FROM {input}) b ON b.member = a.member AND b.cohort <> a.cohort GROUP BY a.cohort, b.cohort) x WHERE n < 5")
S.portable("m37_traceability", "SELECT cast(count(CASE WHEN o.status <> 'stale' THEN 1 END) AS DOUBLE) / count(*) AS traced FROM {requires} r JOIN {obligation} o ON o.obligation_id = r.obligation_id")
S.portable("m38_fill_rubric", "SELECT block_id FROM {block} WHERE status = 'curated' AND kind <> 'Body'")
_SUITES = "(SELECT 'L1' AS layer, 'signup' AS suite UNION ALL SELECT 'L1', 'view' UNION ALL SELECT 'L2', 'purchase' UNION ALL SELECT 'L2', 'nightly' UNION ALL SELECT 'L3', 'click')"
_LAST = "(SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM {events}) y WHERE n = 1)"
S.portable("m39_gate_status", f"SELECT s.layer, bool_and(coalesce(r.value >= 0, false)) AS open_, count(r.value) AS present FROM {_SUITES} s LEFT JOIN {_LAST} r ON r.event_type = s.suite GROUP BY s.layer")
S.portable("m40_gate_map", f"SELECT layer, count(*) AS suites, {joined('suite')} AS names FROM {_SUITES} s GROUP BY layer")
S.portable("m41_release_gate", f"SELECT bool_and(coalesce(r.value >= 0, false)) AS release FROM {_SUITES} s LEFT JOIN {_LAST} r ON r.event_type = s.suite")
S.portable("m42_source_scorecard", "SELECT user_id AS source_id, event_type AS suite, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM {events}) x WHERE n = 1")
S.portable("m43_scope_proof", "SELECT 'requires in obligations' AS proof, count(*) = 0 AS holds FROM (SELECT obligation_id FROM {requires} EXCEPT SELECT obligation_id FROM {obligation}) a UNION ALL SELECT 'edges in obligations', count(*) = 0 FROM (SELECT obligation_id FROM {edge} EXCEPT SELECT obligation_id FROM {obligation}) b UNION ALL SELECT 'hard in requires', count(*) = 0 FROM (SELECT obligation_id, block_id FROM {hard_requires} EXCEPT SELECT obligation_id, block_id FROM {requires}) c UNION ALL SELECT 'obligations in clauses', count(*) = 0 FROM (SELECT obligation_id FROM {obligation} EXCEPT SELECT clause_id FROM {clause}) d")
S.portable("m44_smoke", "SELECT 'clauses' AS what, count(*) > 0 AS ok FROM {clause} UNION ALL SELECT 'events', count(*) > 0 FROM {events}")

S.portable("b16_salvage", "SELECT clause_id, 'note' AS kind FROM {clause} WHERE text = 'Reserved.' UNION ALL SELECT clause_id, 'clause' FROM {clause} WHERE text <> 'Reserved.'")
S.portable("b20_artifact_set_hash", f"SELECT source_key, [[sha2(||sha256(]]{joined('ref')}[[, 256)||)]] AS set_hash FROM {{clause}} GROUP BY source_key")
S.portable("b25_ensure_source", "SELECT source_key, min(clause_id) AS first_clause, max(version_year) AS last_year FROM {clause} GROUP BY source_key")
S.portable("b26_preview", "SELECT clause_id, text FROM {clause} ORDER BY clause_id LIMIT 16")
S.portable("b27_locators", "SELECT p.page_id, p.url, length(p.html) AS bytes_ FROM {pages} p")
