"""Duties read from clauses: detection, structure, triage, changes and review (D, B11, B21, E, F1-F5, H1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import grammar as g
from lexloom.functions import text as tx
from lexloom.plans.portable import Suite, joined, pattern, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles


def extracted(clauses):
    """Clauses with their duty, its confidence and its structure; one narrow pass without a shuffle.

    What several columns need is a column of its own first: the optimiser
    doesn't repeat a costly expression, and generated code stays small.
    Null and short texts state no duty and have null or empty parts.
    """
    t, h = F.col("text"), F.col("heading")
    kept = clauses.columns
    read = g.staged(clauses, {"_lead": g.before(t, g.ANY_MODAL), "_strongest": g.modality(t), "_modal": F.lower(F.regexp_extract(t, "(?i)" + g.MODAL, 1)), "_head": g.before(t, g.MODAL)})
    rest = F.trim(F.substring(t, F.length("_head") + F.length("_modal") + 1, F.length(t)))
    duty = F.when((F.length(F.trim(t)) >= 40) & ~g.not_a_duty(t, h, F.col("_lead")), F.col("_strongest"))
    start = F.when(F.col("_strongest").isNotNull(), g.duty_start(t))
    parts = g.structure(t, F.col("_modal"), F.col("_head"), rest)
    found = g.staged(read, {"modality": duty, "start_": start} | parts).select(*kept, "modality", "start_", *parts)
    return found.withColumns({
        "confidence": g.confidence(t, F.col("modality"), F.col("start_")),
        "obligation_type": F.when(F.col("modality").isNotNull(), g.verb(F.col("action"), F.col("modality"))),
        "determination": g.determination(F.col("subject"), F.col("modal"), F.col("action"), F.col("condition"), t),
    })


# what the twelve sentence patterns of the fixture state, by hand
_EXPECT = """
    CASE WHEN clause_id % 17 = 0 OR clause_id % 19 = 0 THEN NULL ELSE CASE clause_id % 12 WHEN 0 THEN 'must' WHEN 1 THEN 'must-not' WHEN 2 THEN 'must' WHEN 5 THEN 'shall' WHEN 7 THEN 'required' WHEN 8 THEN 'shall' WHEN 9 THEN 'must' END END"""
_PREFIX = "length(regexp_extract(text, '(?is)^(.*?)\\b(?:must not|shall not|may not|must|shall|is required to)\\b', 1))"


@S.checked("d01_heading_words", "SELECT clause_id, CASE WHEN clause_id % 17 = 0 THEN 'Scope and definitions' WHEN clause_id % 19 = 0 THEN 'Penalties' ELSE 'Handling of goods' END AS words FROM {clause}")
def _d01(spark, sf_dir):
    return relation(spark, sf_dir, "clause").select("clause_id", g.heading_words(F.col("heading")).alias("words"))


@S.checked("d02_not_a_duty", "SELECT clause_id, clause_id % 17 = 0 OR clause_id % 19 = 0 OR clause_id % 12 IN (3, 10) AS not_a_duty FROM {clause}")
def _d02(spark, sf_dir):
    return relation(spark, sf_dir, "clause").select("clause_id", g.not_a_duty(F.col("text"), F.col("heading")).alias("not_a_duty"))


@S.checked("d03_detect_duty", f"""
    WITH d AS (SELECT clause_id, text, {_EXPECT} AS modality, {_PREFIX} AS start FROM {{clause}})
    SELECT clause_id, modality, round(CASE WHEN modality IN ('must', 'must-not', 'prohibited') THEN 0.85 ELSE 0.75 END - CASE WHEN start > 0.6 * length(text) THEN 0.15 ELSE 0 END - CASE WHEN length(text) < 120 THEN 0.1 ELSE 0 END, 2)::DOUBLE AS confidence
    FROM d WHERE modality IS NOT NULL""")
def _d03(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("modality is not null").select("clause_id", "modality", "confidence")


@S.checked("d04_modalities", f"SELECT source_key, modality, count(*) AS n FROM (SELECT source_key, {_EXPECT} AS modality FROM {{clause}}) x WHERE modality IS NOT NULL GROUP BY source_key, modality")
def _d04(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("modality is not null").groupBy("source_key", "modality").agg(F.count("*").alias("n"))


@S.checked("d05_sentence_with_lead_in", "SELECT clause_id, concat('Goods shall be ', 'kept dry on floor ', cast(clause_id % 9 AS VARCHAR)) AS sentence FROM {clause} WHERE clause_id % 12 = 5")
def _d05(spark, sf_dir):
    c = relation(spark, sf_dir, "clause").where("clause_id % 12 = 5")
    lead, item = F.lit("Goods shall be:"), F.concat(F.lit("(a) kept dry on floor "), (F.col("clause_id") % 9).cast("string"))
    marker = r"(?i)^\s*(?:\((?:[0-9]{1,3}[a-z]?|[a-z]{1,2}|[ivxlc]{1,6})\)|[a-z]\)|[-•*–])\s*"
    return c.select("clause_id", F.concat(F.regexp_replace(lead, "[ :—-]+$", ""), F.lit(" "), F.regexp_replace(item, marker, "")).alias("sentence"))


@S.checked("d06_extract_candidates", f"SELECT clause_id, source_key, ref, modality FROM (SELECT *, {_EXPECT} AS modality FROM {{clause}}) x WHERE modality IS NOT NULL AND clause_id % 10 <> 0 AND clause_id NOT IN (SELECT clause_id - 1 FROM {{clause}} WHERE clause_id % 100 = 1)")
def _d06(spark, sf_dir):
    """Public leaf clauses only: containers go by an anti join."""
    c = relation(spark, sf_dir, "clause")
    containers = c.where("clause_id % 100 = 1").select((F.col("clause_id") - 1).alias("clause_id"))
    return extracted(c.where("clause_id % 10 <> 0").join(containers, "clause_id", "left_anti")).where("modality is not null").select("clause_id", "source_key", "ref", "modality")


@S.checked("d07_rederive", f"""
    WITH c AS (SELECT clause_id, {_EXPECT} AS modality FROM {{clause}}), a AS (SELECT clause_id, CASE WHEN clause_id % 4 = 0 THEN 'shall' ELSE modality END AS modality FROM c WHERE modality IS NOT NULL AND clause_id % 3 <> 0), b AS (SELECT clause_id, modality FROM c WHERE modality IS NOT NULL AND clause_id % 7 <> 0)
    SELECT coalesce(a.clause_id, b.clause_id) AS clause_id, CASE WHEN a.clause_id IS NULL THEN 'insert' WHEN b.clause_id IS NULL THEN 'revoked' WHEN a.modality <> b.modality THEN 're-derive' ELSE 'unchanged' END AS action FROM a FULL OUTER JOIN b ON a.clause_id = b.clause_id""")
def _d07(spark, sf_dir):
    c = extracted(relation(spark, sf_dir, "clause")).where("modality is not null").select("clause_id", "modality")
    a = c.where("clause_id % 3 <> 0").select("clause_id", F.when(F.col("clause_id") % 4 == 0, "shall").otherwise(F.col("modality")).alias("before"))
    b = c.where("clause_id % 7 <> 0").select("clause_id", F.col("modality").alias("after"))
    action = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "revoked").when(F.col("before") != F.col("after"), "re-derive").otherwise("unchanged")
    return a.join(b, "clause_id", "full_outer").select("clause_id", action.alias("action"))


@S.checked("d09_duty_sentence", "SELECT clause_id, text AS span FROM {clause} WHERE clause_id % 12 IN (0, 1, 2, 3, 4, 5, 7, 8, 9, 10)")
def _d09(spark, sf_dir):
    c = relation(spark, sf_dir, "clause").withColumn("text", F.concat(F.col("text"), F.lit(" See Annex One for details.")))
    sentences = F.split(F.col("text"), r"(?<=[.;:])\s+(?=[A-Z(\d])")
    return c.select("clause_id", F.get(F.filter(sentences, lambda s: g.has(s, g.MODAL)), F.lit(0)).alias("span")).where("span is not null")


@S.checked("d10_parse_structure", """
    SELECT clause_id, CASE clause_id % 12 WHEN 0 THEN concat(seg, ' supplier') WHEN 1 THEN concat(seg, ' carrier') WHEN 2 THEN 'it' WHEN 7 THEN concat(seg, ' supplier') ELSE concat(seg, ' operator') END AS subject,
        CASE clause_id % 12 WHEN 0 THEN 'must' WHEN 1 THEN 'shall not' WHEN 2 THEN 'must' WHEN 7 THEN 'is required to' ELSE 'must' END AS modal,
        CASE clause_id % 12 WHEN 1 THEN 'unless the owner of the goods has agreed in writing' WHEN 2 THEN concat('Where a ', seg, ' dealer holds goods of others') ELSE '' END AS condition
    FROM (SELECT c.clause_id, lower(c_mktsegment) AS seg FROM {clause} c JOIN {orders} ON o_orderkey = c.clause_id JOIN {customer} ON c_custkey = o_custkey) x WHERE clause_id % 12 IN (0, 1, 2, 7, 9)""")
def _d10(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 in (0, 1, 2, 7, 9)").select("clause_id", "subject", "modal", "condition")


@S.checked("d11_duty_verb", f"SELECT clause_id, CASE clause_id % 12 WHEN 0 THEN 'ship' WHEN 1 THEN 'not disclose' WHEN 2 THEN 'insure' WHEN 5 THEN 'be weighed' WHEN 7 THEN 'appoint' WHEN 8 THEN 'be unlawful' ELSE 'review' END AS verb FROM (SELECT clause_id, {_EXPECT} AS modality FROM {{clause}}) x WHERE modality IS NOT NULL")
def _d11(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("modality is not null").select("clause_id", F.col("obligation_type").alias("verb"))


@S.checked("d12_determination", """
    SELECT c.clause_id, concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)), ' carrier shall not disclose the contents of consignment ', cast(c.clause_id AS VARCHAR), ', unless the owner of the goods has agreed in writing.') AS determination
    FROM {clause} c JOIN {orders} ON o_orderkey = c.clause_id JOIN {customer} ON c_custkey = o_custkey WHERE c.clause_id % 12 = 1""")
def _d12(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 = 1").select("clause_id", "determination")


@S.checked("d13_structured_fields", f"SELECT source_key, count(*) AS duties, count(DISTINCT clause_id % 12) AS patterns FROM (SELECT *, {_EXPECT} AS modality FROM {{clause}}) x WHERE modality IS NOT NULL GROUP BY source_key")
def _d13(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("modality is not null and action <> '' and modal <> ''").groupBy("source_key").agg(F.count("*").alias("duties"), F.countDistinct(F.col("clause_id") % 12).alias("patterns"))


@S.checked("d14_binds_subject", f"SELECT clause_id, clause_id % 12 NOT IN (5, 8) AS binds FROM (SELECT clause_id, {_EXPECT} AS modality FROM {{clause}}) x WHERE modality IS NOT NULL")
def _d14(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("modality is not null").select("clause_id", g.binds(F.col("action")).alias("binds"))


@S.checked("d15_universal_addressee", f"SELECT clause_id, clause_id % 12 IN (2, 8) AS universal FROM (SELECT clause_id, {_EXPECT} AS modality FROM {{clause}}) x WHERE modality IS NOT NULL")
def _d15(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("modality is not null").select("clause_id", g.universal(F.col("subject")).alias("universal"))


@S.checked("d16_field_quotes", "SELECT clause_id, strpos(text, 'shall not disclose') - 1 + length('shall not ') AS start_, strpos(text, ' unless') - 1 AS end_ FROM {clause} WHERE clause_id % 12 = 1 AND clause_id % 17 <> 0 AND clause_id % 19 <> 0")
def _d16(spark, sf_dir):
    d = extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 = 1 and modality is not null")
    at = F.expr("instr(text, action) - 1")
    return d.select("clause_id", at.cast("bigint").alias("start_"), (at + F.length("action")).cast("bigint").alias("end_"))


S.portable("d17_structure_evidence", "SELECT clause_id, instr(text, 'supplier') > 0 AS has_subject, instr(text, 'days') > 0 AS has_period FROM {clause} WHERE clause_id % 12 IN (0, 7)")
S.portable("d08_release_derived", "SELECT r.obligation_id, r.block_id FROM {requires} r JOIN {obligation} o ON o.obligation_id = r.obligation_id WHERE o.status = 'stale'")
S.portable("d18_assert_edges", "SELECT clause_id, source_key, row_number() OVER (PARTITION BY source_key ORDER BY version_year, clause_id) AS version, lead(clause_id) OVER (PARTITION BY source_key ORDER BY version_year, clause_id) IS NULL AS live FROM {clause}")
S.portable("d19_change_events", "SELECT coalesce(o.ref, n.ref) AS ref, CASE WHEN o.ref IS NULL THEN 'added' WHEN n.ref IS NULL THEN 'revoked' ELSE 'updated' END AS kind, concat('CHG-', coalesce(o.ref, n.ref)) AS event_key FROM {old_version} o FULL OUTER JOIN {new_version} n ON o.ref = n.ref WHERE o.body IS NULL OR n.body IS NULL OR o.body <> n.body")
S.portable("d20_supersession_record", "SELECT id, lead(id) OVER (PARTITION BY record_id ORDER BY valid_from, id) AS superseded_by FROM {history}")


@S.checked("d21_weak_candidates", "SELECT clause_id FROM {clause} WHERE clause_id % 12 = 4 AND clause_id % 17 <> 0 AND clause_id % 19 <> 0 AND clause_id % 8 <> 0")
def _d21(spark, sf_dir):
    c = relation(spark, sf_dir, "clause")
    t, h = F.col("text"), F.col("heading")
    known = c.where("clause_id % 8 = 0").select("clause_id")
    weak = c.where(g.duty(t, h).isNull() & ~g.not_a_duty(t, h) & g.has(t, g.WEAK_MODAL) & (F.length(F.trim(t)) >= 40))
    return weak.join(known, "clause_id", "left_anti").select("clause_id")


S.portable("d22_span_grounded", "SELECT clause_id, length('the contents of') >= 12 AND instr(lower(text), 'the contents of') > 0 AS grounded FROM {clause}")
S.portable("d23_triage_acceptance", "SELECT c.clause_id FROM {clause} c JOIN (SELECT o_orderkey AS clause_id, CASE WHEN o_orderkey % 2 = 0 THEN 'should attend training' ELSE 'should never happen' END AS span FROM {orders} WHERE o_orderkey % 12 = 4) p ON p.clause_id = c.clause_id WHERE instr(lower(c.text), p.span) > 0")
S.portable("d24_structure_repair", "SELECT c.clause_id, p.subject FROM {clause} c JOIN (SELECT o_orderkey AS clause_id, CASE WHEN o_orderkey % 3 = 0 THEN 'supplier' ELSE 'harbour' END AS subject FROM {orders}) p ON p.clause_id = c.clause_id WHERE instr(c.text, p.subject) > 0")


@S.checked("d25_grounded_share", """
    WITH p AS (SELECT c.clause_id, regexp_extract_all(lower(c.text), '([a-z0-9]+)', 1) AS w, regexp_extract_all(lower('register of deliveries to the harbour master'), '([a-z0-9]+)', 1) AS f FROM {clause} c)
    SELECT clause_id, len(list_filter(f, lambda x: list_contains(w, x))) / len(f) >= 0.5 AS grounded FROM p""")
def _d25(spark, sf_dir):
    field = tx.tokens(F.lit("register of deliveries to the harbour master"))
    w = tx.tokens(F.col("text"))
    return relation(spark, sf_dir, "clause").select("clause_id", (F.size(F.filter(field, lambda x: F.array_contains(w, x))) / F.size(field) >= 0.5).alias("grounded"))


@S.checked("d36_infer_clause_change", f"""
    WITH c AS (SELECT clause_id, {_EXPECT} AS m FROM {{clause}}) SELECT clause_id, CASE clause_id % 4 WHEN 0 THEN 'revoked' WHEN 1 THEN 'updated' ELSE 'none' END AS kind, CASE clause_id % 4 WHEN 0 THEN 'substantive' WHEN 1 THEN 'substantive' WHEN 2 THEN 'editorial' ELSE 'n/a' END AS materiality
    FROM c WHERE m IS NOT NULL AND clause_id % 12 IN (0, 7, 9, 2, 1, 5)""")
def _d36(spark, sf_dir):
    """Old and new text of a clause; the new one is dropped, has another number, has more function words, or is equal."""
    old, h = F.col("text"), F.col("heading")
    new = F.when(F.col("clause_id") % 4 == 0, F.lit("")).when(F.col("clause_id") % 4 == 1, F.concat(old, F.lit(" The limit is 77 days.")))
    new = new.when(F.col("clause_id") % 4 == 2, F.concat(old, F.lit(" All of it."))).otherwise(F.concat(old, F.lit("  ")))
    c = extracted(relation(spark, sf_dir, "clause")).where("modality is not null and clause_id % 12 in (0, 7, 9, 2, 1, 5)").withColumn("new", new)
    still = g.duty(F.col("new"), h).isNotNull()
    numbers = lambda x: F.array_sort(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)))
    a, b = tx.duty_words(old), tx.duty_words(F.col("new"))
    apart = 1 - tx.jaccard(a, b)
    same = tx.fold_space(old) == tx.fold_space(F.col("new"))
    moved = (numbers(old) != numbers(F.col("new"))) | (apart > 0.15)
    kind = F.when(~still, "revoked").when(same, "none").when(moved, "updated").otherwise("none")
    weight = F.when(~still, "substantive").when(same, "n/a").when(moved, "substantive").otherwise("editorial")
    return c.select("clause_id", kind.alias("kind"), weight.alias("materiality"))


S.portable("d39_on_source_changed", "SELECT source_id, count(*) AS clauses, count(CASE WHEN body > 300000 THEN 1 END) AS rederived FROM {new_version} GROUP BY source_id")
S.portable("d40_revoke_expired", "SELECT o_orderkey AS obligation_id, cast(o_orderdate AS DATE) AS effective_to FROM {orders} WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus <> 'F'")
S.portable("d41_nightly_pass", "SELECT record_id, max(id) AS last_change FROM {history} WHERE valid_from >= TIMESTAMP '2024-01-25 00:00:00' AND state = 'error' GROUP BY record_id")
S.portable("d42_review_queue", "SELECT o.obligation_id FROM {obligation} o WHERE o.status = 'derived' AND o.obligation_id NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49) ORDER BY o.confidence NULLS FIRST, o.obligation_id LIMIT 100")
S.portable("d43_review_precision", """
    SELECT source, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / cast(count(*) AS DOUBLE) AS precision_, count(*) AS reviewed FROM (SELECT d.source, l.quality, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.toxic DESC, l.quality DESC) AS n FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id) x WHERE n = 1 GROUP BY source""")
S.portable("d44_expert_reviews", "SELECT doc_id, quality, toxic, concat('REV-', cast(doc_id AS VARCHAR(19))) AS review_id FROM {labels} WHERE quality = 0")


@S.checked("b11_normative_flag", """
    SELECT clause_id, CASE WHEN clause_id % 7 = 0 THEN true WHEN clause_id % 7 = 1 THEN false WHEN regexp_matches(text, '^In this part', 'i') THEN false ELSE regexp_matches(text, '\\b(must|shall|required)\\b', 'i') END AS normative FROM {clause}""")
def _b11(spark, sf_dir):
    t = F.col("text")
    hint = F.when(F.col("clause_id") % 7 == 0, "R").when(F.col("clause_id") % 7 == 1, "G")
    flag = F.when(hint.isin("R", "D", "UK", "EU"), True).when(hint.isin("G", "E", "C"), False).when(g.has(t, "^In this part"), False).otherwise(g.has(t, r"\b(?:must|shall|required)\b"))
    return relation(spark, sf_dir, "clause").select("clause_id", flag.alias("normative"))


S.portable("b21_annotate", f"""
    SELECT clause_id, CASE WHEN heading LIKE '%definitions%' THEN 'definition' WHEN heading LIKE '%Penalties%' THEN 'enforcement' WHEN text LIKE '%means%' THEN 'definition' WHEN text LIKE '%must%' OR text LIKE '%shall%' OR text LIKE '%required%' THEN 'requirement' ELSE 'other' END AS label FROM {{clause}}""")
S.portable("b22_annotate_version", "SELECT source_key, version_year, count(CASE WHEN text LIKE '%must%' OR text LIKE '%shall%' THEN 1 END) AS requirements, count(*) AS clauses FROM {clause} GROUP BY source_key, version_year")


@S.checked("f01_measure_kind", "SELECT clause_id, CASE clause_id % 12 WHEN 7 THEN 'Role' WHEN 0 THEN 'Unspecified' WHEN 2 THEN 'Unspecified' ELSE 'Unspecified' END AS kind FROM {clause} WHERE clause_id % 12 IN (0, 2, 7, 9)")
def _f01(spark, sf_dir):
    d = extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 in (0, 2, 7, 9)")
    first = F.split("action", " ")[0]
    return d.select("clause_id", g.measure_kind(first, F.expr("substring(action, length(split(action, ' ')[0]) + 2)")).alias("kind"))


S.portable("f02_kind_schemas", "SELECT kind, field_ FROM (SELECT 'Document' AS kind, 'owner' AS field_ UNION ALL SELECT 'Document', 'review_cadence' UNION ALL SELECT 'Document', 'approver' UNION ALL SELECT 'System', 'capability' UNION ALL SELECT 'Role', 'seniority' UNION ALL SELECT 'Body', 'quorum' UNION ALL SELECT 'Process', 'cadence') x")


@S.checked("f03_measure_phrase", """
    SELECT clause_id, CASE clause_id % 12 WHEN 0 THEN concat('ship order ', cast(clause_id AS VARCHAR)) WHEN 7 THEN concat('appoint an officer for site ', cast(clause_id AS VARCHAR)) ELSE concat('insure consignment ', cast(clause_id AS VARCHAR), ' for') END AS phrase FROM {clause} WHERE clause_id % 12 IN (0, 7, 2)""")
def _f03(spark, sf_dir):
    return extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 in (0, 7, 2)").select("clause_id", g.measure_phrase(F.col("action")).alias("phrase"))


@S.checked("f04_propose_block", "SELECT clause_id, CASE clause_id % 12 WHEN 5 THEN concat('Goods of class ', cast(clause_id AS VARCHAR), ': weighed') ELSE concat('Ship order ', cast(clause_id AS VARCHAR)) END AS name, CASE clause_id % 12 WHEN 5 THEN 'Unspecified' ELSE 'Process' END AS kind FROM {clause} WHERE clause_id % 12 IN (0, 5)")
def _f04(spark, sf_dir):
    d = extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 in (0, 5)")
    passive = F.lower("action").startswith("be ")
    phrase = g.measure_phrase(F.when(passive, F.regexp_replace("action", "^(?i)be ", "")).otherwise(F.col("action")))
    name = F.when(passive, F.concat("subject", F.lit(": "), phrase)).otherwise(F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, 2, 400)))
    return d.select("clause_id", name.alias("name"), F.when(passive, "Unspecified").otherwise("Process").alias("kind"))


@S.checked("f05_prohibition_name", "SELECT clause_id, concat('Shall not disclose the contents of consignment ', cast(clause_id AS VARCHAR)) AS name FROM {clause} WHERE clause_id % 12 = 1")
def _f05(spark, sf_dir):
    d = extracted(relation(spark, sf_dir, "clause")).where("clause_id % 12 = 1")
    name = F.concat_ws(" ", "modal", g.measure_phrase(F.col("action")))
    return d.select("clause_id", F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 400)).alias("name"))


@S.checked("h01_read_activity", "SELECT clause_id, clause_id % 12 NOT IN (2, 5, 8) AS has_operator FROM (SELECT clause_id, " + _EXPECT + " AS modality FROM {clause}) x WHERE modality IS NOT NULL")
def _h01(spark, sf_dir):
    d = extracted(relation(spark, sf_dir, "clause")).where("modality is not null")
    return d.select("clause_id", (g.binds(F.col("action")) & ~g.universal(F.col("subject")) & (F.col("subject") != "")).alias("has_operator"))
