"""Versions: diffs, latest and in-force states, citations, families, rights (C, N1-N3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.plans.portable import Suite, joined, pattern, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles


def diff(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """``key, change`` of two versions: added, removed or amended; equal rows are left out.

    One full outer join on the key; both sides are aggregated before, so a
    key that is hot in the raw data is one row here.
    """
    a = old.select(F.col(key), F.col(body).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.col(body).alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "amended")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key: a running maximum of a struct, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)
    return df.groupBy(key).agg(F.max(packed).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def scd2(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Adds ``version``, ``valid_to`` and ``status``: each row is in force until the next of its key."""
    w = Window.partitionBy(key).orderBy(at, tie)
    after = F.lead(at).over(w)
    return df.withColumns({
        "version": F.row_number().over(w), "valid_to": after,
        "status": F.when(after.isNull(), "in_force").otherwise("superseded"),
    })


def in_force(df: DataFrame, day: Column, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows with ``start <= day < end``; a missing bound is open."""
    return df.where((F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) > day)))


def as_of(facts: DataFrame, grants: DataFrame, key: str, fact_at: str, grant_at: str, tie: str, carry: list[str]) -> DataFrame:
    """Each fact with the last grant of its key at or before it, by one union and a running window.

    No range join: facts and grants are sorted together once, and the last
    grant is carried forward, so the cost doesn't depend on how many grants a
    key has.
    """
    order = [*[F.col(c).cast(grants.schema[c].dataType).alias(c) for c in carry]]
    f = facts.select("*", F.lit(1).alias("_is"), F.col(fact_at).alias("_at"), *[F.lit(None).cast(grants.schema[c].dataType).alias(f"g_{c}") for c in carry])
    g = grants.select(F.col(key), F.lit(0).alias("_is"), F.col(grant_at).alias("_at"), F.col(tie).alias("_tie"), F.struct(*order).alias("_g"))
    both = f.drop(*[f"g_{c}" for c in carry]).unionByName(g, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_is", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_g", ignorenulls=True).over(w)).where("_is = 1")
    return seen.select(*facts.columns, *[F.col(f"_last.{c}").alias(f"g_{c}") for c in carry])


@S.checked("c01_clause_diff", """
    SELECT coalesce(o.ref, n.ref) AS ref, CASE WHEN o.ref IS NULL THEN 'added' WHEN n.ref IS NULL THEN 'removed' ELSE 'amended' END AS change
    FROM {old_version} o FULL OUTER JOIN {new_version} n ON o.ref = n.ref WHERE o.ref IS NULL OR n.ref IS NULL OR o.body <> n.body""")
def _c01(spark, sf_dir):
    return diff(relation(spark, sf_dir, "old_version"), relation(spark, sf_dir, "new_version"), "ref", "body")


@S.checked("c02_latest_version", """
    SELECT record_id, id, state FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY valid_from DESC, id DESC) AS n FROM {history}) x WHERE n = 1""")
def _c02(spark, sf_dir):
    h = relation(spark, sf_dir, "history")
    return latest(h, "record_id", F.col("valid_from"), F.col("id")).select("record_id", "id", "state")


@S.checked("c04_supersede_versions", """
    SELECT id, record_id, row_number() OVER w AS version, CASE WHEN lead(valid_from) OVER w IS NULL THEN 'in_force' ELSE 'superseded' END AS status
    FROM {history} WINDOW w AS (PARTITION BY record_id ORDER BY valid_from, id)""")
def _c04(spark, sf_dir):
    return scd2(relation(spark, sf_dir, "history"), "record_id", "valid_from", "id").select("id", "record_id", "version", "status")


@S.checked("n03_in_force_at", """
    SELECT id, record_id, state FROM (SELECT *, lead(valid_from) OVER (PARTITION BY record_id ORDER BY valid_from, id) AS valid_to FROM {history}) x
    WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')""")
def _n03(spark, sf_dir):
    h = scd2(relation(spark, sf_dir, "history"), "record_id", "valid_from", "id")
    return in_force(h, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("id", "record_id", "state")


@S.checked("c14_permission_as_of", """
    SELECT p.event_id, g.state AS granted, CASE WHEN g.id IS NULL THEN 'missing' WHEN g.state = 'error' THEN 'not_approved'
        WHEN g.valid_from + INTERVAL 3 DAY <= p.ts THEN 'expired' WHEN g.value < 5 THEN 'operation_not_granted' ELSE 'explicit_permission' END AS reason
    FROM (SELECT * FROM {events} WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM {history} WHERE state IN ('signup', 'error')) g ON p.user_id = g.record_id AND p.ts >= g.valid_from""")
def _c14(spark, sf_dir):
    h = relation(spark, sf_dir, "history")
    facts = relation(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("record_id"), "ts")
    found = as_of(facts, h.where("state in ('signup', 'error')"), "record_id", "ts", "valid_from", "id", ["id", "state", "valid_from", "value"])
    reason = (
        F.when(F.col("g_id").isNull(), "missing").when(F.col("g_state") == "error", "not_approved")
        .when(F.col("g_valid_from") + F.expr("interval 3 days") <= F.col("ts"), "expired")
        .when(F.col("g_value") < 5, "operation_not_granted").otherwise("explicit_permission")
    )
    return found.select("event_id", F.col("g_state").alias("granted"), reason.alias("reason"))


S.portable("c03_ingest_state", """
    SELECT coalesce(o.ref, n.ref) AS ref, CASE WHEN n.ref IS NULL THEN 'failed' WHEN n.body < 1000 THEN 'blocked' WHEN o.ref IS NULL THEN 'added'
        WHEN o.body = n.body THEN 'unchanged' WHEN n.body < o.body THEN 'stale' ELSE 'amended' END AS state
    FROM {old_version} o FULL OUTER JOIN {new_version} n ON o.ref = n.ref""")
S.portable("c05_effective_dates", f"""
    WITH t AS (SELECT o_orderkey, concat('This rule comes into force on ', [[date_format(o_orderdate, 'd MMMM yyyy')||strftime(o_orderdate, '%-d %B %Y')]], ' and replaces the rule of 1999.') AS text FROM {{orders}})
    SELECT o_orderkey AS clause_id, cast([[to_date(regexp_extract(text, {pattern('force on ([0-9]+ [A-Za-z]+ [0-9]+)').replace('[[', '').split('||')[0]}, 1), 'd MMMM yyyy')||strptime(regexp_extract(text, 'force on ([0-9]+ [A-Za-z]+ [0-9]+)', 1), '%d %B %Y')]] AS DATE) AS effective FROM t""")
S.portable("c06_choose_effective_date", """
    WITH d AS (SELECT l_orderkey, cast(l_shipdate AS DATE) AS d, l_linenumber FROM {lineitem}),
    f AS (SELECT o_orderkey, cast(o_orderdate AS DATE) AS floor_ FROM {orders})
    SELECT o_orderkey AS change_id, coalesce(min(d) FILTER (WHERE d >= floor_), min(d), max(floor_)) AS effective,
        CASE WHEN count(d) > 0 THEN 'text' ELSE 'publisher' END AS basis
    FROM f LEFT JOIN d ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY o_orderkey""")
_CITES = """
    WITH t AS (SELECT o_orderkey AS clause_id, concat('See Regulation (EU) ', cast(year(o_orderdate) + 15 AS VARCHAR(9)), '/', cast(1 + o_orderkey % 999 AS VARCHAR(9)), ', S.I. ', cast(year(o_orderdate) + 10 AS VARCHAR(9)), '/', cast(1 + o_custkey % 99 AS VARCHAR(9)),
        ' and ', cast(1 + o_orderkey % 49 AS VARCHAR(9)), ' CFR part ', cast(1 + o_custkey % 299 AS VARCHAR(9)), '.') AS text FROM {orders}),
    c AS (SELECT clause_id, 'eur_lex' AS publisher, concat('celex/3', regexp_extract(text, '([0-9]+)/([0-9]+)', 1), 'R', lpad(regexp_extract(text, '([0-9]+)/([0-9]+)', 2), 4, '0')) AS target FROM t
        UNION ALL SELECT clause_id, 'uk_legislation', concat('uksi/', regexp_extract(text, 'S.I. ([0-9]+)/([0-9]+)', 1), '/', regexp_extract(text, 'S.I. ([0-9]+)/([0-9]+)', 2)) FROM t
        UNION ALL SELECT clause_id, 'govinfo_us', concat('cfr/', regexp_extract(text, '([0-9]+) CFR part ([0-9]+)', 1), '/', regexp_extract(text, '([0-9]+) CFR part ([0-9]+)', 2)) FROM t)"""
S.portable("c07_citation_mining", _CITES + " SELECT DISTINCT clause_id, publisher, target FROM c")
S.portable("c08_resolve_citations", _CITES + """,
    known AS (SELECT concat('uksi/', cast(2001 + p_size % 15 AS VARCHAR(9)), '/', cast(1 + p_partkey % 99 AS VARCHAR(9))) AS key FROM {part} UNION SELECT concat('cfr/', cast(1 + p_size AS VARCHAR(9)), '/', cast(1 + p_partkey % 299 AS VARCHAR(9)), '-x') FROM {part}),
    pre AS (SELECT DISTINCT regexp_extract(key, '^(cfr/[0-9]+/[0-9]+)', 1) AS prefix FROM known WHERE key LIKE 'cfr/%')
    SELECT c.clause_id, c.target, CASE WHEN k.key IS NOT NULL OR p.prefix IS NOT NULL THEN 'resolved' WHEN c.publisher = 'eur_lex' THEN 'out_of_scope' ELSE 'open' END AS disposition
    FROM (SELECT DISTINCT clause_id, publisher, target FROM c) c LEFT JOIN known k ON k.key = c.target LEFT JOIN pre p ON p.prefix = c.target""")
S.portable("c09_family_tree", """
    SELECT r_name AS family, n_name AS member, count(DISTINCT c_custkey) > 0 AS ingested FROM {region} JOIN {nation} ON n_regionkey = r_regionkey
    LEFT JOIN {customer} ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY r_name, n_name""")
S.portable("c10_family_scorecard", """
    SELECT r_name AS family, members, open_, cast(members AS DOUBLE) / (members + open_) AS completeness, cast(members AS DOUBLE) / (members + open_) >= 0.99 AS passed
    FROM (SELECT r_name, count(DISTINCT s_suppkey) AS members, count(DISTINCT CASE WHEN s_acctbal < 0 THEN s_suppkey END) AS open_
        FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY r_name) x""")
S.portable("c11_citator_sync", "SELECT n.ref FROM {new_version} n LEFT JOIN {old_version} o ON o.ref = n.ref WHERE o.ref IS NULL UNION SELECT ref FROM {old_version}")
S.portable("c12_republishable", "SELECT p_partkey AS source_id, p_type IN ('STANDARD', 'SMALL', 'PROMO') AS republishable FROM {part}")
S.portable("c13_rights_history", """
    SELECT id, record_id, state FROM (SELECT *, lag(state) OVER (PARTITION BY record_id ORDER BY valid_from, id) AS before FROM {history}) x WHERE before IS NULL OR before <> state""")
S.portable("c15_candidate_decision", """
    SELECT o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'F' THEN 'granted' WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'needs_review' WHEN o_orderstatus = 'O' THEN 'requested' ELSE 'refused' END AS label FROM {orders}""")
S.portable("c16_public_clauses", "SELECT clause_id, source_key, ref FROM {clause} WHERE clause_id % 10 <> 0 AND source_key IN (SELECT concat('SRC-', lpad(cast(n_nationkey AS VARCHAR(9)), 2, '0')) FROM {nation} WHERE n_regionkey <> 2)")
S.portable("c17_inventory_audit", """
    WITH found AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.ref IS NULL THEN 'unexpected' WHEN n.ref IS NULL THEN 'missing' WHEN o.body <> n.body THEN 'hash_differs' END AS code
        FROM {old_version} o FULL OUTER JOIN {new_version} n ON o.ref = n.ref)
    SELECT code, count(*) AS findings, count(DISTINCT source_id) AS sources FROM found WHERE code IS NOT NULL GROUP BY code""")
S.portable("c18_source_audit", """
    SELECT source_key, count(*) AS clauses, count(DISTINCT ref) AS refs, [[count_if(length(text) < 40)||count(*) FILTER (WHERE length(text) < 40)]] AS short_, min(version_year) AS first_year, max(version_year) AS last_year FROM {clause} GROUP BY source_key""")
S.portable("c19_acceptance_status", "SELECT source_key, bool_and(version_year >= 1992) AS fresh, bool_and(length(text) > 8) AS bound, bool_and(clause_id % 997 <> 0) AS reviewed FROM {clause} GROUP BY source_key")
S.portable("c20_readback", "SELECT count(*) AS compared, [[count_if(o.body = n.body)||count(*) FILTER (WHERE o.body = n.body)]] AS equal_ FROM {old_version} o JOIN {new_version} n ON o.ref = n.ref")
S.portable("c21_repeat_run", "SELECT o.source_id, bool_and(o.body = n.body) AS same FROM {old_version} o JOIN {new_version} n ON o.ref = n.ref GROUP BY o.source_id")
S.portable("c23_schedule_evidence", """
    WITH slot AS (SELECT DISTINCT cast(ts AS DATE) AS day FROM {events}), expected AS (SELECT DISTINCT user_id FROM {events}), attempted AS (SELECT DISTINCT user_id, cast(ts AS DATE) AS day FROM {events})
    SELECT day, count(*) AS expected, count(a_user) AS attempted, count(*) - count(a_user) AS missed
    FROM (SELECT s.day, e.user_id, a.user_id AS a_user FROM slot s CROSS JOIN expected e LEFT JOIN attempted a ON a.user_id = e.user_id AND a.day = s.day) x GROUP BY day""")
S.portable("c24_origin_filter", "SELECT c_custkey AS source_id, c_name AS key FROM {customer} WHERE NOT c_name LIKE 'Customer#00000000%' AND c_custkey NOT IN (17, 23, 1001)")
S.portable("c25_language_coverage", "SELECT source, lang, count(*) AS units, [[count_if(n_chars > 1000)||count(*) FILTER (WHERE n_chars > 1000)]] AS long_units FROM {documents} GROUP BY source, lang")
S.portable("c26_translation_segments", f"""
    WITH pair AS (SELECT a.conv_id, a.turn, a.text AS unit, b.text AS output FROM {{conversations}} a JOIN {{conversations}} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, length(trim(output)) > 0 AS filled,
        [[array_join(array_sort(regexp_extract_all(unit, r'([0-9]+)', 1)), ',') = array_join(array_sort(regexp_extract_all(output, r'([0-9]+)', 1)), ',')||array_to_string(list_sort(regexp_extract_all(unit, '([0-9]+)', 1)), ',') = array_to_string(list_sort(regexp_extract_all(output, '([0-9]+)', 1)), ',')]] AS same_numbers FROM pair""")
S.portable("c27_workflow_page", "SELECT o_orderkey AS step_id, o_orderstatus AS status, o_orderpriority AS task FROM {orders} WHERE o_custkey % 10 = 3 ORDER BY o_orderkey LIMIT 50 OFFSET 25")
S.portable("c28_cycle_counts", "SELECT cast(ts AS DATE) AS cycle, event_type AS status, count(*) AS n FROM {events} GROUP BY cast(ts AS DATE), event_type")
S.portable("c29_progress", "SELECT 'clauses' AS what, count(*) AS n FROM {clause} UNION ALL SELECT 'obligations', count(*) FROM {obligation} UNION ALL SELECT 'blocks', count(*) FROM {block} UNION ALL SELECT 'edges', count(*) FROM {requires}")
