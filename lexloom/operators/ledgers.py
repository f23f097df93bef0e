"""Rails: records, feeds, ledgers and their rollups (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.plans.portable import Suite, joined, pattern, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles

S.portable("n01_bitemporal_write", "SELECT id, record_id, row_number() OVER (PARTITION BY record_id ORDER BY valid_from, id) AS version, cast(valid_from AS DATE) AS valid_from, concat('WHY-', cast(id AS VARCHAR(19))) AS why, 'events' AS derived_by FROM {history}")
S.portable("n02_invalidate", """
    SELECT id, record_id, n + 1 AS version, cast(valid_from AS DATE) AS valid_to, 'closed by error' AS review
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY valid_from, id) AS n FROM {history}) x WHERE state = 'error'""")
S.portable("n04_inputs_hash", "SELECT obligation_id, [[sha2(concat_ws('\\u001f', stable_id, source_key, clause_ref, statement), 256)||sha256(concat_ws(chr(31), stable_id, source_key, clause_ref, statement))]] AS inputs_hash FROM {obligation}")
S.portable("n05_allocate_ids", "SELECT s_suppkey, concat('BLK-', lpad(cast(100 + row_number() OVER (ORDER BY s_suppkey) AS VARCHAR(19)), 6, '0')) AS stable_id FROM {supplier}")
S.portable("n06_layer_revision", f"SELECT source_key, [[sha2(||sha256(]]{joined('text_hash')}[[, 256)||)]] AS revision FROM {{obligation}} WHERE status <> 'stale' GROUP BY source_key")
S.portable("n07_check_inputs", """
    SELECT b.source_key, b.built, n.now_, b.built = n.now_ AS current_ FROM (SELECT source_key, count(*) AS built FROM {obligation} WHERE obligation_id % 50 <> 0 GROUP BY source_key) b
    JOIN (SELECT source_key, count(*) AS now_ FROM {obligation} GROUP BY source_key) n ON n.source_key = b.source_key""")
S.portable("n08_change_feed", """
    SELECT layer, ref, on_day FROM (
        SELECT 'L1' AS layer, concat('event/', cast(event_id AS VARCHAR(19))) AS ref, cast(ts AS DATE) AS on_day FROM {events} WHERE event_type = 'signup'
        UNION ALL SELECT 'L2', concat('order/', cast(o_orderkey AS VARCHAR(19))), cast(o_orderdate AS DATE) FROM {orders} WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'L6', concat('line/', cast(l_orderkey AS VARCHAR(19)), '/', cast(l_linenumber AS VARCHAR(9)), '/', cast(l_partkey AS VARCHAR(19))), cast(l_shipdate AS DATE) FROM {lineitem} WHERE l_returnflag = 'R') x
    ORDER BY on_day DESC, layer, ref LIMIT 200""")
@S.checked("n09_watch_digest", """
    SELECT p.profile_id, count(DISTINCT o.obligation_id) AS obligations, count(DISTINCT CASE WHEN o.status = 'stale' THEN o.obligation_id END) AS changed
    FROM {profile} p LEFT JOIN {obligation} o ON o.obligation_id % 25 = p.nation AND o.source_key IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY p.profile_id""")
def _n09(spark, sf_dir):
    """Watched duties are counted once for each nation; a duty has one nation, so a profile's counts add up."""
    watched = relation(spark, sf_dir, "obligation").where("source_key IN ('Brand#1', 'Brand#2', 'Brand#3')").groupBy("obligation_id").agg(F.bool_or(F.col("status") == "stale").alias("stale"))
    by_nation = watched.groupBy((F.col("obligation_id") % 25).alias("nation")).agg(F.count("*").alias("n"), F.count(F.when(F.col("stale"), 1)).alias("changed"))
    profiles = relation(spark, sf_dir, "profile").select("profile_id", "nation").distinct()
    # remainders by 25: the side is small whatever the input
    met = profiles.join(F.broadcast(by_nation), "nation", "left").groupBy("profile_id")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("obligations"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))


S.portable("n10_scope_projection", """
    WITH scope AS (SELECT obligation_id FROM {obligation} WHERE source_key IN (SELECT concat('Brand#', cast(n_nationkey AS VARCHAR(9))) FROM {nation}) AND status <> 'stale'),
    inside AS (SELECT r.block_id FROM {requires} r LEFT JOIN scope s ON s.obligation_id = r.obligation_id GROUP BY r.block_id HAVING count(*) * 8 < 10 * count(s.obligation_id))
    SELECT r.block_id, r.obligation_id FROM {requires} r JOIN scope s ON s.obligation_id = r.obligation_id WHERE r.block_id IN (SELECT block_id FROM inside)""")
S.portable("n11_layer_counts", """
    SELECT count(*) AS total, [[count_if(status = 'derived')||count(*) FILTER (WHERE status = 'derived')]] AS derived, [[count_if(status = 'validated')||count(*) FILTER (WHERE status = 'validated')]] AS validated,
        [[count_if(status = 'stale')||count(*) FILTER (WHERE status = 'stale')]] AS stale, count(canonical_id) AS merged, count(DISTINCT source_key) AS sources, count(DISTINCT jurisdiction) AS jurisdictions FROM {obligation}""")
S.portable("n12_obligation_page", """
    SELECT obligation_id, statement, total, per_source FROM (SELECT obligation_id, statement, count(*) OVER () AS total, count(*) OVER (PARTITION BY source_key) AS per_source
        FROM {obligation} WHERE lower(statement) LIKE '%re%' AND status <> 'stale') x ORDER BY per_source DESC, obligation_id LIMIT 40 OFFSET 20""")
S.portable("n13_resolve_clause", """
    SELECT source_key, ref, clause_id, CASE WHEN clause_id % 10 = 0 THEN 'locked' ELSE 'open' END AS lock_state
    FROM (SELECT *, row_number() OVER (PARTITION BY source_key, clause_id % 50 ORDER BY version_year DESC, clause_id DESC) AS n FROM {clause}) x WHERE n = 1""")
S.portable("n14_low_confidence_queue", """
    SELECT obligation_id, layer, confidence FROM (
        SELECT obligation_id, 'L2' AS layer, confidence FROM {obligation} WHERE confidence IS NULL OR confidence < 0.85
        UNION ALL SELECT obligation_id + 1000000, 'L4', confidence FROM {obligation} WHERE (confidence IS NULL OR confidence < 0.80) AND obligation_id % 2 = 0) x
    WHERE obligation_id % 9 <> 0 ORDER BY confidence ASC NULLS FIRST, layer, obligation_id LIMIT 100""")
S.portable("n15_reproduce_edits", """
    SELECT o.ref, CASE WHEN n.ref IS NULL THEN 'escalated' WHEN o.body = n.body THEN 'intact' WHEN o.source_id % 2 = 0 THEN 'reproduced' ELSE 'escalated' END AS outcome
    FROM {old_version} o LEFT JOIN {new_version} n ON n.ref = o.ref""")
S.portable("n16_agreement_scores", """
    SELECT lang, source, grouping(lang) AS all_lang, count(*) AS n, avg(CASE WHEN quality = 1 THEN cast(1 AS DOUBLE) ELSE 0 END) AS agreement
    FROM {labels} JOIN {documents} ON labels.doc_id = documents.doc_id GROUP BY GROUPING SETS ((lang), (source, lang), (source))""".replace("{labels} JOIN {documents} ON labels.doc_id = documents.doc_id", "(SELECT l.quality, d.lang, d.source FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id) x"))
S.portable("n17_stratified_sample", "SELECT o_orderkey, o_orderpriority AS layer FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM {orders}) x WHERE n <= 20")
S.portable("n18_vote_tallies", """
    SELECT user_id AS obligation_id, [[count_if(event_type = 'view')||count(*) FILTER (WHERE event_type = 'view')]] AS up, [[count_if(event_type = 'error')||count(*) FILTER (WHERE event_type = 'error')]] AS down,
        count(*) FILTER (WHERE event_type = 'view') >= 3 + count(*) FILTER (WHERE event_type = 'error') AS promote FROM {events} GROUP BY user_id""")
S.portable("n19_contributor_wall", "SELECT user_id, count(*) AS contributions, (SELECT count(*) FROM {events}) AS total FROM {events} GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 50")
S.portable("n20_leaderboard", """
    SELECT user_id, score, row_number() OVER (ORDER BY score DESC, user_id) AS place FROM (
        SELECT user_id, cast(10 * count(*) FILTER (WHERE event_type = 'purchase') + 5 * count(*) FILTER (WHERE event_type = 'signup') + 2 * count(*) FILTER (WHERE event_type = 'view') + count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS score FROM {events} GROUP BY user_id) x""")
S.portable("n21_rederive_contributions", "SELECT o.obligation_id, n.ref IS NOT NULL AS still_holds FROM {obligation} o LEFT JOIN {new_version} n ON n.ref = concat(cast(o.obligation_id AS VARCHAR(9)), '/5-LOW')")
S.portable("n22_duplicate_contribution", "SELECT doc_id FROM (SELECT doc_id, [[sha2(text, 256)||sha256(text)]] AS h FROM {documents}) d WHERE EXISTS (SELECT 1 FROM (SELECT doc_id, [[sha2(text, 256)||sha256(text)]] AS h FROM {documents}) e WHERE e.h = d.h AND e.doc_id < d.doc_id)")
S.portable("n23_audit_coverage", "SELECT o_orderpriority AS layer, avg(CASE WHEN o_orderstatus <> 'O' THEN cast(100 AS DOUBLE) ELSE 0 END) AS covered_percent FROM {orders} GROUP BY o_orderpriority")
S.portable("n24_spend_caps", """
    SELECT cast(ts AS DATE) AS day, event_type AS fleet, round(sum(value), 4) AS spent, sum(value) >= 20 AS capped FROM {events} GROUP BY cast(ts AS DATE), event_type""")
S.portable("n25_route_decision", """
    WITH q AS (SELECT p_type AS task, p_size % 4 AS rung, avg(p_retailprice) AS quality FROM {part} GROUP BY p_type, p_size % 4)
    SELECT task, coalesce(min(CASE WHEN quality >= 1400 THEN rung END), max(rung)) AS rung, count(CASE WHEN quality >= 1400 THEN 1 END) = 0 AS escalated FROM q GROUP BY task""")
S.portable("n26_quality_table", "SELECT p_type AS task, p_size % 4 AS rung, cast(CASE p_size % 4 WHEN 0 THEN 0.86 WHEN 1 THEN 0.90 WHEN 2 THEN 0.94 ELSE 0.97 END AS DOUBLE) AS quality, count(*) AS samples FROM {part} GROUP BY p_type, p_size % 4")
S.portable("n27_ops_dashboard", "SELECT event_type AS tier, user_id % 7 AS model, count(*) AS calls, round(sum(value), 4) AS spend FROM {events} GROUP BY event_type, user_id % 7")
S.portable("n28_audit_summary", "SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS actors, [[count_if(props LIKE '%7%')||count(*) FILTER (WHERE props LIKE '%7%')]] AS wildcards FROM {events} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
S.portable("n29_usage_rollup", """
    SELECT cast(ts AS DATE) AS day, user_id % 10 AS app, count(*) AS requests, [[count_if(event_type = 'error')||count(*) FILTER (WHERE event_type = 'error')]] AS errors, cast(sum(length(props)) AS BIGINT) AS bytes, round(avg(value), 6) AS latency, max(event_id) AS last_id
    FROM {events} GROUP BY cast(ts AS DATE), user_id % 10""")
S.portable("n30_usage_overview", "SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS users FROM {events} WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY event_type")
S.portable("n31_rate_limit", """
    SELECT user_id AS bucket, w AS window_no, count(*) AS hits, count(*) > 2 AS limited
    FROM (SELECT user_id, cast(floor([[unix_seconds(cast(ts AS TIMESTAMP))||epoch(ts)]] / 21600) AS BIGINT) AS w FROM {events}) x GROUP BY user_id, w""")
S.portable("n32_restore_check", """
    SELECT 'orders' AS what, (SELECT count(*) FROM {orders}) = (SELECT count(*) FROM {orders} WHERE o_orderkey >= 0) AS equal_, (SELECT count(*) FROM {lineitem} l LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL) AS dangling
    UNION ALL SELECT 'customer', (SELECT count(*) FROM {customer}) = (SELECT count(*) FROM {customer} WHERE c_acctbal > 0), (SELECT count(*) FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE c.c_custkey IS NULL)""")
S.portable("n33_corpus_counts", "SELECT source, lang, count(*) AS documents, cast(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY source, lang")
S.portable("n34_release_delta", """
    SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT source_id, count(*) AS n FROM {old_version} GROUP BY source_id) a
    FULL OUTER JOIN (SELECT source_id, count(*) AS n FROM {new_version} GROUP BY source_id) b ON a.source_id = b.source_id WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)""")
S.portable("n37_newsletter_digest", "SELECT cast(ts AS DATE) AS day, event_type AS kind, count(*) AS changes FROM {events} WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND event_type IN ('signup', 'error') GROUP BY cast(ts AS DATE), event_type")
S.portable("n38_redact", f"SELECT page_id, regexp_replace(regexp_replace(url, {pattern('[?].*$')}, '?...'), {pattern('//[a-z]+')}, '//host') AS redacted FROM {{pages}}")
S.portable("n39_deferred_counts", "SELECT l_returnflag AS status, l_linestatus AS reason, l_linenumber AS kind, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_linenumber")
