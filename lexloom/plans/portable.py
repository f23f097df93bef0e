"""Relations that Spark and an ANSI engine read alike.

The input tables have no legal prose.  ``FIXTURES`` derives the relations of
the data model (clauses, obligations, edges, profiles ...) from them with
deterministic expressions, so every operator runs at the tables' scale and its
result can be compared.  Text is SQL that both engines accept; where they
differ, ``[[Spark|other]]`` holds both forms.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from lexloom.session import table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

FIXTURES: dict[str, str] = {
    # clauses of one regulation for each customer nation; twelve sentence patterns
    "clause": """
        SELECT o_orderkey AS clause_id, concat('SRC-', lpad(cast(c_nationkey AS VARCHAR(9)), 2, '0')) AS source_key,
            concat('sec-', cast(o_orderkey AS VARCHAR(19))) AS ref, year(o_orderdate) AS version_year,
            CASE WHEN o_orderkey % 17 = 0 THEN 'Scope and definitions' WHEN o_orderkey % 19 = 0 THEN 'Section 4 Penalties' ELSE concat('Section ', cast(o_orderkey % 50 AS VARCHAR(9)), ' Handling of goods') END AS heading,
            CASE o_orderkey % 12
            WHEN 0 THEN concat('Every ', lower(c_mktsegment), ' supplier must ship order ', cast(o_orderkey AS VARCHAR(19)), ' within ', cast(1 + o_orderkey % 29 AS VARCHAR(9)), ' days of receipt and keep a register of deliveries for the whole of the reporting year.')
            WHEN 1 THEN concat('A ', lower(c_mktsegment), ' carrier shall not disclose the contents of consignment ', cast(o_orderkey AS VARCHAR(19)), ' unless the owner of the goods has agreed in writing.')
            WHEN 2 THEN concat('Where a ', lower(c_mktsegment), ' dealer holds goods of others, it must insure consignment ', cast(o_orderkey AS VARCHAR(19)), ' for at least ', cast(1 + o_orderkey % 9 AS VARCHAR(9)), ' million.')
            WHEN 3 THEN concat('The competent authority shall publish tariff list ', cast(o_orderkey AS VARCHAR(19)), ' every month.')
            WHEN 4 THEN concat('Staff of the ', lower(c_mktsegment), ' depot should attend training ', cast(o_orderkey AS VARCHAR(19)), ' when they join.')
            WHEN 5 THEN concat('Goods of class ', cast(o_orderkey AS VARCHAR(19)), ' shall be weighed before dispatch from the ', lower(c_mktsegment), ' depot.')
            WHEN 6 THEN concat('In this part the note of consignment ', cast(o_orderkey AS VARCHAR(19)), ' means the paper that travels with the goods.')
            WHEN 7 THEN concat('The ', lower(c_mktsegment), ' supplier is required to appoint an officer for site ', cast(o_orderkey AS VARCHAR(19)), ' no later than ', cast(1 + o_orderkey % 60 AS VARCHAR(9)), ' days after opening.')
            WHEN 8 THEN concat('It shall be unlawful for any ', lower(c_mktsegment), ' dealer to sell lot ', cast(o_orderkey AS VARCHAR(19)), ' without a licence.')
            WHEN 9 THEN concat('Each ', lower(c_mktsegment), ' operator must review the access rights of site ', cast(o_orderkey AS VARCHAR(19)), ' every ', cast(1 + o_orderkey % 12 AS VARCHAR(9)), ' months, and record the result of the review in its own files for the authority to read later.')
            WHEN 10 THEN concat('The provisions of section ', cast(o_orderkey AS VARCHAR(19)), ' shall not apply to a ', lower(c_mktsegment), ' supplier.')
            ELSE 'Reserved.' END AS text
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    # duties: one for each part; a brand is a source, a type a jurisdiction
    "obligation": """
        SELECT p_partkey AS obligation_id, concat('OBL-', lpad(cast(p_partkey AS VARCHAR(9)), 6, '0')) AS stable_id, p_brand AS source_key,
            concat('art-', cast(p_size AS VARCHAR(9))) AS clause_ref, p_type AS jurisdiction, p_name AS statement,
            CASE WHEN p_partkey % 11 = 0 THEN 'stale' WHEN p_partkey % 5 = 0 THEN 'validated' ELSE 'derived' END AS status,
            CASE WHEN p_partkey % 7 = 0 THEN p_partkey - p_partkey % 5 - 1 END AS canonical_id,
            CASE WHEN p_partkey % 13 <> 0 THEN cast(p_size AS DOUBLE) / 50 END AS confidence, sha2_256(p_name) AS text_hash
        FROM {part}""",
    # components: one for each supplier; who supplies a part satisfies its duty
    "block": """
        SELECT s_suppkey AS block_id, s_name AS name, CASE s_nationkey % 5 WHEN 0 THEN 'Document' WHEN 1 THEN 'System' WHEN 2 THEN 'Role' WHEN 3 THEN 'Process' ELSE 'Body' END AS kind,
            CASE WHEN s_acctbal > 5000 THEN 'curated' ELSE 'derived' END AS status, s_nationkey AS owner FROM {supplier}""",
    "requires": "SELECT DISTINCT l_partkey AS obligation_id, l_suppkey AS block_id FROM {lineitem}",
    "hard_requires": "SELECT DISTINCT l_partkey AS obligation_id, l_suppkey AS block_id FROM {lineitem} WHERE l_quantity >= 50",
    # profiles: one for each customer; answers from their segment
    "profile": "SELECT c_custkey AS profile_id, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM {customer}",
    # applicability edges of a duty: jurisdiction, roles and one condition
    "edge": """
        SELECT p_partkey AS obligation_id, 'jurisdiction' AS basis, cast(p_partkey % 25 AS VARCHAR(9)) AS key1, cast(NULL AS VARCHAR(20)) AS key2, true AS expect FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, 'roles', CASE p_size % 5 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'AUTOMOBILE' ELSE 'HOUSEHOLD' END, CASE WHEN p_size % 2 = 0 THEN 'MACHINERY' END, true FROM {part} WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey, 'condition', concat('fact-', cast(p_size % 4 AS VARCHAR(9))), cast(NULL AS VARCHAR(20)), p_partkey % 4 <> 1 FROM {part} WHERE p_partkey % 5 < 2""",
    # answers of a profile: what it says of roles (its segment true, one other false) and of facts
    "answer": """
        SELECT c_custkey AS profile_id, 'roles' AS basis, c_mktsegment AS akey, true AS said FROM {customer}
        UNION ALL SELECT c_custkey, 'roles', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'BUILDING' ELSE 'MACHINERY' END, false FROM {customer}
        UNION ALL SELECT c_custkey, 'condition', concat('fact-', cast(c_custkey % 4 AS VARCHAR(9))), c_custkey % 3 = 0 FROM {customer}
        UNION ALL SELECT c_custkey, 'jurisdiction', cast(c_nationkey AS VARCHAR(9)), true FROM {customer} WHERE c_custkey % 4 <> 0""",
    # what applies to a profile: the duties of its ordered parts, what satisfies them, and a composition that leaves gaps
    "duty": "SELECT DISTINCT o_custkey AS profile_id, l_partkey AS obligation_id FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey",
    "candidate": "SELECT d.profile_id, d.obligation_id, r.block_id FROM {duty} d JOIN {requires} r ON r.obligation_id = d.obligation_id",
    "needed": "SELECT d.profile_id, d.obligation_id, r.block_id FROM {duty} d JOIN {hard_requires} r ON r.obligation_id = d.obligation_id",
    "pick": """
        SELECT DISTINCT profile_id, block_id, 'required' AS basis FROM {needed}
        UNION ALL SELECT DISTINCT s.profile_id, s.block_id, 'selected' FROM (SELECT profile_id, min(block_id) AS block_id FROM {candidate} WHERE obligation_id % 9 <> 0 GROUP BY profile_id, obligation_id) s
        LEFT JOIN {needed} n ON n.profile_id = s.profile_id AND n.block_id = s.block_id WHERE n.block_id IS NULL""",
    # outcomes against duties: error events of a user
    "outcome": """
        SELECT event_id, user_id AS obligation_id, ts AS decided_at, cast(ts AS DATE) AS decided_on, value AS amount,
            CASE event_type WHEN 'error' THEN 'fine' WHEN 'click' THEN 'prohibition' WHEN 'view' THEN 'censure' WHEN 'signup' THEN 'suspension' ELSE 'other' END AS kind
        FROM {events}""",
    # two versions of each source: orders of two years, keyed by customer and priority
    "old_version": "SELECT concat(cast(o_custkey AS VARCHAR(9)), '/', o_orderpriority) AS ref, max(o_custkey) AS source_id, sum(cast(o_totalprice AS DECIMAL(18,2))) AS body FROM {orders} WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey, o_orderpriority",
    "new_version": "SELECT concat(cast(o_custkey AS VARCHAR(9)), '/', o_orderpriority) AS ref, max(o_custkey) AS source_id, sum(cast(o_totalprice AS DECIMAL(18,2))) AS body FROM {orders} WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey, o_orderpriority",
    # history of states: a user's events as versions of a record
    "history": "SELECT event_id AS id, user_id AS record_id, ts AS valid_from, event_type AS state, value FROM {events}",
    # a regulation for each customer who orders: an article for each order, of three shapes
    "article": """
        SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS k, o_orderkey % 3 AS shape, o_orderpriority AS priority FROM {orders}""",
    "web_page": """
        SELECT doc, concat('<!DOCTYPE html><html><head><title>x</title><script>var a = "<p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><article>An advertisement</article><main><h1>Orders of customer ', cast(doc AS VARCHAR(19)), '</h1>',
            [[array_join(transform(array_sort(collect_list(struct(i, body))), x -> x.body), '')||string_agg(body, '' ORDER BY i)]], '</main><footer>Contact</footer></body></html>') AS html
        FROM (SELECT doc, i, CASE shape
            WHEN 0 THEN concat('<h2>Order  ', cast(k AS VARCHAR(19)), '</h2><p>Article ', cast(i AS VARCHAR(9)), '. The depot shall keep &amp; file <b>order</b> ', cast(k AS VARCHAR(19)), '.</p><ul><li>name the carrier</li><li>state the priority ', priority, '</ul>')
            WHEN 1 THEN concat('<div>Article ', cast(i AS VARCHAR(9)), '. The carrier must not open order ', cast(k AS VARCHAR(19)), '.</div>')
            ELSE concat('<h3>Order ', cast(k AS VARCHAR(19)), '</h3><p>Article ', cast(i AS VARCHAR(9)), '. Weigh it.</p><p>Article ', cast(i AS VARCHAR(9)), '. Cited again.</p>') END AS body FROM {article}) x
        GROUP BY doc""",
    "regulation": """
        SELECT doc, concat('CHAPTER I', [[chr(10)||chr(10)]], 'Orders of customer ', cast(doc AS VARCHAR(19)), [[chr(10)||chr(10)]],
            [[array_join(transform(array_sort(collect_list(struct(i, body))), x -> x.body), chr(10))||string_agg(body, chr(10) ORDER BY i)]]) AS text
        FROM (SELECT doc, i, CASE shape
            WHEN 0 THEN concat('Article ', cast(i AS VARCHAR(9)), chr(10), 'Order ', cast(k AS VARCHAR(19)), chr(10), '1. The depot shall keep a register of order ', cast(k AS VARCHAR(19)), '.', chr(10), '2. The register shall:', chr(10),
                '(a) name the carrier of order ', cast(k AS VARCHAR(19)), ';', chr(10), '(b) state the priority ', priority, '.')
            WHEN 1 THEN concat('Article ', cast(i AS VARCHAR(9)), chr(10), 'The carrier must not open order ', cast(k AS VARCHAR(19)), ' without consent.')
            ELSE concat('Article ', cast(i AS VARCHAR(9)), chr(10), 'Order ', cast(k AS VARCHAR(19)), chr(10), '1. Order ', cast(k AS VARCHAR(19)), ' must be weighed.', chr(10), '1. It must be sealed.') END AS body FROM {article}) x
        GROUP BY doc""",
    # blocks of the documents as their originals have them, and as they were stored: some altered, some lost
    "original": r"""[[SELECT doc_id, cast(pos AS BIGINT) AS pos, line AS text FROM {documents} LATERAL VIEW posexplode(split(coalesce(text, ''), '\n')) t AS pos, line WHERE trim(line) <> ''||
        SELECT doc_id, i - 1 AS pos, line AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {documents}) x WHERE trim(line) <> '']]""",
    "stored": "SELECT doc_id, pos, CASE WHEN doc_id % 31 = 6 AND pos = 0 THEN concat('x', text) ELSE text END AS text FROM {original} WHERE NOT (doc_id % 29 = 4 AND pos % 5 = 2)",
    # hashes on record, some of another content, some missing
    "artifact": "SELECT doc_id, source, text, CASE WHEN doc_id % 97 = 5 THEN sha2_256_of(concat(text, ' ')) WHEN doc_id % 101 <> 7 THEN sha2_256_of(text) END AS recorded FROM {documents}",
    # changes as they were written down: those of some sources not at all, some with another kind
    "recorded_change": """
        SELECT ref, CASE WHEN source_id % 11 = 5 AND kind = 'removed' THEN 'amended' ELSE kind END AS kind FROM (
            SELECT coalesce(o.ref, n.ref) AS ref, coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN o.ref IS NULL THEN 'added' WHEN n.ref IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'amended' END AS kind
            FROM {old_version} o FULL OUTER JOIN {new_version} n ON n.ref = o.ref) x WHERE kind IS NOT NULL AND source_id % 9 <> 0""",
    # nodes of a tree, with missing and repeated refs and labels that their text has again
    "node": """
        SELECT source_key, clause_id, CASE WHEN clause_id % 12 = 11 THEN 'note' ELSE 'clause' END AS kind, CASE WHEN clause_id % 12 = 11 THEN 'Reserved' ELSE '' END AS label, text,
            CASE WHEN clause_id % 23 = 0 THEN NULL WHEN clause_id % 37 = 1 THEN 'sec-1' ELSE ref END AS ref FROM {clause}""",
    # member inputs to a cohort
    "input": "SELECT o_orderkey AS id, o_custkey AS member, o_orderpriority AS cohort, o_totalprice AS value, o_orderdate AS submitted_at FROM {orders}",
}

def _choose(sql: str, spark: bool) -> str:
    sql = re.sub(r"\[\[(.*?)\|\|(.*?)\]\]", lambda m: m[1] if spark else m[2], sql, flags=re.S)
    if spark:
        sql = re.sub(r"VARCHAR\(\d+\)", "STRING", sql).replace("sha2_256(", "sha256_(").replace("sha256_(p_name)", "sha2(p_name, 256)")
        return re.sub(r"sha2_256_of\((concat\([^()]*\)|\w+)\)", r"sha2(\1, 256)", sql)
    return sql.replace("sha2_256_of(", "sha256(").replace("sha2_256(", "sha256(")


def names_in(sql: str) -> set[str]:
    return {n for n in re.findall(r"\{([a-z_]+)\}", sql) if n in FIXTURES or n in TABLES}


@lru_cache(256)
def _needed(sql: str) -> tuple[str, ...]:
    """Fixtures that a text needs, those they need first."""
    out: list[str] = []
    for name in sorted(names_in(sql)):
        if name in FIXTURES:
            out += [x for x in (*_needed(FIXTURES[name]), name) if x not in out]
    return tuple(out)


def oracle(sql: str) -> str:
    """The text with its fixtures as common table expressions."""
    bare = _bare(_choose(sql, False))
    ctes = [f"{n} AS ({_bare(_choose(FIXTURES[n], False))})" for n in _needed(sql)]
    if not ctes:
        return bare
    lead = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", bare, re.I)
    if lead:
        return f"WITH {lead[1] or ''}{', '.join(ctes)}, {bare[lead.end():]}"
    return f"WITH {', '.join(ctes)} {bare}"


def _bare(sql: str) -> str:
    return re.sub(r"\{([a-z_]+)\}", lambda m: m[1] if m[1] in FIXTURES or m[1] in TABLES else m[0], sql)


def joined(x: str, sep: str = ",") -> str:
    """Distinct values of a group in order, as one string."""
    return f"[[array_join(array_sort(collect_set({x})), '{sep}')||array_to_string(list_sort(list_distinct(list({x}))), '{sep}')]]"


def pattern(x: str) -> str:
    """A regular expression as a literal without escapes."""
    return f"[[r'{x}'||'{x}']]"


def days(later: str, earlier: str) -> str:
    return f"[[datediff({later}, {earlier})||date_diff('day', {earlier}, {later})]]"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture or table as a DataFrame."""
    return run(spark, sf_dir, FIXTURES[name]) if name in FIXTURES else table(spark, sf_dir, name)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_choose(sql, True), **{n: relation(spark, sf_dir, n) for n in names_in(sql)})


class Suite:
    """Queries of one module: DataFrame operators with a check in SQL, or portable SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def portable(self, name: str, sql: str) -> None:
        self.queries[name] = lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql)
        self.oracles[name] = oracle(sql)

    def checked(self, name: str, sql: str | None = None):
        """Registers a DataFrame query and the SQL of the same result."""

        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = oracle(sql)
            return f

        return put
