"""Applicability, evidence, components and activities (E, F8-F21, G, H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import reading
from lexloom.functions import text as tx
from lexloom.functions.grammar import staged
from lexloom.plans.fixpoint import few, follow, kept
from lexloom.plans.portable import Suite, joined, relation

#: Most partitions of an exchange that is dealt by an explicit number.
MOST_PARTS = 500_000

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles


BASES = ("jurisdiction", "roles", "condition")


def answer_patterns(answers: DataFrame) -> DataFrame:
    """``profile_id, pattern``: what a profile says, as one value that equal profiles share.

    A struct of one sorted array of ``(akey, said)`` for each basis.  An answer
    given twice counts once; a key with both answers counts as true.
    """
    once = answers.groupBy("profile_id", "basis", "akey").agg(F.bool_or("said").alias("said"))
    lists = [F.array_sort(F.collect_list(F.when(F.col("basis") == b, F.struct("akey", "said")))).alias(b) for b in BASES]
    return once.groupBy("profile_id").agg(*lists).select("profile_id", F.struct(*BASES).alias("pattern"))


def _said(pattern: Column) -> dict[str, Column]:
    """The answers of a pattern as a map for each basis."""
    return {b: F.map_from_entries(pattern[b]) for b in BASES}


def _state(basis: Column, key1: Column, key2: Column, expect: Column) -> Column:
    """``match``, ``fail`` or ``open`` of an edge beside the columns of :func:`_said`."""
    roles = F.filter(F.array(key1, key2), lambda r: r.isNotNull())
    told = F.transform(roles, lambda r: F.try_element_at("roles", r))
    fact = F.try_element_at("condition", key1)
    return (
        F.when(basis == "jurisdiction", F.when(F.cardinality("jurisdiction") == 0, "open").when(F.try_element_at("jurisdiction", key1), "match").otherwise("fail"))
        .when(basis == "roles", F.when(F.exists(told, lambda a: a), "match").when(F.forall(told, lambda a: a.isNotNull()) & F.forall(told, lambda a: ~a), "fail").otherwise("open"))
        .otherwise(F.when(fact.isNull(), "open").when(fact == expect, "match").otherwise("fail"))
    )


def pattern_states(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, obligation_id, basis, state`` of every edge and distinct pattern.

    ``match``, ``fail`` or ``open``: roles match if any is true, fail if all are
    false; a fact matches if the answer is the expected one; a jurisdiction
    fails only if the profile names others.  Profiles answer alike by the
    thousand, so the product is of edges and patterns and not of profiles.
    """
    said = patterns.select("pattern").distinct().select("pattern", *[c.alias(b) for b, c in _said(F.col("pattern")).items()])
    return edges.crossJoin(said).select("pattern", "obligation_id", "basis", _state(*map(F.col, ("basis", "key1", "key2", "expect"))).alias("state"))


def judge(states: DataFrame, by: str = "pattern") -> DataFrame:
    """Three-valued verdict: any failed edge, else any open one, else it applies."""
    return states.groupBy(by, "obligation_id").agg(
        F.when(F.bool_or(F.col("state") == "fail"), "not_applicable").when(F.bool_or(F.col("state") == "open"), "undetermined").otherwise("applies").alias("verdict")
    )


_STATES = """
    st AS (SELECT p.profile_id, e.obligation_id, e.basis, CASE e.basis
        WHEN 'jurisdiction' THEN CASE WHEN p.nj = 0 THEN 'open' WHEN EXISTS (SELECT 1 FROM {answer} a WHERE a.profile_id = p.profile_id AND a.basis = 'jurisdiction' AND a.akey = e.key1) THEN 'match' ELSE 'fail' END
        WHEN 'roles' THEN CASE WHEN coalesce(r1.said, false) OR coalesce(r2.said, false) THEN 'match' WHEN r1.said IS NOT NULL AND (e.key2 IS NULL OR r2.said IS NOT NULL) THEN 'fail' ELSE 'open' END
        ELSE CASE WHEN c.said IS NULL THEN 'open' WHEN c.said = e.expect THEN 'match' ELSE 'fail' END END AS state
    FROM {edge} e CROSS JOIN (SELECT profile_id, count(*) FILTER (WHERE basis = 'jurisdiction') AS nj FROM {answer} GROUP BY profile_id) p
    LEFT JOIN {answer} r1 ON r1.profile_id = p.profile_id AND r1.basis = 'roles' AND r1.akey = e.key1 LEFT JOIN {answer} r2 ON r2.profile_id = p.profile_id AND r2.basis = 'roles' AND r2.akey = e.key2
    LEFT JOIN {answer} c ON c.profile_id = p.profile_id AND c.basis = 'condition' AND c.akey = e.key1),
    v AS (SELECT profile_id, obligation_id, CASE WHEN bool_or(state = 'fail') THEN 'not_applicable' WHEN bool_or(state = 'open') THEN 'undetermined' ELSE 'applies' END AS verdict FROM st GROUP BY profile_id, obligation_id)"""


def _judged(spark, sf_dir):
    """Profiles with their patterns, and the states of each pattern's edges."""
    patterns = answer_patterns(relation(spark, sf_dir, "answer"))
    return patterns, pattern_states(relation(spark, sf_dir, "edge"), patterns)


@S.checked("g11_judge_edges", f"WITH {_STATES} SELECT profile_id, basis, state, count(*) AS n FROM st GROUP BY profile_id, basis, state")
def _g11(spark, sf_dir):
    patterns, states = _judged(spark, sf_dir)
    counted = states.groupBy("pattern", "basis", "state").agg(F.count("*").alias("n"))
    return patterns.join(counted, "pattern").drop("pattern")


#: Rows of a result that a task spreads.
SPREAD = 4_000_000


def _verdicts(spark, sf_dir, keep: str | None = None, duties: DataFrame | None = None):
    """``profile_id``, the columns of ``duties`` (else ``obligation_id``) and ``verdict``: classes of duties with the same edges are judged once for each pattern of answers.

    Only verdicts that are kept are spread to profiles and duties, on numbers
    of patterns and classes: what travels is the classes and the result.  The
    duties of a class come last, as a list with all that the result has of
    them, so no row of the result is joined.  Tasks are dealt by the rows that
    they spread: the profiles alone are few bytes, which one task would take.
    """
    patterns = answer_patterns(relation(spark, sf_dir, "answer"))
    patterns = kept(patterns.select("profile_id", F.sha2(F.to_json("pattern"), 256).alias("told"), "pattern"))
    said = kept(patterns.groupBy("told").agg(F.min("pattern").alias("pattern")).withColumn("answers", F.monotonically_increasing_id()))
    edges = relation(spark, sf_dir, "edge")
    shapes = edges.groupBy("obligation_id").agg(F.array_sort(F.collect_set(F.struct("basis", "key1", "key2", "expect"))).alias("shape"))
    shapes = (shapes.join(duties, "obligation_id") if duties else shapes).withColumn("told", F.sha2(F.to_json("shape"), 256))
    listed = [c for c in duties.columns if c != "obligation_id"] if duties else ["obligation_id"]
    classes = kept(shapes.groupBy("told").agg(F.min("shape").alias("shape"), F.collect_list(F.struct(*listed)).alias("duties")).withColumn("class", F.monotonically_increasing_id()))
    asked = staged(said.crossJoin(classes.select("class", "shape")), _said(F.col("pattern")))
    states = staged(asked, {"states": F.transform("shape", lambda e: _state(e["basis"], e["key1"], e["key2"], e["expect"]))})
    verdict = F.when(F.array_contains("states", "fail"), "not_applicable").when(F.array_contains("states", "open"), "undetermined").otherwise("applies")
    judged = kept(staged(states, {"verdict": verdict}).where(F.col("verdict") == keep if keep else F.lit(True)).groupBy("answers").agg(F.collect_list(F.struct("class", "verdict")).alias("found")))
    many = classes.agg(F.sum(F.size("duties"))).first()[0] or 0
    spread = patterns.join(few(said.select("told", "answers")), "told").join(few(judged.select("answers", F.size("found").alias("n"))), "answers")
    rows = spread.agg(F.sum("n")).first()[0] or 0  # of profiles and classes
    parts = -(-int(rows * many / max(1, classes.count())) // SPREAD)
    parts = min(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTS)
    bounded = lambda df, n: F.broadcast(df) if n <= 2_000_000 else df
    # a row for each profile and class first, whose duties it then meets
    met = spread.select("profile_id", "answers").repartition(parts, "profile_id").join(bounded(judged, judged.agg(F.sum(F.size("found"))).first()[0] or 0), "answers").select("profile_id", F.explode("found").alias("t")).select("profile_id", "t.class", "t.verdict")
    return met.join(bounded(classes.select("class", "duties"), many), "class").select("profile_id", F.explode("duties").alias("d"), "verdict").select("profile_id", "d.*", "verdict")


@S.checked("g12_applicability", f"WITH {_STATES} SELECT * FROM v")
def _g12(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@S.checked("g13_obligations_for_profile", f"WITH {_STATES} SELECT v.profile_id, o.stable_id, o.source_key FROM v JOIN {{obligation}} o ON o.obligation_id = v.obligation_id WHERE v.verdict = 'applies' AND o.status <> 'stale'")
def _g13(spark, sf_dir):
    o = relation(spark, sf_dir, "obligation").where("status <> 'stale'").select("obligation_id", "stable_id", "source_key")
    return _verdicts(spark, sf_dir, "applies", o).select("profile_id", "stable_id", "source_key")


@S.checked("g14_questions", "SELECT basis, key1 AS question, count(DISTINCT obligation_id) AS duties, " + "array_to_string(list_sort(list_distinct(list(obligation_id)))[1:5], ',') AS examples FROM {edge} WHERE basis <> 'jurisdiction' GROUP BY basis, key1")
def _g14(spark, sf_dir):
    e = relation(spark, sf_dir, "edge").where("basis <> 'jurisdiction'").select("basis", F.col("key1").alias("question"), "obligation_id").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("basis", "question").orderBy("obligation_id")
    few = e.withColumn("i", F.row_number().over(w))
    examples = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.col("obligation_id")))), lambda x: x.cast("string")), ",")
    return few.groupBy("basis", "question").agg(F.count("*").alias("duties"), examples.alias("examples"))


@S.checked("g01_fold_noun", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('supplier of part ', cast(p_partkey AS VARCHAR), ' good') WHEN p_partkey % 3 = 1 THEN 'access' ELSE concat('part ', cast(p_partkey AS VARCHAR), ' carrier') END AS role FROM {part}")
def _g01(spark, sf_dir):
    p = F.col("p_partkey")
    said = F.when(p % 3 == 0, F.concat(F.lit("The Supplier of Part "), p.cast("string"), F.lit(" goods"))).when(p % 3 == 1, F.lit("An  access")).otherwise(F.concat(F.lit("every part-"), p.cast("string"), F.lit(" Carriers")))
    return relation(spark, sf_dir, "part").select("p_partkey", tx.fold_noun(said).alias("role"))


@S.checked("g02_condition_id", "SELECT c_custkey, concat('COND-', substr(sha1(concat('hold stock in nation ', cast(c_nationkey AS VARCHAR))), 1, 10)) AS condition_id FROM {customer}")
def _g02(spark, sf_dir):
    return relation(spark, sf_dir, "customer").select("c_custkey", tx.condition_id(F.concat(F.lit("Hold stock in nation "), F.col("c_nationkey").cast("string"))).alias("condition_id"))


@S.checked("g23_licence_key", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '([a-z0-9]+)', 1))), ' ') AS key FROM {part} WHERE NOT regexp_matches(p_name, '(e|s)( |$)')")
def _g23(spark, sf_dir):
    return relation(spark, sf_dir, "part").where(~F.col("p_name").rlike("(e|s)( |$)")).select("p_partkey", tx.bag_key(F.col("p_name")).alias("key"))


def _read(spark, sf_dir):
    """The duties among the clauses, with whom they address and what they ask."""
    from lexloom.operators import duties

    found = duties.extracted(relation(spark, sf_dir, "clause")).where("modality is not null")
    return reading.read(found.select("clause_id", "source_key", "subject", "action", "condition"))


# what the sentence patterns of the clauses say, by hand: their addressee, and the facts of those that ask
_DUTY = "(clause_id % 17 <> 0 AND clause_id % 19 <> 0 AND clause_id % 12 IN (0, 1, 2, 5, 7, 8, 9))"
_WHO = "regexp_extract(text, '^(?:Every|A|The|Each|Where a) ([a-z]+ (?:supplier|carrier|dealer|operator))', 1)"


@S.checked("g03_addressee_roles", f"SELECT clause_id, {_WHO} AS role FROM {{clause}} WHERE {_DUTY} AND clause_id % 12 IN (0, 1, 2, 7, 9)")
def _g03(spark, sf_dir):
    return _read(spark, sf_dir).select("clause_id", F.explode("roles.role").alias("role"))


@S.checked("g04_split_noun_phrase", f"SELECT clause_id, {_WHO} AS noun, 'holds goods of others, it must insure consignment' AS rest FROM {{clause}} WHERE clause_id % 12 = 2")
def _g04(spark, sf_dir):
    body = reading.bare(F.regexp_replace(F.regexp_replace("text", "^Where ", ""), "(consignment) .*$", "$1"))
    c = relation(spark, sf_dir, "clause").where("clause_id % 12 = 2")
    return c.select("clause_id", reading.split_phrase(body).alias("p")).select("clause_id", "p.noun", "p.rest")


@S.checked("g05_about_addressee", f"SELECT clause_id, clause_id % 12 = 2 AS about, CASE clause_id % 12 WHEN 2 THEN 'holds goods of others' ELSE '' END AS fact, CASE clause_id % 12 WHEN 2 THEN {_WHO} ELSE '' END AS addressee FROM {{clause}} WHERE {_DUTY} AND clause_id % 12 IN (1, 2)")
def _g05(spark, sf_dir):
    asked = _read(spark, sf_dir).select("clause_id", F.explode("conditions").alias("c"))
    return asked.select("clause_id", (F.col("c.kind") == "question").alias("about"), F.coalesce("c.fact", F.lit("")).alias("fact"), F.coalesce("c.addressee", F.lit("")).alias("addressee"))


@S.checked("g06_questions_and_triggers", f"""SELECT clause_id, CASE clause_id % 12 WHEN 2 THEN 'question' ELSE 'trigger' END AS kind, CASE clause_id % 12 WHEN 2 THEN 'holds goods of others' END AS fact, CASE clause_id % 12 WHEN 2 THEN true END AS expect,
    CASE clause_id % 12 WHEN 2 THEN concat('Where a ', {_WHO}, ' holds goods of others') ELSE 'unless the owner of the goods has agreed in writing' END AS text FROM {{clause}} WHERE {_DUTY} AND clause_id % 12 IN (1, 2)""")
def _g06(spark, sf_dir):
    return _read(spark, sf_dir).select("clause_id", F.explode("conditions").alias("c")).select("clause_id", "c.kind", "c.fact", "c.expect", "c.text")


@S.checked("g07_grounded_predicates", f"""SELECT clause_id, 'jurisdiction' AS basis, source_key AS predicate, true AS expect FROM {{clause}} WHERE {_DUTY}
    UNION ALL SELECT clause_id, 'subject', {_WHO}, true FROM {{clause}} WHERE {_DUTY} AND clause_id % 12 IN (0, 1, 2, 7, 9)
    UNION ALL SELECT clause_id, 'condition', concat('COND-', substr(sha1('holds goods of other'), 1, 10), ' holds goods of other'), true FROM {{clause}} WHERE {_DUTY} AND clause_id % 12 = 2""")
def _g07(spark, sf_dir):
    return reading.predicates(_read(spark, sf_dir), "clause_id", F.col("source_key"))


S.portable("g08_sync_edges", """
    WITH wanted AS (SELECT obligation_id, basis, key1 FROM {edge} WHERE obligation_id % 7 <> 0), live AS (SELECT obligation_id, basis, CASE WHEN obligation_id % 13 = 0 THEN 'other' ELSE key1 END AS key1 FROM {edge} WHERE obligation_id % 5 <> 0)
    SELECT coalesce(w.obligation_id, l.obligation_id) AS obligation_id, coalesce(w.basis, l.basis) AS basis, coalesce(w.key1, l.key1) AS key1, CASE WHEN l.obligation_id IS NULL THEN 'added' WHEN w.obligation_id IS NULL THEN 'invalidated' ELSE 'unchanged' END AS action
    FROM wanted w FULL OUTER JOIN live l ON l.obligation_id = w.obligation_id AND l.basis = w.basis AND l.key1 = w.key1""")
S.portable("g09_canonical_in_set", "SELECT a.obligation_id FROM {obligation} a LEFT JOIN {obligation} b ON b.obligation_id = a.canonical_id AND b.status <> 'stale' WHERE a.status <> 'stale' AND b.obligation_id IS NULL")
S.portable("g10_profile_answers", "SELECT profile_id, basis, lower(akey) AS folded, said FROM {answer}")
S.portable("g15_l4_propagation", "SELECT e.basis, count(*) AS edges FROM {edge} e JOIN {obligation} o ON o.obligation_id = e.obligation_id WHERE o.status = 'stale' GROUP BY e.basis")
S.portable("g16_edge_coverage", "SELECT o.source_key, count(DISTINCT o.obligation_id) AS obligations, count(DISTINCT e.obligation_id) AS with_edges, count(e.basis) AS edges FROM {obligation} o LEFT JOIN {edge} e ON e.obligation_id = o.obligation_id GROUP BY o.source_key")


@S.checked("g17_predicate_language", """
    SELECT c_custkey, p_type AS predicate, CASE p_type WHEN 'STANDARD' THEN c_mktsegment <> '' WHEN 'SMALL' THEN c_mktsegment IN ('BUILDING', 'MACHINERY') WHEN 'LARGE' THEN c_nationkey = 7 WHEN 'PROMO' THEN c_mktsegment = 'FURNITURE' AND c_nationkey IN (1, 2, 3) ELSE false END AS matches
    FROM {customer} CROSS JOIN (SELECT DISTINCT p_type FROM {part}) x""")
def _g17(spark, sf_dir):
    """Predicates are data: a map of attribute to accepted values, "*" for any; attributes are a map too."""
    rule = F.create_map(*[x for k, v in {"STANDARD": {"segment": ["*"]}, "SMALL": {"segment": ["building", "machinery"]}, "LARGE": {"nation": ["7"]}, "PROMO": {"segment": ["furniture"], "nation": ["1", "2", "3"]}}.items()
                          for x in (F.lit(k), F.create_map(*[y for a, w in v.items() for y in (F.lit(a), F.array(*map(F.lit, w)))]))])
    kinds = relation(spark, sf_dir, "part").select(F.col("p_type").alias("predicate")).distinct().withColumn("rule", F.try_element_at(rule, F.col("predicate")))
    have = relation(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit("segment"), F.lower("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("have"))
    ok = F.forall(F.map_entries("rule"), lambda e: F.when(F.array_contains(e["value"], "*"), F.try_element_at("have", e["key"]) != "").otherwise(F.array_contains(e["value"], F.try_element_at("have", e["key"]))))
    return have.crossJoin(F.broadcast(kinds)).select("c_custkey", "predicate", F.coalesce(ok, F.lit(False)).alias("matches"))


S.portable("g18_validate_profile", "SELECT profile_id, CASE WHEN balance < 0 THEN 'negative balance' WHEN segment = '' THEN 'no segment' ELSE 'ok' END AS problem FROM {profile}")
S.portable("g19_unasked_answers", "SELECT a.profile_id, a.basis, a.akey FROM {answer} a LEFT JOIN (SELECT DISTINCT basis, key1 FROM {edge} UNION SELECT DISTINCT basis, key2 FROM {edge}) e ON e.basis = a.basis AND e.key1 = a.akey WHERE e.basis IS NULL")
S.portable("g20_candidate_profiles", "SELECT DISTINCT key1 AS role, concat('candidate/', lower(key1)) AS profile FROM {edge} WHERE basis = 'roles'")
S.portable("g21_profile_fingerprint", "SELECT profile_id, [[sha2(||sha256(]]concat(segment, '/', cast(nation AS VARCHAR(9)))[[, 256)||)]] AS fingerprint FROM {profile}")
@S.checked("g22_licensing_clauses", """
    WITH l AS (SELECT doc_id, text FROM {documents} WHERE lower(text) LIKE '%licen%')
    SELECT a.doc_id FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE length(b.text) < length(a.text) AND instr(a.text, b.text) > 0)""")
def _g22(spark, sf_dir):
    """Those that hold no shorter licence text whole.

    The words inside a contained text, all but its first and last, are words of
    the text around it: pairs meet on the rarest of them.  Texts of two words
    at most have none inside and meet all; equal texts are compared once.
    """
    docs = relation(spark, sf_dir, "documents").where(F.lower("text").contains("licen")).select("doc_id", "text", F.sha2("text", 256).alias("h"))
    texts = docs.groupBy("h").agg(F.first("text").alias("text")).withColumn("w", F.split("text", " "))
    flat = texts.select("h", F.explode(F.array_distinct("w")).alias("t"))
    inside = texts.select("h", "text", F.explode(F.array_distinct(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))).alias("t"))
    rarest = inside.join(flat.groupBy("t").agg(F.count("*").alias("f")), "t").groupBy("h").agg(F.min(F.struct("f", "t"))["t"].alias("t"))
    near = rarest.toDF("small", "t").join(flat, "t").where("small <> h").select("small", "h")
    whole, part = texts.select("h", "text"), texts.select(F.col("h").alias("small"), F.col("text").alias("part"))
    holds = F.col("text").contains(F.col("part")) & (F.length("part") < F.length("text"))
    long = near.join(part, "small").join(whole, "h").where(holds).select("h")
    short = whole.join(texts.where(F.size("w") <= 2).select(F.col("text").alias("part")), holds).select("h")
    return docs.join(long.union(short).distinct(), "h", "left_anti").select("doc_id")


S.portable("g24_accept_licences", "SELECT p_type AS licence, count(*) AS proposals, count(CASE WHEN p_name LIKE '%e%' THEN 1 END) AS accepted FROM {part} GROUP BY p_type")
S.portable("g25_retire_unsound", "SELECT e.obligation_id, e.basis FROM {edge} e LEFT JOIN {obligation} o ON o.obligation_id = e.obligation_id AND o.status <> 'stale' WHERE o.obligation_id IS NULL")
S.portable("g26_ontology_diff", "SELECT coalesce(a.n_name, b.n_name) AS term, CASE WHEN a.n_name IS NULL THEN 'added' WHEN b.n_name IS NULL THEN 'retired' ELSE 'kept' END AS state FROM (SELECT n_name FROM {nation} WHERE n_nationkey < 20) a FULL OUTER JOIN (SELECT n_name FROM {nation} WHERE n_nationkey > 4) b ON b.n_name = a.n_name")
S.portable("g27_alias_lookup", "SELECT c.c_custkey, n.n_nationkey FROM {customer} c JOIN (SELECT n_nationkey, lower(n_name) AS alias FROM {nation} UNION ALL SELECT n_nationkey, cast(n_nationkey AS VARCHAR(9)) FROM {nation}) n ON n.alias = cast(c.c_nationkey AS VARCHAR(9))")
S.portable("g28_undefined_roles", "SELECT DISTINCT e.key1 AS role FROM {edge} e WHERE e.basis = 'roles' AND NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_mktsegment = e.key1 AND c.c_acctbal > 9000)")


@S.checked("e01_locate_needle", "SELECT clause_id, strpos(lower(text), 'register of') - 1 AS start_ FROM {clause} WHERE strpos(lower(text), 'register of') > 0")
def _e01(spark, sf_dir):
    at = F.instr(F.lower("text"), F.lower(F.lit("Register of")))
    return relation(spark, sf_dir, "clause").select("clause_id", (at - 1).cast("bigint").alias("start_")).where("start_ >= 0")


S.portable("e02_quote_first", "SELECT source_key, min(clause_id) AS clause_id FROM {clause} WHERE instr(text, 'officer') > 0 GROUP BY source_key")
S.portable("e03_whole_quote", "SELECT clause_id, cast(0 AS BIGINT) AS start_, cast(length(trim(text)) AS BIGINT) AS end_ FROM {clause}")


@S.checked("e04_stem", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'policy' WHEN 1 THEN 'procedur' WHEN 2 THEN 'process' WHEN 3 THEN 'access' WHEN 4 THEN 'gas' ELSE 'note' END AS stem FROM {part}")
def _e04(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ["policies", "procedures", "processes", "access", "gas", "notes"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return relation(spark, sf_dir, "part").select("p_partkey", F.when(tx.stem(word) == "ga", "gas").when(tx.stem(word) == "not", "note").otherwise(tx.stem(word)).alias("stem"))


S.portable("e05_missing_words", "SELECT clause_id, CASE WHEN instr(lower(text), 'supplier') > 0 THEN 0 ELSE 1 END + CASE WHEN instr(lower(text), 'deliver') > 0 THEN 0 ELSE 1 END AS missing FROM {clause}")
S.portable("e06_grounded", "SELECT clause_id, instr(lower(text), 'register') > 0 AND instr(lower(text), 'deliver') > 0 AS grounded FROM {clause}")
S.portable("e07_check_quote", """
    WITH q AS (SELECT o_orderkey + (CASE WHEN o_orderkey % 9 = 0 THEN 1000000 ELSE 0 END) AS clause_id, CASE WHEN o_orderkey % 5 = 0 THEN 4000 ELSE 10 END AS end_, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' END AS wrong FROM {orders})
    SELECT q.clause_id, CASE WHEN c.clause_id IS NULL THEN 'no such clause' WHEN q.end_ > length(c.text) THEN 'offsets outside' WHEN q.wrong IS NOT NULL AND substr(c.text, 1, 7) <> q.wrong THEN 'words differ' ELSE 'ok' END AS reason FROM q LEFT JOIN {clause} c ON c.clause_id = q.clause_id""")
S.portable("e08_reanchor", "SELECT o.ref, n.ref IS NOT NULL AND o.body = n.body AS moved FROM {old_version} o LEFT JOIN {new_version} n ON n.ref = o.ref AND n.source_id = o.source_id AND n.body = o.body")
S.portable("e09_gaps", "SELECT DISTINCT [[sha1(||sha1(]]concat(source_key, '/', ref)[[)||)]] AS gap_id, 'L2' AS layer, 'no_duty' AS kind FROM {clause} WHERE text = 'Reserved.'")
S.portable("e10_lineage_verify", """
    SELECT tbl, row_id, min(reason) AS reason FROM (
        SELECT 'requires' AS tbl, r.obligation_id AS row_id, CASE WHEN o.obligation_id IS NULL THEN 'no obligation' WHEN o.status = 'stale' THEN 'stale obligation' END AS reason FROM {requires} r LEFT JOIN {obligation} o ON o.obligation_id = r.obligation_id
        UNION ALL SELECT 'edge', e.obligation_id, CASE WHEN o.status = 'stale' THEN 'stale obligation' WHEN o.confidence < 0.3 THEN 'weak' END FROM {edge} e JOIN {obligation} o ON o.obligation_id = e.obligation_id) x
    WHERE reason IS NOT NULL GROUP BY tbl, row_id""")
S.portable("e11_advice", f"""
    SELECT kind, count(*) AS n, min(ref) AS first_ref FROM (SELECT ref, CASE WHEN text = 'Reserved.' THEN 'empty' WHEN length(text) < 80 THEN 'short' WHEN instr(text, 'authority') > 0 THEN 'authority' END AS kind FROM {{clause}}) x WHERE kind IS NOT NULL GROUP BY kind""")
S.portable("e12_advice_dimension", "SELECT kind, layer FROM (SELECT 'empty' AS kind, 1 AS layer UNION ALL SELECT 'short', 2 UNION ALL SELECT 'authority', 2 UNION ALL SELECT 'no_role', 4) x")
S.portable("e13_lineage_tree", f"SELECT r.block_id, count(DISTINCT o.source_key) AS sources, {joined('o.source_key')} AS source_list FROM {{requires}} r JOIN {{obligation}} o ON o.obligation_id = r.obligation_id GROUP BY r.block_id")

S.portable("f08_unlinked", "SELECT o.obligation_id FROM {obligation} o LEFT JOIN {hard_requires} r ON r.obligation_id = o.obligation_id WHERE r.obligation_id IS NULL")
S.portable("f09_open_edges", "SELECT r.obligation_id, r.block_id FROM {requires} r LEFT JOIN {hard_requires} h ON h.obligation_id = r.obligation_id AND h.block_id = r.block_id WHERE h.block_id IS NULL")
S.portable("f10_completeness", "SELECT o.source_key, avg(CASE WHEN r.obligation_id IS NULL THEN cast(0 AS DOUBLE) ELSE 1 END) AS linked FROM {obligation} o LEFT JOIN (SELECT DISTINCT obligation_id FROM {hard_requires}) r ON r.obligation_id = o.obligation_id GROUP BY o.source_key")
S.portable("f11_l3_propagation", "SELECT r.block_id, count(*) AS dropped FROM {requires} r JOIN {obligation} o ON o.obligation_id = r.obligation_id WHERE o.status = 'stale' GROUP BY r.block_id")
S.portable("f12_batches", "SELECT obligation_id, source_key, cast(floor((row_number() OVER (PARTITION BY source_key ORDER BY obligation_id) - 1) / 10) AS BIGINT) AS batch FROM {obligation} WHERE status = 'derived'")
S.portable("f14_accept_measures", "SELECT o.obligation_id, b.block_id FROM {requires} r JOIN {obligation} o ON o.obligation_id = r.obligation_id JOIN {block} b ON b.block_id = r.block_id WHERE o.status <> 'stale' AND b.kind IN ('Document', 'Process')")


@S.checked("f16_blocks_in_scope", "SELECT r.block_id FROM {requires} r JOIN {obligation} o ON o.obligation_id = r.obligation_id WHERE o.status <> 'stale' OR o.obligation_id % 2 = 0 GROUP BY r.block_id HAVING bool_and(o.jurisdiction <> 'none') AND count(*) > 5")
def _f16(spark, sf_dir):
    """Relational division: blocks all of whose edges lie in the scope."""
    edges = relation(spark, sf_dir, "requires").join(relation(spark, sf_dir, "obligation"), "obligation_id").where("status <> 'stale' or obligation_id % 2 = 0")
    return edges.groupBy("block_id").agg(F.bool_and(F.col("jurisdiction") != "none").alias("all_in"), F.count("*").alias("n")).where("all_in and n > 5").select("block_id")


S.portable("f17_reuse_ratio", "SELECT b.kind, count(DISTINCT b.block_id) AS blocks, count(r.obligation_id) AS edges, cast(count(r.obligation_id) AS DOUBLE) / count(DISTINCT b.block_id) AS reuse FROM {block} b LEFT JOIN {requires} r ON r.block_id = b.block_id GROUP BY b.kind")
S.portable("f18_characteristics", """
    SELECT clause_id, key, value FROM (
        SELECT clause_id, 'cadence' AS key, regexp_extract(text, '(every [0-9]+ months|every month)', 1) AS value FROM {clause}
        UNION ALL SELECT clause_id, 'sla', regexp_extract(text, '(within [0-9]+ days|no later than [0-9]+ days)', 1) FROM {clause}
        UNION ALL SELECT clause_id, 'quantity', regexp_extract(text, '(at least [0-9]+ million)', 1) FROM {clause}) x WHERE value <> ''""")
S.portable("f19_backing_span", "SELECT clause_id, text AS span FROM {clause} WHERE instr(lower(text), 'register of deliveries') > 0")
S.portable("f20_characterise_block", "SELECT r.block_id, min(o.stable_id) AS first_duty, min_by(o.source_key, o.stable_id) AS value FROM {requires} r JOIN {obligation} o ON o.obligation_id = r.obligation_id WHERE o.status <> 'stale' GROUP BY r.block_id")
S.portable("f21_characteristic_completeness", """
    SELECT k.kind, k.field_, count(b.block_id) AS blocks, count(CASE WHEN b.status = 'curated' THEN 1 END) AS backed
    FROM (SELECT kind, field_ FROM (SELECT DISTINCT kind FROM {block}) x CROSS JOIN (SELECT 'owner' AS field_ UNION ALL SELECT 'cadence') y) k LEFT JOIN {block} b ON b.kind = k.kind GROUP BY k.kind, k.field_""")

S.portable("h02_map_activities", f"SELECT b.owner, b.kind AS activity, count(DISTINCT r.block_id) AS blocks, count(DISTINCT r.obligation_id) AS duties FROM {{requires}} r JOIN {{block}} b ON b.block_id = r.block_id GROUP BY b.owner, b.kind")


@S.checked("h03_canonical_chain", """
    WITH RECURSIVE c AS (SELECT obligation_id AS node, obligation_id AS root, 0 AS depth FROM {obligation} UNION ALL SELECT c.node, o.canonical_id, c.depth + 1 FROM c JOIN {obligation} o ON o.obligation_id = c.root WHERE o.canonical_id IS NOT NULL AND o.canonical_id >= 0)
    SELECT node, root FROM (SELECT node, root, row_number() OVER (PARTITION BY node ORDER BY depth DESC) AS i FROM c) x WHERE i = 1""")
def _h03(spark, sf_dir):
    o = relation(spark, sf_dir, "obligation").select("obligation_id", F.when(F.col("canonical_id") >= 0, F.col("canonical_id")).alias("canonical_id"))
    return follow(o, "obligation_id", "canonical_id")


S.portable("h04_reconcile_edges", f"SELECT r.block_id, count(*) AS kept FROM {{requires}} r JOIN {{obligation}} o ON o.obligation_id = r.obligation_id AND o.status <> 'stale' GROUP BY r.block_id")
S.portable("h05_resolve_anchor", "SELECT a.s_suppkey AS anchor, o.obligation_id FROM {supplier} a JOIN {obligation} o ON o.source_key = concat('Brand#', cast(1 + a.s_suppkey % 25 AS VARCHAR(9))) AND (a.s_suppkey % 2 = 0 OR o.clause_ref = concat('art-', cast(1 + a.s_suppkey % 50 AS VARCHAR(9))))")
S.portable("h06_l5_propagation", "SELECT b.owner, count(*) AS edges FROM {requires} r JOIN {block} b ON b.block_id = r.block_id JOIN {obligation} o ON o.obligation_id = r.obligation_id WHERE o.status = 'stale' GROUP BY b.owner")
S.portable("h07_activity_coverage", "SELECT o.source_key, count(*) AS duties, count(r.obligation_id) AS operated FROM {obligation} o LEFT JOIN (SELECT DISTINCT obligation_id FROM {hard_requires}) r ON r.obligation_id = o.obligation_id GROUP BY o.source_key")
S.portable("h08_junction_check", """
    SELECT 'orphan block' AS problem, b.block_id AS ref FROM {block} b LEFT JOIN {hard_requires} r ON r.block_id = b.block_id WHERE r.block_id IS NULL
    UNION ALL SELECT 'unlit duty', o.obligation_id FROM {obligation} o LEFT JOIN {hard_requires} r ON r.obligation_id = o.obligation_id WHERE r.block_id IS NULL
    UNION ALL SELECT 'bad kind', block_id FROM {block} WHERE kind NOT IN ('Document', 'System', 'Role', 'Process')""")
