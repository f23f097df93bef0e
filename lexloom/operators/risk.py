"""Risk scores from outcomes, their calibration, and cohorts with k-anonymity (J, K)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import notices
from lexloom.plans.fixpoint import few
from lexloom.plans.portable import Suite, days, joined, pattern, relation

S = Suite()
QUERIES, ORACLE = S.queries, S.oracles

# Half-life and windows, weights, bands, default logistic, grid, anonymity.
HALF_LIFE_YEARS = 3
WEIGHTS = {"history": 0.30, "financial": 0.20, "reputational": 0.20, "operational": 0.10, "change": 0.10, "attention": 0.10}
BANDS = ((0.75, "critical"), (0.55, "high"), (0.35, "medium"))
LOGISTIC = (-2.5, 3.0, 1.0)
K_ANONYMOUS, BUCKETS = 5, 10
AS_OF = "DATE '2024-01-31'"


def history(day: Column, as_of: Column) -> Column:
    """Aggregate: outcomes weighted by half for each half-life of age."""
    return F.sum(F.pow(F.lit(0.5), F.datediff(as_of, day) / 365.25 / HALF_LIFE_YEARS))


def financial(amount: Column) -> Column:
    return 0.6 * F.log10(1 + F.sum(amount)) + 0.4 * F.log10(1 + F.max(amount))


def reputational(kind: Column) -> Column:
    return F.avg(F.when(kind.isin("prohibition", "censure", "suspension"), 1.0).otherwise(0.0))


def scaled(x: str, *over: str) -> Column:
    """Share of the corpus maximum, at most 1, four places."""
    return F.round(F.least(F.col(x) / F.max(x).over(Window.partitionBy(*over)), F.lit(1.0)), 4)


def composite(df: DataFrame) -> Column:
    return F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4)


def band(x: Column) -> Column:
    out = F.lit("low")
    for edge, name in reversed(BANDS):
        out = F.when(x >= edge, name).otherwise(out)
    return out


def likelihood(history_: Column, attention: Column, params: tuple[float, float, float] = LOGISTIC) -> Column:
    a, b, c = params
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), a + b * history_ + c * attention))
    return 1 / (1 + F.exp(-z))


def features(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """One row for each duty: a single combined aggregation, then scaling by maxima of the (small) result."""
    raw = outcomes.where(F.col("decided_on") < as_of).groupBy("obligation_id").agg(
        history(F.col("decided_on"), as_of).alias("h"), financial(F.col("amount")).alias("f"), reputational(F.col("kind")).alias("reputational"),
        F.count_if(F.datediff(as_of, F.col("decided_on")) <= 10).alias("att"), F.countDistinct(F.col("decided_on")).alias("op"), F.count_if(F.col("kind") == "fine").alias("ch"),
    )
    top = raw.agg(*[F.max(c).alias(f"top_{c}") for c in ("h", "f", "att", "op", "ch")])
    share = lambda c: F.round(F.least(F.col(c) / F.col(f"top_{c}"), F.lit(1.0)), 4)
    return raw.crossJoin(F.broadcast(top)).select(
        "obligation_id", share("h").alias("history"), share("f").alias("financial"), F.round("reputational", 4).alias("reputational"),
        share("op").alias("operational"), share("ch").alias("change"), share("att").alias("attention"),
    )


def _features_sql(as_of: str) -> str:
    return f"""
    raw AS (SELECT obligation_id, sum(pow(0.5, date_diff('day', decided_on, {as_of}) / 365.25 / 3)) AS h, 0.6 * log10(1 + sum(amount)) + 0.4 * log10(1 + max(amount)) AS f, avg(CASE WHEN kind IN ('prohibition', 'censure', 'suspension') THEN 1.0::DOUBLE ELSE 0 END) AS r,
        count(*) FILTER (WHERE date_diff('day', decided_on, {as_of}) <= 10) AS att, count(DISTINCT decided_on) AS op, count(*) FILTER (WHERE kind = 'fine') AS ch FROM {{outcome}} WHERE decided_on < {as_of} GROUP BY obligation_id),
    feat AS (SELECT obligation_id, round(least(h / max(h) OVER (), 1.0), 4) AS history, round(least(f / max(f) OVER (), 1.0), 4) AS financial, round(r, 4) AS reputational, round(least(op / max(op) OVER (), 1.0), 4) AS operational, round(least(ch / max(ch) OVER (), 1.0), 4) AS change, round(least(att / max(att) OVER (), 1.0), 4) AS attention FROM raw)"""


def _f(spark, sf_dir):
    return features(relation(spark, sf_dir, "outcome"), F.expr(AS_OF))


@S.checked("j14_history", "SELECT obligation_id, round(sum(pow(0.5, date_diff('day', decided_on, DATE '2024-01-31') / 365.25 / 3)), 6) AS history FROM {outcome} GROUP BY obligation_id")
def _j14(spark, sf_dir):
    return relation(spark, sf_dir, "outcome").groupBy("obligation_id").agg(F.round(history(F.col("decided_on"), F.expr(AS_OF)), 6).alias("history"))


@S.checked("j15_financial", "SELECT obligation_id, round(0.6 * log10(1 + sum(amount)) + 0.4 * log10(1 + max(amount)), 6) AS financial FROM {outcome} GROUP BY obligation_id")
def _j15(spark, sf_dir):
    return relation(spark, sf_dir, "outcome").groupBy("obligation_id").agg(F.round(financial(F.col("amount")), 6).alias("financial"))


@S.checked("j16_reputational", "SELECT obligation_id, avg(CASE WHEN kind IN ('prohibition', 'censure', 'suspension') THEN 1.0::DOUBLE ELSE 0 END) AS reputational FROM {outcome} GROUP BY obligation_id")
def _j16(spark, sf_dir):
    return relation(spark, sf_dir, "outcome").groupBy("obligation_id").agg(reputational(F.col("kind")).alias("reputational"))


S.portable("j17_operational", "SELECT obligation_id, count(DISTINCT r.block_id) + cast(0.5 AS DOUBLE) * count(DISTINCT b.owner) AS operational FROM {requires} r JOIN {block} b ON b.block_id = r.block_id GROUP BY obligation_id")
S.portable("j18_change_counts", "SELECT record_id, count(*) AS changes FROM {history} WHERE valid_from >= TIMESTAMP '2024-01-05 00:00:00' AND valid_from < TIMESTAMP '2024-01-20 00:00:00' GROUP BY record_id")
S.portable("j19_regulator_volume", "SELECT kind, count(DISTINCT event_id) AS events FROM {outcome} WHERE decided_on >= DATE '2024-01-10' GROUP BY kind")


@S.checked("j20_scale", "WITH t AS (SELECT obligation_id, sum(amount) AS s FROM {outcome} GROUP BY obligation_id) SELECT obligation_id, round(least(s / max(s) OVER (), 1.0), 4) AS scaled FROM t")
def _j20(spark, sf_dir):
    t = relation(spark, sf_dir, "outcome").groupBy("obligation_id").agg(F.sum("amount").alias("s"))
    return t.crossJoin(F.broadcast(t.agg(F.max("s").alias("top")))).select("obligation_id", F.round(F.least(F.col("s") / F.col("top"), F.lit(1.0)), 4).alias("scaled"))


@S.checked("j21_features", f"WITH {_features_sql(AS_OF)} SELECT * FROM feat")
def _j21(spark, sf_dir):
    return _f(spark, sf_dir)


@S.checked("j22_likelihood", f"WITH {_features_sql(AS_OF)} SELECT obligation_id, round(1 / (1 + exp(-(-2.5 + 3.0 * history + attention))), 6) AS likelihood FROM feat")
def _j22(spark, sf_dir):
    return _f(spark, sf_dir).select("obligation_id", F.round(likelihood(F.col("history"), F.col("attention")), 6).alias("likelihood"))


_COMPOSITE = "round(0.30 * history + 0.20 * financial + 0.20 * reputational + 0.10 * operational + 0.10 * change + 0.10 * attention, 4)"


@S.checked("j23_composite", f"WITH {_features_sql(AS_OF)} SELECT obligation_id, {_COMPOSITE} AS composite FROM feat")
def _j23(spark, sf_dir):
    f = _f(spark, sf_dir)
    return f.select("obligation_id", composite(f).alias("composite"))


@S.checked("j24_band", f"WITH {_features_sql(AS_OF)} SELECT obligation_id, CASE WHEN c >= 0.75 THEN 'critical' WHEN c >= 0.55 THEN 'high' WHEN c >= 0.35 THEN 'medium' ELSE 'low' END AS band FROM (SELECT obligation_id, {_COMPOSITE} AS c FROM feat) x")
def _j24(spark, sf_dir):
    f = _f(spark, sf_dir)
    return f.select("obligation_id", band(composite(f)).alias("band"))


# periods of the calibration: weeks; features as of a week's start, label: a fine in it
_WEEKS = ["2024-01-08", "2024-01-15", "2024-01-22"]


def period_rows(outcomes: DataFrame, starts: list[str], length: int = 7) -> DataFrame:
    """Features as of each period's start with the label of what happened in it."""
    out = None
    for s in starts:
        day = F.lit(s).cast("date")
        hit = outcomes.where((F.col("decided_on") >= day) & (F.col("decided_on") < F.date_add(day, length)) & (F.col("kind") == "fine")).select("obligation_id").distinct().withColumn("y", F.lit(1))
        rows = features(outcomes, day).join(hit, "obligation_id", "left").select(F.lit(s).alias("period"), "obligation_id", "history", "attention", F.coalesce("y", F.lit(0)).alias("y"))
        out = rows if out is None else out.union(rows)
    return out


def _period_sql() -> str:
    parts = []
    for i, s in enumerate(_WEEKS):
        d = f"DATE '{s}'"
        sql = _features_sql(d).replace("raw AS", f"raw{i} AS").replace("FROM raw)", f"FROM raw{i})").replace("feat AS", f"feat{i} AS")
        parts.append((sql, f"SELECT '{s}' AS period, f.obligation_id, f.history, f.attention, CASE WHEN h.obligation_id IS NULL THEN 0 ELSE 1 END AS y FROM feat{i} f LEFT JOIN (SELECT DISTINCT obligation_id FROM {{outcome}} WHERE decided_on >= {d} AND decided_on < {d} + INTERVAL 7 DAY AND kind = 'fine') h ON h.obligation_id = f.obligation_id"))
    return ", ".join(p[0] for p in parts) + f", rows_ AS ({' UNION ALL '.join(p[1] for p in parts)})"


@S.checked("j28_period_rows", f"WITH {_period_sql()} SELECT * FROM rows_")
def _j28(spark, sf_dir):
    return period_rows(relation(spark, sf_dir, "outcome"), _WEEKS)


# The grid of the calibration, 9 x 8 x 5 points.
GRID_A = [-4.0 + 0.5 * i for i in range(9)]
GRID_B = [0.5 * i for i in range(1, 9)]
GRID_C = [0.0, 0.5, 1.0, 1.5, 2.0]


def calibrate(rows: DataFrame, held_out: str) -> DataFrame:
    """The grid point of least Brier score on all periods but one, and its score on that one.

    Rows that agree in everything that a score looks at are counted first, so
    the grid of 360 points (a fixed number, broadcast) meets their kinds and
    not the rows; each point's score is one combined aggregate.  No row gives
    null scores.
    """
    spark = rows.sparkSession
    lists = [spark.createDataFrame([(x,) for x in g], f"{n} double") for n, g in (("a", GRID_A), ("b", GRID_B), ("c", GRID_C))]
    grid = lists[0].crossJoin(lists[1]).crossJoin(lists[2])
    p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("history") + F.col("c") * F.col("attention"))))
    kinds = rows.groupBy("history", "attention", "y", (F.col("period") == held_out).alias("late")).agg(F.count("*").alias("n"))
    lost = F.pow(p - F.col("y"), 2) * F.col("n")
    mean = lambda late: F.round(F.sum(F.when(F.col("late") == late, lost)) / F.sum(F.when(F.col("late") == late, F.col("n"))), 9)
    scored = kinds.crossJoin(F.broadcast(grid)).groupBy("a", "b", "c").agg(mean(False).alias("train"), mean(True).alias("held_out"))
    return scored.orderBy("train", "b", "c", "a").limit(1)


@S.checked("j25_calibrate", f"""
    WITH {_period_sql()}, g AS (SELECT -4.0 + 0.5 * i AS a, 0.5 * j AS b, 0.5 * k AS c FROM range(9) t(i), range(1, 9) u(j), range(5) v(k))
    SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, round(avg(pow(1 / (1 + exp(-(a + b * history + c * attention)::DOUBLE)) - y, 2)) FILTER (WHERE period <> '2024-01-22'), 9) AS train, round(avg(pow(1 / (1 + exp(-(a + b * history + c * attention)::DOUBLE)) - y, 2)) FILTER (WHERE period = '2024-01-22'), 9) AS held_out
    FROM rows_, g GROUP BY a, b, c ORDER BY train, b, c, a LIMIT 1""")
def _j25(spark, sf_dir):
    return calibrate(period_rows(relation(spark, sf_dir, "outcome"), _WEEKS), _WEEKS[-1])


@S.checked("j26_brier", f"WITH {_period_sql()} SELECT period, round(avg(pow(1 / (1 + exp(-(-2.5 + 3.0 * history + attention))) - y, 2)), 6) AS brier FROM rows_ GROUP BY period")
def _j26(spark, sf_dir):
    rows = period_rows(relation(spark, sf_dir, "outcome"), _WEEKS)
    return rows.groupBy("period").agg(F.round(F.avg(F.pow(likelihood(F.col("history"), F.col("attention")) - F.col("y"), 2)), 6).alias("brier"))


@S.checked("j27_reliability", f"WITH {_period_sql()}, p AS (SELECT 1 / (1 + exp(-(-2.5 + 3.0 * history + attention))) AS p, y FROM rows_) SELECT least(floor(p * 5), 4)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS said, round(avg(y), 6) AS seen FROM p GROUP BY 1")
def _j27(spark, sf_dir):
    p = period_rows(relation(spark, sf_dir, "outcome"), _WEEKS).select(likelihood(F.col("history"), F.col("attention")).alias("p"), "y")
    return p.groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("said"), F.round(F.avg("y"), 6).alias("seen"))


@S.checked("j29_score_supersede", f"WITH {_features_sql(AS_OF)}, now_ AS (SELECT obligation_id, {_COMPOSITE} AS c FROM feat) SELECT obligation_id, c AS composite, CASE WHEN obligation_id % 3 = 0 THEN 'insert' WHEN obligation_id % 3 = 1 THEN 'superseded' ELSE 'unchanged' END AS action FROM now_")
def _j29(spark, sf_dir):
    f = _f(spark, sf_dir)
    now = f.select("obligation_id", composite(f).alias("composite"))
    before = now.where("obligation_id % 3 <> 0").select("obligation_id", F.when(F.col("obligation_id") % 3 == 1, F.col("composite") + 1).otherwise(F.col("composite")).alias("was"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("was") != F.col("composite"), "superseded").otherwise("unchanged")
    return now.join(before, "obligation_id", "left").select("obligation_id", "composite", action.alias("action"))


@S.checked("j30_item_scores", f"WITH {_features_sql(AS_OF)} SELECT r.block_id, max(history) AS history, max(financial) AS financial, max(reputational) AS reputational FROM feat f JOIN {{requires}} r ON r.obligation_id = f.obligation_id GROUP BY r.block_id")
def _j30(spark, sf_dir):
    return _f(spark, sf_dir).join(relation(spark, sf_dir, "requires"), "obligation_id").groupBy("block_id").agg(*[F.max(c).alias(c) for c in ("history", "financial", "reputational")])


@S.checked("j31_scorecard", f"WITH {_features_sql(AS_OF)}, s AS (SELECT obligation_id % 5 AS kind, {_COMPOSITE} AS c FROM feat) SELECT kind, CASE WHEN c >= 0.75 THEN 'critical' WHEN c >= 0.55 THEN 'high' WHEN c >= 0.35 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM s GROUP BY 1, 2")
def _j31(spark, sf_dir):
    f = _f(spark, sf_dir)
    return f.select((F.col("obligation_id") % 5).alias("kind"), band(composite(f)).alias("band")).groupBy("kind", "band").agg(F.count("*").alias("n"))


_DAY = "[[date_format(o_orderdate, '{0}')||strftime(o_orderdate, '{1}')]]"
_NOTICE = f"""CASE o_orderkey % 6 WHEN 0 THEN concat('On ', {_DAY.format('d MMMM yyyy', '%-d %B %Y')}, ' Acme Holdings Ltd was fined €', cast(o_custkey + 1 AS VARCHAR(9)), ' million and GBP 20k.')
    WHEN 1 THEN concat('Jane Doe was banned on ', {_DAY.format('yyyy-MM-dd', '%Y-%m-%d')}, '.') WHEN 2 THEN concat('Public censure of the bank, ', cast(o_orderkey AS VARCHAR(19)), '.')
    WHEN 3 THEN concat('The firm shall pay redress of $1,250,000.50 to clients by ', {_DAY.format('MMM d, yyyy', '%b %-d, %Y')}, '.') WHEN 4 THEN concat('Orders against Globe Bank for US$', cast(o_custkey AS VARCHAR(9)), '. Decided ', {_DAY.format('dd/MM/yyyy', '%d/%m/%Y')}, '.') ELSE 'No further action.' END"""
_LABEL = "CASE o_orderkey % 6 WHEN 0 THEN 'SEC v. Acme Holdings Ltd' WHEN 1 THEN 'Jane Doe (CRD #12345)' WHEN 2 THEN 'Globe' ELSE '' END"


def parse_notice(label: Column, text: Column) -> dict[str, Column]:
    """Kind, date, largest amount and its currency, and the respondent."""
    money, who = notices.largest_amount(text), notices.respondent(label, text)
    return {"kind": notices.kind(text), "decided_on": notices.decided_on(text), "amount": money["amount"], "currency": money["currency"], "respondent": who["name"], "respondent_type": who["type"]}


def _notices(spark, sf_dir):
    from lexloom.plans.portable import run

    return run(spark, sf_dir, f"SELECT o_orderkey AS notice_id, {_LABEL} AS label, {_NOTICE} AS text FROM {{orders}}")


def _read_notices(spark, sf_dir):
    return _notices(spark, sf_dir).select("notice_id", *[c.alias(k) for k, c in parse_notice(F.col("label"), F.col("text")).items()])


# what the six shapes of notices say; days up to the twelfth of a month are read day first
_NOTICE_TRUTH = """SELECT o_orderkey AS notice_id, CASE o_orderkey % 6 WHEN 0 THEN 'fine' WHEN 1 THEN 'prohibition' WHEN 2 THEN 'censure' WHEN 3 THEN 'restitution' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 6 IN (0, 1, 3, 4) THEN cast(o_orderdate AS DATE) END AS decided_on,
    CASE o_orderkey % 6 WHEN 0 THEN (o_custkey + 1) * 1e6 WHEN 3 THEN 1250000.5::DOUBLE WHEN 4 THEN o_custkey::DOUBLE END AS amount, CASE o_orderkey % 6 WHEN 0 THEN 'EUR' WHEN 3 THEN 'USD' WHEN 4 THEN 'USD' END AS currency,
    CASE o_orderkey % 6 WHEN 0 THEN 'Acme Holdings Ltd' WHEN 1 THEN 'Jane Doe' WHEN 2 THEN 'Globe' WHEN 4 THEN 'Globe Bank' ELSE '' END AS respondent, CASE o_orderkey % 6 WHEN 0 THEN 'firm' WHEN 1 THEN 'individual' WHEN 4 THEN 'firm' ELSE 'unknown' END AS respondent_type FROM {orders}"""


@S.checked("j01_parse_notice", _NOTICE_TRUTH)
def _j01(spark, sf_dir):
    return _read_notices(spark, sf_dir)


@S.checked("j02_notice_dates", "SELECT o_orderkey AS notice_id, cast(o_orderdate AS DATE) AS decided_on FROM {orders} WHERE o_orderkey % 6 IN (0, 1, 3, 4)")
def _j02(spark, sf_dir):
    return _notices(spark, sf_dir).select("notice_id", notices.decided_on(F.col("text")).alias("decided_on")).where("decided_on is not null")


@S.checked("j03_largest_amount", f"SELECT notice_id, amount, currency FROM ({_NOTICE_TRUTH}) x WHERE amount IS NOT NULL")
def _j03(spark, sf_dir):
    return _notices(spark, sf_dir).select("notice_id", notices.largest_amount(F.col("text")).alias("m")).where("m is not null").select("notice_id", "m.amount", "m.currency")


@S.checked("j04_sanction_kind", f"SELECT kind, count(*) AS n FROM ({_NOTICE_TRUTH}) x GROUP BY kind")
def _j04(spark, sf_dir):
    return _notices(spark, sf_dir).groupBy(notices.kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@S.checked("j05_respondent", f"SELECT notice_id, respondent, respondent_type FROM ({_NOTICE_TRUTH}) x")
def _j05(spark, sf_dir):
    return _notices(spark, sf_dir).select("notice_id", notices.respondent(F.col("label"), F.col("text")).alias("r")).select("notice_id", F.col("r.name").alias("respondent"), F.col("r.type").alias("respondent_type"))


S.portable("j06_outcomes_per_party", "SELECT o_orderkey AS publication, l_suppkey AS party, count(*) AS items FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, l_suppkey")
S.portable("j07_ingest_outcomes", "SELECT coalesce(o.ref, n.ref) AS event, CASE WHEN o.ref IS NULL THEN 'insert' WHEN n.ref IS NULL THEN 'invalidate' WHEN o.body = n.body THEN 'unchanged' ELSE 're-derive' END AS action FROM {old_version} o FULL OUTER JOIN {new_version} n ON o.ref = n.ref")
S.portable("j08_instrument_names", "SELECT p_name AS name, max_by(p_brand, n) AS source_key, max(n) AS evidence FROM (SELECT p_name, p_brand, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_name) AS total FROM {part} GROUP BY p_name, p_brand) x WHERE total >= 3 GROUP BY p_name HAVING max(n) >= 3 AND count(CASE WHEN n >= 3 THEN 1 END) = 1")
S.portable("j09_alias_citations", "SELECT c.clause_id, p.p_brand AS alias FROM {clause} c JOIN (SELECT p_brand, min(p_partkey) AS n FROM {part} GROUP BY p_brand) p ON instr(c.text, concat(' ', cast(p.n + 10000 AS VARCHAR(9)), ' ')) > 0")


@S.checked("j10_ref_tokens", "SELECT clause_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(ref), '^(section|sec|article|art)[ ._-]*', ''), '[^0-9a-z]+'), x -> x <> ''), '/') AS tokens FROM {clause}".replace("x -> x <> ''", "lambda x: x <> ''"))
def _j10(spark, sf_dir):
    bare = F.regexp_replace(F.lower("ref"), r"^(?:section|sec|article|art)[\s._-]*", "")
    return relation(spark, sf_dir, "clause").select("clause_id", F.array_join(F.filter(F.split(bare, "[^0-9a-z]+"), lambda x: x != ""), "/").alias("tokens"))


@S.checked("j11_resolve_citation", """
    WITH c AS (SELECT o_orderkey AS cite_id, o_custkey % 25 AS src, [(o_orderkey % 40)::VARCHAR, (o_orderkey % 3)::VARCHAR][1 : 1 + (o_orderkey % 2)] AS want FROM {orders}), t AS (SELECT p_partkey AS obligation_id, p_partkey % 25 AS src, CASE WHEN p_partkey % 3 = 0 THEN [(p_size % 40)::VARCHAR] ELSE [(p_size % 40)::VARCHAR, (p_partkey % 3)::VARCHAR] END AS have FROM {part}),
    m AS (SELECT cite_id, obligation_id, CASE WHEN want = have THEN 0.95 WHEN len(want) > len(have) AND want[1 : len(have)] = have THEN 0.85 WHEN len(have) > len(want) AND have[1 : len(want)] = want THEN 0.70 END AS conf FROM c JOIN t ON t.src = c.src AND want[1] = have[1]),
    e AS (SELECT *, max(conf) OVER (PARTITION BY cite_id) AS top FROM m WHERE conf IS NOT NULL)
    SELECT cite_id, obligation_id, conf::DOUBLE AS confidence FROM e WHERE top < 0.95 OR conf = 0.95""")
def _j11(spark, sf_dir):
    """Exact, deeper and shallower matches of reference tokens; an exact one suppresses the others."""
    o, p = relation(spark, sf_dir, "orders"), relation(spark, sf_dir, "part")
    s = lambda c, n: (F.col(c) % n).cast("string")
    cites = o.select(F.col("o_orderkey").alias("cite_id"), (F.col("o_custkey") % 25).alias("src"), F.slice(F.array(s("o_orderkey", 40), s("o_orderkey", 3)), 1, (1 + F.col("o_orderkey") % 2).cast("int")).alias("want"))
    duties = p.select(F.col("p_partkey").alias("obligation_id"), (F.col("p_partkey") % 25).alias("src"), F.when(F.col("p_partkey") % 3 == 0, F.array(s("p_size", 40))).otherwise(F.array(s("p_size", 40), s("p_partkey", 3))).alias("have"))
    # forms of references are judged once: a prefix match shares the first token, an equi-join
    asked = cites.select("src", "want").distinct().withColumn("t", F.col("want")[0])
    held = duties.select("src", "have").distinct().withColumn("t", F.col("have")[0])
    n, m = F.size("want"), F.size("have")
    conf = F.when(F.col("want") == F.col("have"), 0.95).when((n > m) & (F.slice("want", F.lit(1), m) == F.col("have")), 0.85).when((m > n) & (F.slice("have", F.lit(1), n) == F.col("want")), 0.70)
    met = asked.join(held, ["src", "t"]).select("src", "want", "have", conf.alias("confidence")).where("confidence is not null")
    # duties of a form go in lists of about a thousand, and citations get those: no row of the result is shuffled
    sizes = few(duties.groupBy("src", "have").agg(F.ceil(F.count("*") / 1000).alias("parts")), 200_000)
    lists = duties.join(sizes, ["src", "have"]).groupBy("src", "have", F.pmod(F.xxhash64("obligation_id"), "parts").alias("part")).agg(F.collect_list("obligation_id").alias("ids"))
    spread = few(met.join(lists, ["src", "have"]).select("src", "want", "confidence", "ids"), 20_000)
    exact = few(met.where("confidence = 0.95").select("src", "want").distinct().withColumn("exact", F.lit(True)), 200_000)
    # a citation that occurs again is one: an exact match of either suppresses the others
    top = cites.join(exact, ["src", "want"], "left").groupBy("cite_id").agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("exact"), F.collect_list(F.struct("src", "want")).alias("all"))
    each = top.select("cite_id", "exact", F.explode("all").alias("one")).select("cite_id", "exact", "one.src", "one.want")
    found = each.join(spread, ["src", "want"]).where("not exact or confidence = 0.95")
    return found.select("cite_id", F.explode("ids").alias("obligation_id"), "confidence")


S.portable("j12_link_outcomes", "SELECT e.event_id, o.obligation_id, o.stable_id FROM {outcome} e JOIN {obligation} o ON o.obligation_id = e.obligation_id WHERE o.status <> 'stale' AND e.kind = 'fine'")
S.portable("j13_list_outcomes", "SELECT event_id, kind, amount FROM {outcome} WHERE kind IN ('fine', 'censure') AND obligation_id IN (SELECT obligation_id FROM {requires}) ORDER BY CASE WHEN amount > 90 THEN amount END DESC NULLS LAST, event_id LIMIT 50")
S.portable("j32_number_echo", "SELECT clause_id, instr(text, cast(clause_id AS VARCHAR(19))) > 0 AS echoed FROM {clause} WHERE text <> 'Reserved.'")


def latest_per_member(df: DataFrame) -> DataFrame:
    """Each member's last value in a cohort: one struct maximum, combined before the shuffle."""
    return df.groupBy("cohort", "member").agg(F.max(F.struct("submitted_at", "id", "value")).alias("m")).select("cohort", "member", F.col("m.value").alias("value"))


def published(df: DataFrame, k: int = K_ANONYMOUS) -> DataFrame:
    """Aggregates of cohorts with at least k members; smaller ones are suppressed."""
    return df.groupBy("cohort").agg(F.countDistinct("member").alias("members"), F.round(F.avg("value"), 4).alias("mean")).where(F.col("members") >= k)


_LATEST = "latest AS (SELECT cohort, member, value FROM (SELECT *, row_number() OVER (PARTITION BY cohort, member ORDER BY submitted_at DESC, id DESC) AS n FROM {input}) x WHERE n = 1)"


@S.checked("k02_latest_per_member", f"WITH {_LATEST} SELECT * FROM latest")
def _k02(spark, sf_dir):
    return latest_per_member(relation(spark, sf_dir, "input"))


@S.checked("k04_histogram", f"WITH {_LATEST} SELECT cohort, least(greatest(cast(floor(value / 50000) AS BIGINT), 0), 9) AS bucket, count(*) AS n FROM latest GROUP BY 1, 2")
def _k04(spark, sf_dir):
    """Ten buckets on fixed bounds, before noise (which is not reproducible across engines)."""
    b = F.least(F.greatest(F.floor(F.col("value") / 50000).cast("bigint"), F.lit(0)), F.lit(BUCKETS - 1))
    return latest_per_member(relation(spark, sf_dir, "input")).groupBy("cohort", b.alias("bucket")).agg(F.count("*").alias("n"))


def noised(histogram: DataFrame, keys: list[str], secret: str, epsilon: float = 1.0) -> DataFrame:
    """``noised``: counts ``n`` with Laplace noise of scale 1 / epsilon, not below zero.

    The noise is a function of the secret and the keys: the same release is
    published again as it was, whatever the partitions, and who lacks the
    secret can't take the noise away.  Null keys are keys like others.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    bits = F.conv(F.substring(F.sha2(F.concat_ws("\1", F.lit(secret), *parts), 256), 1, 13), 16, 10).cast("double")
    u = (bits + 0.5) / 2**52 - 0.5
    return histogram.withColumn("noised", F.greatest(F.lit(0.0), F.col("n") - F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon))


@S.checked("k03_laplace_noise")
def _k03(spark, sf_dir):
    """The histogram with noise keyed by the session's ``spark.lexloom.noise.secret``, or by a new secret."""
    secret = spark.conf.get("spark.lexloom.noise.secret", None) or uuid.uuid4().hex
    return noised(_k04(spark, sf_dir), ["cohort", "bucket"], secret)


@S.checked("k05_publish_k_anonymous", f"WITH {_LATEST} SELECT cohort, count(DISTINCT member) AS members, round(avg(value), 4) AS mean FROM (SELECT concat(cohort, '/', cast(member % 300 AS VARCHAR)) AS cohort, member, value FROM latest) x GROUP BY cohort HAVING count(DISTINCT member) >= 5")
def _k05(spark, sf_dir):
    fine = latest_per_member(relation(spark, sf_dir, "input")).withColumn("cohort", F.concat("cohort", F.lit("/"), (F.col("member") % 300).cast("string")))
    return published(fine)


S.portable("k01_validate_inputs", "SELECT cohort, count(*) AS submitted, count(CASE WHEN value BETWEEN 1000 AND 400000 THEN 1 END) AS accepted FROM {input} GROUP BY cohort")
S.portable("k06_reidentification_test", "SELECT a.cohort AS a, b.cohort AS b, count(*) AS common FROM (SELECT DISTINCT cohort, member FROM {input}) a JOIN (SELECT DISTINCT cohort, member FROM {input}) b ON a.member = b.member AND a.cohort < b.cohort GROUP BY a.cohort, b.cohort")
S.portable("k07_refresh_cohorts", "SELECT n.n_name AS cohort, count(*) AS members, CASE WHEN count(*) >= 5 THEN round(avg(c.c_acctbal), 4) END AS mean_balance, count(*) >= 5 AS published FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name")
S.portable("k08_k_anonymity", "SELECT c_nationkey, c_mktsegment, count(*) AS members FROM {customer} GROUP BY c_nationkey, c_mktsegment HAVING count(*) >= 5")
S.portable("k10_generate_fills", "SELECT b.block_id, s.slot FROM {block} b JOIN (SELECT 'Document' AS kind, 'owner' AS slot UNION ALL SELECT 'Document', 'cadence' UNION ALL SELECT 'System', 'capability' UNION ALL SELECT 'Role', 'seniority') s ON s.kind = b.kind")
S.portable("k11_stated_numbers", f"SELECT source_key, min_by(regexp_extract(text, {pattern('within ([0-9]+) days').replace('[[', '[[').strip()}, 1), clause_id) AS days_ FROM {{clause}} WHERE text LIKE '%within % days%' GROUP BY source_key")
S.portable("k12_drift", "SELECT o.source_id, bool_or(o.body <> n.body) AS drifted FROM {old_version} o JOIN {new_version} n ON n.ref = o.ref GROUP BY o.source_id")
S.portable("k13_rubric_score", "SELECT clause_id, (CASE WHEN length(text) > 40 THEN 1 ELSE 0 END + CASE WHEN length(text) < 200 THEN 1 ELSE 0 END) / cast(2 AS DOUBLE) >= 0.85 AS passed FROM {clause}")
S.portable("k14_fill_summary", "SELECT kind, status, owner % 3 AS scope, count(*) AS n FROM {block} GROUP BY kind, status, owner % 3")
S.portable("k15_traceability", "SELECT kind, avg(CASE WHEN r.block_id IS NULL THEN cast(0 AS DOUBLE) ELSE 1 END) AS traced FROM {block} b LEFT JOIN (SELECT DISTINCT block_id FROM {hard_requires}) r ON r.block_id = b.block_id GROUP BY kind")
