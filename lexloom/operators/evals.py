"""Quality gates as operators: measures over relations, with thresholds as parameters (M, B13-B20).

Each takes DataFrames, aggregates without collecting and returns the figures
beside ``passed``, so a red gate shows why.  Null keys never match; an empty
side gives no groups, or a null score that doesn't pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.functions.grammar import staged


def passes(score: Column, least: float) -> Column:
    return F.coalesce(score >= least, F.lit(False))


def fidelity(spans: DataFrame, trees: DataFrame, key: str, least: float = 0.995) -> DataFrame:
    """``key, spans, missing, score, passed``: the share of the original's tokens whose span the parsed text holds.

    ``spans(key, span)`` are the original's, ``trees(key, text)`` what was
    parsed.  Spans without tokens count as held; a document that was not
    parsed holds nothing.  White space is folded on both sides.
    """
    held = spans.join(trees, key, "left").select(
        key, F.size(tx.tokens(F.col("span"))).alias("n"),
        F.coalesce(F.contains(tx.fold_space(F.col("text")), tx.fold_space(F.col("span"))), F.lit(False)).alias("held"),
    )
    out = held.groupBy(key).agg(F.count("*").alias("spans"), F.count(F.when(~F.col("held") & (F.col("n") > 0), 1)).alias("missing"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("got"), F.sum("n").alias("all"))
    score = F.when(F.col("all") > 0, F.col("got") / F.col("all")).otherwise(F.lit(1.0))
    return out.select(key, "spans", "missing", score.alias("score"), passes(score, least).alias("passed"))


def strided(df: DataFrame, group: str, key: str, share: float = 0.1, least: int = 50) -> DataFrame:
    """A sample of each group at even strides: ``share`` of its rows, or ``least`` rows if that is more (all, if there are fewer)."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    stride = F.greatest(F.lit(1), F.floor(n / F.greatest(F.ceil(n * share), F.lit(least))))
    return df.withColumns({"_i": F.row_number().over(w.orderBy(key)) - 1, "_stride": stride}).where("_i % _stride = 0").drop("_i", "_stride")


def round_trip(nodes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``key, nodes, wrong, passed``: whether each node's text is what its span ``[start_, end_)`` cuts out of the document."""
    cut = F.substring(F.col("whole"), F.col("start_").cast("int") + 1, (F.col("end_") - F.col("start_")).cast("int"))
    judged = nodes.join(texts.withColumnRenamed("text", "whole"), key, "left").withColumn("exact", F.coalesce(cut == F.col("text"), F.lit(False)))
    return judged.groupBy(key).agg(F.count("*").alias("nodes"), F.count(F.when(~F.col("exact"), 1)).alias("wrong")).withColumn("passed", F.col("wrong") == 0)


def changes(old: DataFrame, new: DataFrame, keys: list[str], body: str) -> DataFrame:
    """``keys, kind`` of every unit of two versions: added, removed, amended or unchanged (bodies compared null-safely)."""
    both = old.select(*keys, F.col(body).alias("_a"), F.lit(True).alias("_old")).join(new.select(*keys, F.col(body).alias("_b"), F.lit(True).alias("_new")), keys, "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "amended").otherwise("unchanged")
    return both.select(*keys, kind.alias("kind"))


def change_replay(recorded: DataFrame, replayed: DataFrame, keys: list[str]) -> DataFrame:
    """``recorded, replayed, missing, extra, passed``: recorded changes against those that the versions give."""
    a, b = recorded.select(*keys, "kind"), replayed.where("kind <> 'unchanged'").select(*keys, "kind")
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "kind"], "full")
    out = both.agg(F.count("_a").alias("recorded"), F.count("_b").alias("replayed"), F.count(F.when(F.col("_a").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_b").isNull(), 1)).alias("extra"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))


def provenance(artifacts: DataFrame, group: str, body: str, recorded: str) -> DataFrame:
    """``group, artifacts, broken, passed``: hashes computed anew against those on record; no record is a break."""
    ok = F.coalesce(F.sha2(F.col(body), 256) == F.col(recorded), F.lit(False))
    return artifacts.groupBy(group).agg(F.count("*").alias("artifacts"), F.count(F.when(~ok, 1)).alias("broken")).withColumn("passed", F.col("broken") == 0)


def hits_at(golden: DataFrame, ranked: DataFrame, k: int = 5, least: float = 0.95) -> DataFrame:
    """``queries, hits, score, passed``: golden queries that find one of their documents among the first ``k``."""
    found = ranked.where(F.col("place") <= k).join(golden, ["query_id", "doc_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    out = golden.select("query_id").distinct().join(found, "query_id", "left").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"))
    score = F.when(F.col("queries") > 0, F.col("hits") / F.col("queries"))
    return out.withColumns({"score": score, "passed": passes(score, least)})


def boundary_f1(golden: DataFrame, parsed: DataFrame, by: str, unit: str, least: float = 0.98) -> DataFrame:
    """``by, hit, golden, parsed, precision_, recall_, f1, passed`` for each document: units that both sides have."""
    a, b = golden.select(by, unit).distinct().withColumn("_g", F.lit(1)), parsed.select(by, unit).distinct().withColumn("_p", F.lit(1))
    out = a.join(b, [by, unit], "full").groupBy(by).agg(F.count(F.when(F.col("_g").isNotNull() & F.col("_p").isNotNull(), 1)).alias("hit"), F.count("_g").alias("golden"), F.count("_p").alias("parsed"))
    rate = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    hit, g, p = F.col("hit"), F.col("golden"), F.col("parsed")
    f1 = rate(2 * hit, g + p)
    return out.withColumns({"precision_": rate(hit, p), "recall_": rate(hit, g), "f1": f1, "passed": passes(f1, least)})


def suite(scores: DataFrame, score: str, least: float) -> DataFrame:
    """``documents, mean, passed`` of a column of scores."""
    mean = F.avg(score)
    return scores.agg(F.count("*").alias("documents"), mean.alias("mean"), passes(mean, least).alias("passed"))


def confusion(judged: DataFrame, said: str, truth: str, least_precision: float = 0.75, least_recall: float = 0.70) -> DataFrame:
    """``tp, fp, fn, precision_, recall_, passed`` of two boolean columns; unknown counts as false."""
    s, t = F.coalesce(F.col(said), F.lit(False)), F.coalesce(F.col(truth), F.lit(False))
    out = judged.agg(F.count(F.when(s & t, 1)).alias("tp"), F.count(F.when(s & ~t, 1)).alias("fp"), F.count(F.when(~s & t, 1)).alias("fn"))
    p, r = (F.when(F.col("tp") + F.col(x) > 0, F.col("tp") / (F.col("tp") + F.col(x))) for x in ("fp", "fn"))
    return out.withColumns({"precision_": p, "recall_": r, "passed": passes(p, least_precision) & passes(r, least_recall)})


def accuracy(inferred: DataFrame, golden: DataFrame, keys: list[str], least: float = 0.95) -> DataFrame:
    """``golden, right, accuracy, passed``: golden labels that were inferred as they are; missing ones are wrong."""
    both = golden.select(*keys, F.col("kind").alias("_truth")).join(inferred.select(*keys, "kind"), keys, "left")
    share = F.when(F.col("golden") > 0, F.col("right") / F.col("golden"))
    return both.agg(F.count("*").alias("golden"), F.count(F.when(F.col("_truth") == F.col("kind"), 1)).alias("right")).withColumns({"accuracy": share, "passed": passes(share, least)})


def coverage(wanted: DataFrame, have: DataFrame, key: str, by: str | None = None, least: float = 1.0) -> DataFrame:
    """``[by,] wanted, covered, share, passed``: keys of ``wanted`` that ``have`` has."""
    both = wanted.join(have.select(key).distinct().withColumn("_have", F.lit(1)), key, "left")
    out = (both.groupBy(by) if by else both).agg(F.count("*").alias("wanted"), F.count("_have").alias("covered"))
    share = F.when(F.col("wanted") > 0, F.col("covered") / F.col("wanted"))
    return out.withColumns({"share": share, "passed": passes(share, least)})


def dangling(edges: dict[str, DataFrame], nodes: DataFrame, key: str) -> DataFrame:
    """``edge, edges, dangling, passed`` of each kind of edge: ends that aren't live nodes."""
    out = None
    for name, e in edges.items():
        part = e.select(key).join(nodes.select(key).distinct().withColumn("_live", F.lit(1)), key, "left").agg(F.count("*").alias("edges"), F.count(F.when(F.col("_live").isNull(), 1)).alias("dangling"))
        part = part.select(F.lit(name).alias("edge"), "edges", "dangling", (F.col("dangling") == 0).alias("passed"))
        out = part if out is None else out.union(part)
    return out


def grams(w: Column, n: int) -> Column:
    """Distinct runs of ``n`` of an array's words; the array must be a column, or it is computed for every run."""
    last = F.size(w) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))).otherwise(F.array().cast("array<string>"))


def concept_integrity(concepts: DataFrame, members: DataFrame, n: int = 8) -> DataFrame:
    """``concept, members, leaks, passed``: a concept has members, and its wording shares no run of ``n`` tokens with theirs.

    ``concepts(concept, text)``, ``members(concept, member, text)``.  Runs meet
    by equality, so a common one costs its own rows only.
    """
    runs = lambda df: staged(df, {"_w": tx.tokens(F.col("text"))}).withColumn("g", F.explode(grams(F.col("_w"), n)))
    said = runs(concepts).select("concept", "g").distinct()
    leaked = runs(members).select("concept", "member", "g").join(said, ["concept", "g"], "left_semi").select("concept", "member").distinct()
    counted = members.groupBy("concept").agg(F.countDistinct("member").alias("members"))
    out = concepts.select("concept").distinct().join(counted, "concept", "left").join(leaked.groupBy("concept").agg(F.count("*").alias("leaks")), "concept", "left").fillna(0, ["members", "leaks"])
    return out.withColumn("passed", (F.col("members") > 0) & (F.col("leaks") == 0))


def lint(nodes: DataFrame, key: str) -> DataFrame:
    """``key, ref, problem, n``: refs that a document has twice, clauses without a ref, labels that begin their own text again."""
    twice = nodes.where("ref is not null").groupBy(key, "ref").agg(F.count("*").alias("n")).where("n > 1").select(key, "ref", F.lit("duplicate ref").alias("problem"), "n")
    bare = nodes.where("kind = 'clause' and ref is null").groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(None).cast("string").alias("ref"), F.lit("no ref").alias("problem"), "n")
    again = nodes.where((F.coalesce("label", F.lit("")) != "") & F.startswith(F.ltrim("text"), F.col("label"))).groupBy(key, "ref").agg(F.count("*").alias("n")).select(key, "ref", F.lit("label repeated").alias("problem"), "n")
    return twice.union(bare).union(again)


def reread(original: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``key, blocks, mismatches, passed``: blocks ``(key, pos, text)`` read again against those stored, in order."""
    both = original.select(key, "pos", F.col("text").alias("_a"), F.lit(1).alias("_o")).join(stored.select(key, "pos", F.col("text").alias("_b"), F.lit(1).alias("_s")), [key, "pos"], "full")
    wrong = F.col("_o").isNull() | F.col("_s").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(key).agg(F.count("_o").alias("blocks"), F.count(F.when(wrong, 1)).alias("mismatches")).withColumn("passed", F.col("mismatches") == 0)


def bijection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``both, only_left, only_right, twice, passed``: every key on both sides, once each."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("_l")), right.groupBy(*keys).agg(F.count("*").alias("_r"))
    l, r = F.col("_l"), F.col("_r")
    out = a.join(b, keys, "full").agg(
        F.count(F.when(l.isNotNull() & r.isNotNull(), 1)).alias("both"), F.count(F.when(r.isNull(), 1)).alias("only_left"), F.count(F.when(l.isNull(), 1)).alias("only_right"), F.count(F.when((l > 1) | (r > 1), 1)).alias("twice"))
    return out.withColumn("passed", (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("twice") == 0))


def same_rows(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """``missing, extra, passed``: rows of either side that the other has not, counted with repeats."""
    missing, extra = parsed.exceptAll(stored).agg(F.count("*").alias("missing")), stored.exceptAll(parsed).agg(F.count("*").alias("extra"))
    return missing.crossJoin(extra).withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))


def duplicate_rate(doubled: DataFrame, everything: DataFrame, key: str, most: float = 0.01) -> DataFrame:
    """``rate, passed``: the share of rows that repeat an earlier one."""
    n = doubled.agg(F.countDistinct(key).alias("n"))
    rate = F.when(F.col("all") > 0, F.col("n") / F.col("all"))
    return n.crossJoin(everything.agg(F.count("*").alias("all"))).select(rate.alias("rate"), F.coalesce(rate < most, F.lit(False)).alias("passed"))


def numbers_echo(told: DataFrame, key: str, text: str, allowed: Column) -> DataFrame:
    """``key, stated, foreign, passed``: numbers in a text that are none of the ``allowed`` ones (an array of strings)."""
    stated = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?<=[0-9]),(?=[0-9]{3})", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    foreign = F.size(F.array_except(stated, allowed))
    return told.select(key, F.size(stated).alias("stated"), foreign.alias("foreign"), (foreign == 0).alias("passed"))


def reuse(edges: DataFrame, most: float = 10.0) -> DataFrame:
    """``reuse, explosion``: duties for each component, and whether components outnumber duties by more than ``most``."""
    out = edges.agg(F.count("*").alias("n"), F.countDistinct("block_id").alias("b"), F.countDistinct("obligation_id").alias("o"))
    return out.select((F.col("n") / F.col("b")).alias("reuse"), (F.col("b") > most * F.col("o")).alias("explosion"))
