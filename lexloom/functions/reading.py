"""Whom a duty addresses and on what it depends, read from its own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import grammar as g
from lexloom.functions import text as tx

# What makes a duty conditional, what splits and qualifies noun phrases, and verbs that don't end in -s.
CONNECTIVE = (
    r"(?is)^\s*(where|if|unless|in the event that|to the extent that|provided that|in cases where|"
    r"in so far as|insofar as)\s+(.+?)[\s,;:.]*$"
)
DETERMINERS = r"(?i)^(?:(?:a|an|the|each|every|any|all|such|its|their)\s+)+"
CONJUNCTION = r"(?i)\s*(?:,|\band/or\b|\band\b|\bor\b)\s*"
RELATIVE = r"(?is)\s+((?:who|that|which)\s+.+)$"
QUALIFIER = r"(?i)^(?:applicable|appropriate|possible|necessary|relevant|practicable|required|any)\b"
AUXILIARIES = ("is", "are", "has", "have", "does", "do", "was", "were", "will", "can", "may", "uses", "holds")
#: Words of a clause among which its verb is looked for.
EARLY = 5


def bare(x: Column) -> Column:
    return F.regexp_replace(x, DETERMINERS, "")


def pronoun(x: Column) -> Column:
    return F.lower(x).isin(*g.PRONOUNS)


def roles(subject: Column, action: Column) -> Column:
    """``array<struct<role, label>>`` that a duty's subject names; empty for pronouns, everyone, and what a passive duty is about."""
    heads = F.filter(F.transform(F.split(F.regexp_replace(subject, RELATIVE, ""), CONJUNCTION), lambda p: F.trim(bare(F.trim(p)))), lambda h: h != "")
    named = F.filter(heads, lambda h: ~g.universal(h) & ~h.rlike(CONNECTIVE) & ~h.rlike(QUALIFIER))
    out = F.transform(named, lambda h: F.struct(tx.fold_noun(h).alias("role"), h.alias("label")))
    return F.when((F.coalesce(subject, F.lit("")) != "") & g.binds(action) & ~pronoun(subject), out).otherwise(F.array().cast("array<struct<role:string,label:string>>"))


def relative_fact(subject: Column) -> Column:
    """What a relative clause of the subject says of it; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(subject, RELATIVE, 1), r"(?i)^(?:who|that|which)\s+", "")


def split_phrase(body: Column) -> Column:
    """``struct<noun, rest>``: the noun phrase before the first verb-like word among the first five; no noun if there is none."""
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    verb = lambda w: F.lower(w).isin(*AUXILIARIES) | (F.lower(w).endswith("s") & ~F.lower(w).endswith("ss") & (F.length(w) > 3))
    at = F.array_position(F.transform(F.slice(words, 1, EARLY), lambda w, i: (i > 0) & verb(w)), True).cast("int")
    noun = F.when(at > 0, F.array_join(F.slice(words, F.lit(1), at - 1), " ")).otherwise("")
    return F.struct(noun.alias("noun"), F.when(at > 0, F.array_join(F.slice(words, at, F.size(words)), " ")).otherwise(body).alias("rest"))


def about(rest: Column, subject: Column) -> Column:
    """``struct<about, fact, addressee>``: whether a clause speaks of the addressee, what it says, and whom it names.

    It does if it opens with a pronoun, with the duty's subject, or with a word
    for anyone; where the subject is a pronoun, the clause's own noun phrase is
    the addressee.
    """
    body, own = bare(rest), bare(F.coalesce(subject, F.lit("")))
    first = F.split(rest, r"\s+")[0]
    phrase = split_phrase(body)
    noun, fact = phrase["noun"], phrase["rest"]
    anyone = g.universal(noun)
    no = F.lit("")
    made = lambda yes, what, who: F.struct(F.lit(yes).alias("about"), what.alias("fact"), who.alias("addressee"))
    return (
        F.when(F.trim(rest) == "", made(False, no, no))
        .when(pronoun(first), made(True, F.trim(F.substring(rest, F.length(first) + 1, F.length(rest))), no))
        .when((own != "") & ~pronoun(own) & F.startswith(F.lower(body), F.concat(F.lower(own), F.lit(" "))), made(True, F.trim(F.substring(body, F.length(own) + 1, F.length(body))), no))
        .when((noun != "") & anyone, made(True, fact, no)).when((noun != "") & pronoun(own), made(True, fact, noun)).otherwise(made(False, no, no))
    )


def conditions(condition: Column, subject: Column) -> Column:
    """``array<struct<kind, fact, text, expect, addressee>>``: each clause of a condition as a question about the addressee, or a trigger."""
    parts = F.filter(F.transform(F.split(F.coalesce(condition, F.lit("")), "; "), lambda p: F.trim(p)), lambda p: p != "")

    def read(part: Column) -> Column:
        rest = F.regexp_extract(part, CONNECTIVE, 2)
        told = about(rest, subject)
        asks = (rest != "") & ~rest.rlike(QUALIFIER) & told["about"] & (told["fact"] != "")
        return F.struct(
            F.when(asks, "question").otherwise("trigger").alias("kind"), F.when(asks, told["fact"]).alias("fact"), part.alias("text"),
            F.when(asks, F.lower(F.regexp_extract(part, CONNECTIVE, 1)) != "unless").alias("expect"), F.when(asks & (told["addressee"] != ""), told["addressee"]).alias("addressee"),
        )

    return F.transform(parts, read)


def read(duties: DataFrame) -> DataFrame:
    """Adds ``roles`` and ``conditions`` to ``subject, action, condition``; a relative clause of the subject is a condition too.

    Null and empty parts name nobody and ask nothing.
    """
    subject = F.trim(F.regexp_replace(F.coalesce("subject", F.lit("")), r"\s+", " "))
    staged = g.staged(duties, {"_subject": subject})
    named = g.staged(staged, {"_roles": roles(F.col("_subject"), F.col("action")), "_asked": conditions(F.col("condition"), F.col("_subject")), "_fact": relative_fact(F.col("_subject"))})
    relative = F.struct(F.lit("question").alias("kind"), F.col("_fact").alias("fact"), F.regexp_extract("_subject", RELATIVE, 1).alias("text"), F.lit(True).alias("expect"), F.lit(None).cast("string").alias("addressee"))
    addressees = F.transform(F.filter("_asked", lambda q: q["addressee"].isNotNull()), lambda q: F.struct(tx.fold_noun(q["addressee"]).alias("role"), q["addressee"].alias("label")))
    own = (F.col("_fact") != "") & g.binds(F.col("action")) & ~pronoun(F.col("_subject"))
    return named.select(*duties.columns, F.concat("_roles", addressees).alias("roles"), F.when(own, F.concat("_asked", F.array(relative))).otherwise(F.col("_asked")).alias("conditions"))


def predicates(read_: DataFrame, key: str, jurisdiction: Column) -> DataFrame:
    """``key, basis, predicate, expect``: the edges that a duty should have, from :func:`read`.

    The jurisdiction in capitals, the distinct roles in order, and for each
    question its condition id and folded fact.
    """
    where = F.upper(jurisdiction)
    place = F.when(F.coalesce(where, F.lit("")) != "", F.array(F.struct(F.lit("jurisdiction").alias("basis"), where.alias("predicate"), F.lit(True).alias("expect"))))
    names = F.array_sort(F.array_distinct(F.transform("roles", lambda r: r["role"])))
    who = F.when(F.size(names) > 0, F.array(F.struct(F.lit("subject").alias("basis"), F.array_join(names, "|").alias("predicate"), F.lit(True).alias("expect"))))
    asked = F.filter("conditions", lambda c: c["kind"] == "question")
    what = F.transform(asked, lambda c: F.struct(F.lit("condition").alias("basis"), F.concat_ws(" ", tx.condition_id(c["fact"]), tx.fold_noun(c["fact"])).alias("predicate"), c["expect"].alias("expect")))
    none = F.array().cast("array<struct<basis:string,predicate:string,expect:boolean>>")
    edges = F.concat(F.coalesce(place, none), F.coalesce(who, none), F.coalesce(what, none))
    return read_.withColumn("_edges", edges).select(key, F.explode("_edges").alias("e")).select(key, "e.basis", "e.predicate", "e.expect").distinct()
