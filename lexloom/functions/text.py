"""Text helpers as Column expressions: tokens, normal forms, set similarities.

The reference data model has five token rules; they are kept apart here.  All
run inside code generation, without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that similarity of duties leaves out.
DUTY_STOP = (
    "the a an of to and or in on for by with that which its their such any all as at be is are must shall should may "
    "not firm person entity it this these those where when if"
).split()
# Function words that similarity of names leaves out ("not" and "no" stay).
NAME_STOP = "the a an of to and or in on for by with that which its their such any all as at be is are must shall it this these those".split()


def _words_of(stop: list[str]) -> Column:
    return F.array(*map(F.lit, stop))


def fold_space(x: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))


def normalised(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def duty_words(x: Column) -> Column:
    """Distinct words of more than two letters outside the stop list."""
    return F.filter(F.array_except(tokens(x), _words_of(DUTY_STOP)), lambda w: F.length(w) > 2)


def name_words(x: Column) -> Column:
    return F.array_except(tokens(x), _words_of(NAME_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct words; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def containment(a: Column, b: Column, least: int = 4) -> Column:
    """Share of the smaller set that the other has; 0 below ``least`` words."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small >= least, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def stem(word: Column) -> Column:
    """Singular and plural fold to one form."""
    size = F.length(word)
    base = (
        F.when(word.endswith("ies") & (size > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.endswith("sses"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & ~word.endswith("ss") & (size > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    return F.when(base.endswith("e") & (F.length(base) > 4), F.regexp_replace(base, "e$", "")).otherwise(base)


def slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9.]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(s == "", "x").otherwise(s)


def fold_noun(x: Column) -> Column:
    """Folded form of a role or fact: no determiner, lower case, last word singular."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"^(?:(?:a|an|the|each|every|any|all|such|its|their)\s+)+", "")
    joined = F.array_join(F.regexp_extract_all(plain, F.lit(r"([a-z0-9]+)"), F.lit(1)), " ")
    last = F.element_at(F.split(joined, " "), -1)
    return F.when(last.endswith("s") & ~last.endswith("ss") & (F.length(last) > 3), F.regexp_replace(joined, "s$", "")).otherwise(joined)


def condition_id(fact: Column) -> Column:
    return F.concat(F.lit("COND-"), F.substring(F.sha1(fold_noun(fact).cast("binary")), 1, 10))


def bag_key(x: Column) -> Column:
    """Key of a name that doesn't heed order or plural."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(tokens(x), lambda w: stem(w)))), " ")
