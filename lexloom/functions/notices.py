"""What a published notice says: when, how much, what kind, against whom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months, money, cues of a notice's kind in order, and words of firms and individuals.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
MONTHS_SHORT = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
MONEY = r"(?i)(£|\$|US\$|USD|GBP|EUR|€)\s?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?(million|m\b|bn|billion|k\b)?"
CURRENCIES = {"£": "GBP", "$": "USD", "US$": "USD", "€": "EUR"}
SCALES = {"million": 1e6, "m": 1e6, "bn": 1e9, "billion": 1e9, "k": 1e3}
KIND_CUES = (
    (r"prohibition order|prohibit(?:ed|s)? .{0,40}from performing|barred|\bbar\b|banned", "prohibition"),
    (r"suspend|suspension", "suspension"),
    (r"restitution|disgorgement|redress|compensat", "restitution"),
    (r"undertaking|voluntary requirement|VREQ", "undertaking"),
    (r"public censure|censure[sd]?\b|public statement", "censure"),
    (r"fine[sd]?\b|financial penalty|civil penalty|penalty of|monetary penalty|pay a penalty|ordered to pay", "fine"),
)
FIRM = (
    r"(?i)\b(ltd|limited|llc|llp|plc|inc|incorporated|corp|corporation|gmbh|s\.?a\.?|bank|capital|securities|"
    r"partners|group|holdings|markets|advisors|advisers|management|services|trust|company|co\b|fund|"
    r"asset|brokers?|exchange|payments)\b"
)
INDIVIDUAL = r"(?i)\b(mr|mrs|ms|dr|individual|former (?:director|ceo|cfo|trader|employee)|crd\s*#?\s*\d+|sole trader)\b"
AGAINST = r"(?:against|fined|fines|ordering|orders)\s+([A-Z][\w&.,' -]{2,80}?)(?:\s+(?:to pay|for|£|\$|€)|[.;])"


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    short = F.array(*[F.lit(m[:3]) for m in MONTHS.split("|")])
    return F.array_position(short, F.lower(F.substring(name, 1, 3))).cast("string")


def decided_on(text: Column) -> Column:
    """The first date by four patterns, tried in order: 2024-03-01, 1/3/2024 (month first where only that is one), 1st March 2024, March 1, 2024."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    iso, slash = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    names = f"({MONTHS}|{MONTHS_SHORT})"
    before, after = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{names}\.?,?\s+(\d{{4}})\b", rf"(?i)\b{names}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
    one, two = part(slash, 1), part(slash, 2)
    american = (F.coalesce(two.try_cast("int"), F.lit(0)) > 12) & (F.coalesce(one.try_cast("int"), F.lit(99)) <= 12)
    return F.coalesce(
        _day(part(iso, 1), part(iso, 2), part(iso, 3)), _day(part(slash, 3), F.when(american, one).otherwise(two), F.when(american, two).otherwise(one)),
        _day(part(before, 3), _month(part(before, 2)), part(before, 1)), _day(part(after, 3), _month(part(after, 1)), part(after, 2)),
    )


def largest_amount(text: Column) -> Column:
    """``struct<amount, currency>`` of the largest sum of money, the first of equals; null if there is none."""
    scale = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    currency = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    at = lambda x, i: F.regexp_extract(x, MONEY, i)

    def read(x: Column, i: Column) -> Column:
        number = F.regexp_replace(at(x, 2), ",", "").cast("double") * F.coalesce(F.try_element_at(scale, F.lower(at(x, 3))), F.lit(1.0))
        sign = F.upper(at(x, 1))
        return F.struct(number.alias("amount"), (-i).alias("_first"), F.coalesce(F.try_element_at(currency, sign), sign).alias("currency"))

    best = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(0)), read))
    return F.when(best.isNotNull(), F.struct(best["amount"].alias("amount"), best["currency"].alias("currency")))


def kind(text: Column) -> Column:
    """The first cue, in the ladder's order, that is anywhere in the text."""
    return reduce(lambda rest, cue: F.when(F.coalesce(text, F.lit("")).rlike("(?i)" + cue[0]), cue[1]).otherwise(rest), reversed(KIND_CUES), F.lit("other"))


def respondent(label: Column, text: Column) -> Column:
    """``struct<name, type>``: firm, individual or unknown; the name is the label's, or else whom the text acts against."""
    own = F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), r"(?i)^(?:SEC|Securities and Exchange Commission)\s+v\.?\s+", "")
    own = F.regexp_replace(F.regexp_replace(own, r"(?i)\s*\(CRD\s*#?\s*\d+\)", ""), r"^[ –—:-]+|[ –—:-]+$", "")
    told = F.coalesce(text, F.lit(""))
    name = F.when(own != "", own).otherwise(F.trim(F.regexp_extract(told, AGAINST, 1)))
    person = F.concat_ws(" ", name, told).rlike(INDIVIDUAL) | name.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$")
    return F.struct(F.substring(name, 1, 200).alias("name"), F.when(name.rlike(FIRM), "firm").when(person, "individual").otherwise("unknown").alias("type"))
