"""Names made from text, and numbers formatted for tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question text that names a column of its own.
TEXT_NAME_OVERRIDES = (
    ("[Dd]iarrhea", "diarrhea"),
    ("[Nn]umbness", "neuropathy"),
)

# Abbreviations in item names and what they stand for; the order matters.
ITEM_NAME_RULES = (
    ("app", "decreased_appetite"),
    ("naus", "nausea"),
    ("vomit", "vomiting"),
    ("const", "constipation"),
    ("diar", "diarrhea"),
    ("painabd", "pain_in_the_abdomen"),
    ("sob", "shortness_of_breath"),
    ("neurop", "neuropathy"),
    ("diz", "dizziness"),
    ("ins", "insomnia"),
    ("fatig", "fatigue"),
    ("anx", "anxiety"),
    ("sad", "sad_or_unhappy_feelings"),
    ("conc", "problems_with_concentration"),
    ("mem", "problems_with_memory"),
    ("d_", ""),
)

# Wording of variable labels; the order matters.
VARIABLE_LABEL_RULES = (
    ("_", " "),
    (" collapsed", ""),
    (" years", " (years, centered at mean)"),
    ("promis", "PROMIS"),
    ("preference", ", "),
    ("PROMIS , ", "PROMIS,"),
    ("propr$", "PROPr"),
    ("cognition$", "Cognition"),
    ("depression$", "Depression"),
    ("^Forhp r", "R"),
    ("zipcode", "zip code"),
    (" four", " 4"),
    ("Weekend day", "Weekend"),
    ("Days since last known chemotherapy treatment", "Time since last chemotherapy (days)"),
)


def sentence_case(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2_000_000_000)))


def name_from_text(text: Column, overrides: Sequence[tuple[str, str]] = TEXT_NAME_OVERRIDES) -> Column:
    """Column name from question text: keyword override, else lower case up to the first comma or bracket."""
    named = text
    for pattern, name in reversed(overrides):
        named = F.when(text.rlike(pattern), name).otherwise(named)
    short = F.lower(named)
    for pattern, new in ((",.*", ""), (" \\(.*", ""), (" ", "_")):
        short = F.regexp_replace(short, pattern, new)
    return short


def replace_first_chain(text: Column, rules: Sequence[tuple[str, str]] = ITEM_NAME_RULES) -> Column:
    """Apply the rules one after the other, each to its first occurrence only."""
    result = text
    for old, new in rules:
        # The lazy prefix anchors at the start, so only the first occurrence can match.
        result = F.regexp_replace(result, f"^(.*?){re.escape(old)}", f"$1{new}")
    return result


def replace_chain(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    result = text
    for pattern, new in rules:
        result = F.regexp_replace(result, pattern, new)
    return result


def predictor_label(name: Column) -> Column:
    """Predictor name for a table row."""
    return sentence_case(replace_chain(name, (("_", " "), (" symptom day$", ""))))


def variable_label(name: Column, rules: Sequence[tuple[str, str]] = VARIABLE_LABEL_RULES) -> Column:
    return replace_chain(sentence_case(name), rules)


def rating_label(name: Column, suffix: str = "_highest_rating") -> Column:
    return sentence_case(F.regexp_replace(F.regexp_replace(name, suffix, ""), "_", " "))


def predictor_from_term(term: Column) -> Column:
    """Predictor part of a term made of a lower-case name and a level (for result files read back)."""
    cut = F.when(term == "(Intercept)", term).otherwise(F.regexp_replace(term, "[A-Z].*", ""))
    return F.regexp_replace(cut, "[0-9]\\+$|[0-9]$", "")


def _no_leading_zero(text: Column) -> Column:
    return F.regexp_replace(text, "^0", "")


def format_p(p: Column) -> Column:
    """P value as text: two digits, three where two would hide the size, bounds at both ends.

    A value of exactly .001 is written ".001".
    """
    two, three = F.format_string("%.2f", p), F.format_string("%.3f", p)
    near_limit = (p < 0.05) & (F.round(p, 2) == 0.05)
    return (
        F.when(p.isNull(), None)
        .when(p < 0.001, "<.001")
        .when(p < 0.01, _no_leading_zero(F.regexp_replace(three, "0$", "")))
        .when(near_limit, _no_leading_zero(F.regexp_replace(three, "0$", "")))
        .when(F.round(p, 2) == 1.0, ">.99")
        .otherwise(_no_leading_zero(two))
    )


def format_or(value: Column) -> Column:
    """Odds ratio with two decimals."""
    return F.when(value.isNotNull(), F.format_string("%.2f", value))


def interval_text(estimate: Column, low: Column, high: Column, separator: str = ", ") -> Column:
    return F.concat(format_or(estimate), F.lit(" ("), format_or(low), F.lit(separator), format_or(high), F.lit(")"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def n_percent(n: Column, percent: Column) -> Column:
    """Count with thousands commas and its percentage, trailing zeros dropped."""
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", percent), "0+$", ""), "\\.$", "")
    return F.concat(thousands(n), F.lit(" ("), shown, F.lit("%)"))
