"""Clean column names; works on the schema only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame

# Item numbers such as "1. " or "a) " and bracketed examples in headers.
ITEM_NUMBER = r"^[1-9|a-z]\d*[\.|\)] "
EXAMPLES = r" \(e.g.,.*\)"

# Latin letters that have no decomposition into a plain letter and a mark.
PLAIN_LETTERS = {
    "Æ": "AE", "æ": "ae", "Ð": "D", "ð": "d", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "ĸ": "k", "Ł": "L", "ł": "l", "Ŋ": "NG", "ŋ": "ng",
    "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Þ": "TH", "þ": "th", "Ŧ": "T", "ŧ": "t",
}


def _plain(letter: str, after: str) -> str:
    """Plain letters for one; a pair for a capital is written as a capitalized word unless more capitals follow."""
    plain = PLAIN_LETTERS.get(letter, letter)
    return plain if after.isupper() else plain.capitalize() if len(plain) > 1 and letter.isupper() else plain


def snake_case(name: str) -> str:
    """Lower-case words joined by underscores, Latin letters without accents; a leading digit gets an x in front.

    Letters of other scripts are kept apart by their code points: each becomes u and four or more hexadecimal digits.
    """
    name = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    name = unicodedata.normalize("NFKD", "".join(_plain(c, after) for c, after in zip(name, [*name[1:], ""])))
    name = "".join(c for c in name if not unicodedata.combining(c))
    name = "".join(c if c.isascii() or not c.isalnum() else f"u{ord(c):04x}" for c in name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
    if not name or name[0].isdigit():
        name = f"x{name}"
    return name


def cleaned_names(names: Sequence[str]) -> list[str]:
    """Cleaned names; the second and later copies of a name get the suffix _2, _3, ..., or the next one that is free."""
    result: dict[str, None] = {}
    for name in names:
        base = clean = snake_case(re.sub(EXAMPLES, "", re.sub(ITEM_NUMBER, "", name)))
        number = 1
        while clean in result:
            number += 1
            clean = f"{base}_{number}"
        result[clean] = None
    return list(result)


def drop_columns(df: DataFrame, names: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Drop exact names (absent ones are ignored) and names that match any pattern."""
    kept = [(i, c) for i, c in enumerate(df.columns) if c not in names and not any(re.search(p, c) for p in patterns)]
    # By position, because raw headers may differ in case only or hold a backtick.
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[f"c{i}" for i, _ in kept]).toDF(*[c for _, c in kept])


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*cleaned_names(df.columns))
