"""Text functions as column expressions; one Arrow UDF for what Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode blocks that tell scripts apart, as ranges of a character class (fixed values).
SCRIPTS = {
    "latin": r"A-Za-z\x{00C0}-\x{024F}",
    "greek": r"\x{0370}-\x{03FF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "hebrew": r"\x{0590}-\x{05FF}",
    "arabic": r"\x{0600}-\x{06FF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "kana": r"\x{3040}-\x{30FF}",
    "han": r"\x{4E00}-\x{9FFF}",
    "hangul": r"\x{AC00}-\x{D7AF}",
}


#: As the length of a substring: up to the end of the text.
REST = (1 << 31) - 1


def compact(text: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def surface(text: Column) -> Column:
    """Comparable form of a title: no parentheses, no apostrophes, one space between words."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"\([^)]*\)", " ")), "['’]", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    """Letters that occur three or more times in a row, twice."""
    return F.regexp_replace(text, r"([a-z])\1{2,}", "$1$1")


def split_camel(text: Column) -> Column:
    """A space where a small letter or digit meets a capital, and before the last capital of a run."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def deleet(token: Column) -> Column:
    """A word written with digits for letters, or null if the token isn't one."""
    plain = F.translate(token, "013457@$", "oieastas")
    mixed = token.rlike("[a-z]") & token.rlike("[0-9@$]")
    numbered = token.rlike("^[a-z]+[0-9]{1,4}$") | token.rlike("^[0-9]{1,4}[a-z]+$")
    return F.when(mixed & ~numbered & plain.rlike("^[a-z]+$"), plain)


def has_script(text: Column, script: str) -> Column:
    return text.rlike(f"[{SCRIPTS[script]}]")


def homoglyph_word(word: Column) -> Column:
    """Whether a word mixes Latin with Cyrillic or Greek letters."""
    return word.rlike(f"[{SCRIPTS['latin']}]") & word.rlike(f"[{SCRIPTS['cyrillic']}{SCRIPTS['greek']}]")


def ticker_case(text: Column) -> Column:
    """Ticker form of ASCII text: no leading marks, no spaces, upper case, 20 characters at most."""
    return F.left(F.upper(F.regexp_replace(F.regexp_replace(text, "^[$#]+", ""), r"\s+", "")), F.lit(20))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(~teen & (n % 10 == 1), "st").when(~teen & (n % 10 == 2), "nd").when(~teen & (n % 10 == 3), "rd").otherwise("th"))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC and without accents: Spark has no normalisation of its own."""

    def one(x):
        if x is None or x.isascii():
            return x
        split = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", x))
        return "".join(c for c in split if not unicodedata.combining(c))

    return text.map(one)


def words(text: Column) -> Column:
    """Lower-cased ASCII words of two letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), 0)
