"""Name handling in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition, and what they fold to
SPECIAL_LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}
# Accented Latin letters and their base letter, position by position
ACCENTED = "àáâãäåāăąçćčĉċďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšșţťțùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssstttuuuuuuuuuuwyyyzzz"
assert len(ACCENTED) == len(PLAIN)


def fold(col: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    out = F.lower(col)
    for letter, plain in SPECIAL_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(F.translate(out, ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def normalize_name(col: Column) -> Column:
    """Folded text with one space between runs of letters and digits."""
    return F.trim(F.regexp_replace(fold(col), "[^a-z0-9]+", " "))


def slugify(col: Column) -> Column:
    """Folded text without apostrophes, with hyphens between runs of letters and digits."""
    return F.regexp_replace(normalize_name(F.regexp_replace(col, "['\u2019]", "")), " ", "-")


def short_grams(col: Column) -> Column:
    """All distinct substrings of one to three characters."""
    n = F.greatest(F.length(col), F.lit(1))
    at = F.sequence(F.lit(1), n)
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(col, i, F.lit(k)) for k in (1, 2, 3)]))))


def lead_gram(col: Column) -> Column:
    """The first three characters (fewer when the text is shorter)."""
    return F.substring(col, 1, 3)
