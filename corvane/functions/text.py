"""Tokens of text columns, as array expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, byte for byte the same in Java's and RE2's patterns.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
ALPHABETIC = "^[A-Za-z]+$"


def tokens(text: Column) -> Column:
    """The non-empty pieces between white space, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def bigrams(t: Column) -> Column:
    """Adjacent pairs of an array of tokens, as structs (0, 1); empty for fewer than two tokens. The array should be a
    column of its own, for it is read three times."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.arrays_zip(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of the lower-case words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(text).contains(w)
    return hit & (text != "")
