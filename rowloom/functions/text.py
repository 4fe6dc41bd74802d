"""Text clean-up and tokens as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def clean_text(text: Column | str, max_words: int | None = None) -> Column:
    """Null becomes empty, runs of anything but ASCII letters and digits become one space; ``max_words`` cuts the rest."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit(" ")), "[^a-zA-Z0-9]+", " "))
    return spaced if max_words is None else F.array_join(F.slice(F.split(spaced, " "), 1, max_words), " ")


def tokens(text: Column | str) -> Column:
    """Lower-case tokens of two or more word characters, over the whole text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
