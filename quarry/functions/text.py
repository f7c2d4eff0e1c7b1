"""Tokenizers and character-class tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRACKETS_AND_STOPS = r"[(\[,.!?:;\]) ]+"
PUNCTUATION_AND_DIGITS = r"[\n\r !\"#$%&'()*+,\-./:;=?@\[\]^_`{|}~\\0-9]+"


def tokens(text: Column, pattern: str = BRACKETS_AND_STOPS) -> Column:
    """Lower-case tokens without empty ones."""
    return F.filter(F.split(F.lower(text), pattern), lambda t: t != "")


def plain_tag(tag: Column) -> Column:
    """Whether a tag holds letters, digits and spaces of the ASCII range only."""
    return tag.rlike("^[A-Za-z0-9 ]*$")


def list_or_none(values: Column) -> Column:
    """Trimmed parts of a comma list; a null list is the one category 'None'."""
    return F.transform(F.split(F.coalesce(values, F.lit("None")), ","), lambda c: F.trim(c))
