"""Key clean-up shared by reference checks and joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as surrounding white space of a key.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def clean_key(c: Column) -> Column:
    """Without surrounding white space, in lower case; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def token(text: Column, number: int, by: str = "-") -> Column:
    """The ``number``-th part, from 1, of a text split at ``by``; null if it has fewer parts."""
    return F.try_element_at(F.split(text, by), F.lit(number))
