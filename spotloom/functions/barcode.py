"""Sequences as bit sets, and their Hamming distance, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that one BIGINT holds, four bits each; two BIGINTs hold the longest code.
BASES = 15


def packed(sequence: Column) -> list[Column]:
    """Two BIGINTs with one bit of four set per base; a letter other than A, C, G, T sets none and so matches nothing."""
    digits = F.translate(F.regexp_replace(sequence, "[^ACGT]", "0"), "CTGA", "8421")
    part = lambda at: F.conv(F.concat(F.lit("0"), F.substring(digits, at, BASES)), 16, 10).cast("bigint")
    return [part(1), part(BASES + 1)]


def hamming(length: Column, a: list[Column], b: list[Column]) -> Column:
    """Places in which two packed sequences of ``length`` bases differ."""
    same = F.lit(0)
    for x, y in zip(a, b, strict=True):
        same = same + F.bit_count(x.bitwiseAND(y))
    return length - same
