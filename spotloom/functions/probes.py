"""Probe names and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotloom.schemas import PRIMER_READ, PROBE_PATTERN


def is_probe_name(name: Column) -> Column:
    return name.rlike(PROBE_PATTERN)


def probe_part(name: Column, group: int) -> Column:
    """Gene (1), sequence (2) or primer (3) of a probe name; null if the name is malformed, '' for an empty gene."""
    return F.when(is_probe_name(name), F.regexp_extract(name, PROBE_PATTERN, group))


def read_of_primer(primer: Column) -> Column:
    """The read of a primer, null for an unknown one."""
    c = F.lit(None).cast("int")
    for name, read in PRIMER_READ.items():
        c = F.when(primer == name, read).otherwise(c)
    return c


def read_number(read: Column) -> Column:
    """A read given as a number or as text like ``x_5``; null if there is no number."""
    return F.element_at(F.split(read.cast("string"), "_"), -1).try_cast("int")


def read_of_id(txuid: Column) -> Column:
    """The read number at the end of a transcript id; null if there is none."""
    return F.element_at(F.split(txuid, "_"), -1).try_cast("int")


def probe_type(gene: Column) -> Column:
    """GCP for genomic controls, NCS and NCP for negative controls, else (null too) targeting."""
    return F.when(F.lower(gene) == "gdna", "GCP").when(gene.startswith("NCS-"), "NCS").when(gene.startswith("NCP-"), "NCP").otherwise("targeting")
