"""Sequence and identifier columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """ACGT in either case and N are complemented, other codes pass through."""
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def strip_version(name: Column) -> Column:
    """Up to the first dot."""
    return F.substring_index(name, ".", 1)


def gtf_attribute(attributes: Column, key: str) -> Column:
    """Value of a GTF attribute: the last of repeated keys; null if absent or empty."""
    found = F.regexp_extract_all(attributes, F.lit(rf'(?:^|;)\s*{key}\s+"?([^";]+)"?'), F.lit(1))
    return F.try_element_at(found, F.lit(-1))
