"""FLAG bits of alignment records: names, predicates and presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the SAM specification: bit, name.
BITS = (
    (1, "PAIRED"),
    (2, "PROPER_PAIR"),
    (4, "UNMAP"),
    (8, "MUNMAP"),
    (16, "REVERSE"),
    (32, "MREVERSE"),
    (64, "READ1"),
    (128, "READ2"),
    (256, "SECONDARY"),
    (512, "QCFAIL"),
    (1024, "DUP"),
    (2048, "SUPPLEMENTARY"),
)

#: Presets of the filter operator, as SQL over flag, mapq and nh.
PRESETS = {
    "primary": "(flag & 2304) = 0",
    "primary-unique": "(flag & 2304) = 0 AND (flag & 4) = 0 AND coalesce(nh, 1) = 1",
    "mapped": "(flag & 4) = 0",
    "unmapped": "(flag & 4) <> 0",
    "secondary": "(flag & 256) <> 0",
    "supplementary": "(flag & 2048) <> 0",
    "dup": "(flag & 1024) <> 0",
    "qcfail": "(flag & 512) <> 0",
    "proper-pair": "(flag & 3) = 3",
}


def has(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def lacks(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == 0


def decode(flag: Column) -> Column:
    """Comma-joined names in bit order; the empty string for 0."""
    return F.concat_ws(",", *[F.when(has(flag, b), F.lit(n)) for b, n in BITS])


def encode(names: Column) -> Column:
    """Sum of the bits of comma-joined names; null if a name is unknown."""
    table = F.create_map(*[F.lit(x) for b, n in BITS for x in (n, b)])
    parts = F.filter(F.split(names, ","), lambda x: F.trim(x) != "")
    return F.aggregate(parts, F.lit(0), lambda a, x: a.bitwiseOR(F.try_element_at(table, F.upper(F.trim(x)))))


def explain_preset(name: str) -> str:
    """The predicate that a preset stands for."""
    return PRESETS[name]
