"""CIGAR columns: text to array of (op, len) and back, and the lengths it spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REF_OPS = "MD=X"  # an input N is a gap of the transcript alignment and spans nothing
QUERY_OPS = "MIS=X"


def parse(text: str) -> Column:
    """array<struct<op,len>>; null for null, empty and '*', and for text that isn't a CIGAR."""
    return F.expr(
        f"CASE WHEN {text} RLIKE '^(?:[0-9]++[MIDNSHP=X])++$' THEN transform(regexp_extract_all({text}, '[0-9]+[MIDNSHP=X]', 0), "
        "x -> named_struct('op', right(x, 1), 'len', cast(left(x, length(x) - 1) AS int))) END"
    )


def render(ops: str) -> Column:
    """Text of array<struct<op,len>>; '*' if it is empty."""
    return F.expr(f"CASE WHEN size({ops}) = 0 THEN '*' ELSE array_join(transform({ops}, c -> concat(c.len, c.op)), '') END")


def span(ops: str, kinds: str = REF_OPS) -> Column:
    """Sum of the lengths of some kinds of operation."""
    return F.expr(f"aggregate({ops}, 0L, (a, c) -> a + CASE WHEN instr('{kinds}', c.op) > 0 THEN c.len ELSE 0 END)")
