"""Array helpers that stay narrow and near linear: running sums by blocks instead of growing accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def with_running_sums(df: DataFrame, values: str, out: str) -> DataFrame:
    """Adds `out`: inclusive running sums (bigint) of the integer array `values`; null and empty arrays stay so.

    Every step names the array of the step before twice, so that the optimiser keeps it as a column of its own
    instead of writing it into the lambda that reads it once for each element."""
    block = f"CASE WHEN size({values}) > 0 THEN transform(sequence(0, (size({values}) - 1) div {BLOCK}), b -> aggregate(slice({values}, b * {BLOCK} + 1, {BLOCK}), 0L, (a, y) -> a + y)) END"
    base = f"CASE WHEN size(_{out}_b) > 0 THEN transform(sequence(0, size(_{out}_b) - 1), b -> aggregate(slice(_{out}_b, 1, b), 0L, (a, y) -> a + y)) END"
    sums = (
        f"CASE WHEN size(_{out}_p) > 0 THEN transform({values}, (y, i) -> element_at(_{out}_p, cast(i div {BLOCK} AS int) + 1) + "
        f"aggregate(slice({values}, cast(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, z) -> a + z)) "
        f"WHEN {values} IS NOT NULL THEN cast(array() AS array<bigint>) END"
    )
    df = df.withColumn(f"_{out}_b", F.expr(block)).withColumn(f"_{out}_p", F.expr(base))
    return df.withColumn(out, F.expr(sums)).drop(f"_{out}_b", f"_{out}_p")
