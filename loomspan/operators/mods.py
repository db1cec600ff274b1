"""Base modification calls: the tags MM (which bases) and ML (how likely, 0-255) become a map from code to likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.lift import made_once

# Names in use for modification codes of the SAM tag specification.
NAMES = {"m5C": "m", "hm5C": "h", "m6A": "a", "pseU": "17802", "inosine": "17596"}


def likelihoods(tag: str) -> Column:
    """The numbers of a B tag in text form, with or without its type letters."""
    return F.expr(f"transform(filter(split(regexp_replace({tag}, '^(B:)?[cCsSiI],', ''), ','), x -> x <> ''), x -> cast(x AS int))")


def with_mods(reads: DataFrame, mm: str = "mm", ml: str = "ml", out: str = "mods") -> DataFrame:
    """Adds out: code to array of likelihoods. An entry such as C+mh,5,2 has one likelihood for each code and place, codes
    changing fastest; entries follow each other in ml. Equal codes of several entries (both strands) are joined. Without mm
    or ml the map is null; likelihoods that ml lacks are left out."""
    reads = made_once(reads, [], reads.columns)  # what makes mm and ml is not repeated in every use of them
    df = reads.withColumn("_en", F.expr(f"CASE WHEN {ml} IS NOT NULL THEN transform(filter(split({mm}, ';'), e -> e <> ''), e -> split(e, ',')) END"))
    codes = r"transform(_en, e -> regexp_extract(e[0], '^[A-Za-z][+-]([a-z]+|[0-9]+)', 1))"
    df = df.withColumn("_cd", F.expr(f"transform({codes}, c -> CASE WHEN c RLIKE '^[a-z]' THEN split(c, '') WHEN c = '' THEN array('') ELSE array(c) END)"))
    df = df.withColumn("_nn", F.expr("transform(_en, (e, i) -> (size(e) - 1) * size(_cd[i]))"))
    own = f"filter(slice({ml}, aggregate(slice(_nn, 1, i), 0, (a, n) -> a + n) + 1, _nn[i]), (y, k) -> k % size(_cd[i]) = j)"
    df = df.withColumn("_al", F.expr(f"flatten(transform(_cd, (cs, i) -> transform(cs, (c, j) -> named_struct('c', c, 'l', {own}))))"))
    made = "map_from_entries(transform(array_distinct(transform(_al, x -> x.c)), c -> named_struct('key', c, 'value', flatten(transform(filter(_al, x -> x.c = c), x -> x.l)))))"
    df = df.withColumn(out, F.expr(f"CASE WHEN _al IS NOT NULL THEN {made} END"))
    return made_once(df, [c for c in reads.columns if c != out], [out])
