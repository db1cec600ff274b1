"""Personal data: regular expressions propose spans, checksums (Luhn, mod-97) and value limits confirm them, and context words
around a span adjust the score of the kinds that a pattern alone can't tell: for it, words up to CONTEXT code points before or
after, past other matches; against it, words since the match before. DataFrame functions only.

Regular expressions with places: split() gives the text between the matches, regexp_extract_all() the matches, and running sums
of their lengths the places; the sums go by blocks, so a text with millions of matches stays near linear. Patterns are the
documented ones in forms that never step back: possessive repeats, and runs entered only at their start.
Edge cases: a null text is empty and has no spans. Repeated rows are searched each by itself: nothing is shuffled. Further
columns don't matter. Whole texts of any length are searched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
CONTEXT = 48
#: So many matches of a kind with context words, 11 code points each at least, fill the context.
NEAR = 5
LEAST = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # cheap SQL test of text; without it there is no match
    valid: str  # SQL over x, the match
    score: float = 1.0
    context: str = ""  # words before or after the span that add 0.4
    against: str = ""  # words between the match before and the span that take 0.4
    base: bool = False


_LOCAL = "[A-Za-z0-9._%+-]"
_DIGITS = "has_digit"
_MOD97 = (
    "aggregate(split(concat(substr(replace(x, ' ', ''), 5), substr(replace(x, ' ', ''), 1, 4)), ''), 0, "
    "(a, c) -> (CASE WHEN c = '' THEN a WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END)) = 1"
)
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", "true", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _DIGITS, r"forall(split(x, '\\.'), p -> coalesce(try_cast(p AS int), 256) <= 255)", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _DIGITS, "length(translate(x, ' -', '')) BETWEEN 13 AND 19 AND luhn_check(translate(x, ' -', ''))", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} AND instr(text, '+') > 0", "length(translate(x, '+ ().-', '')) BETWEEN 9 AND 15", base=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", _DIGITS, f"length(replace(x, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}", 0.9),
    Kind("local_phone", r"(?<![0-9+.-])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}[)\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", _DIGITS, "true", 0.3, "phone|tel|call|mobile|cell|fax", "order|invoice|isbn|version"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _DIGITS, "substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 1) <> '9' AND substr(x, 5, 2) <> '00' AND substr(x, 8, 4) <> '0000'", 0.5, "ssn|social|security|tax", "order|invoice|isbn|part"),
    Kind("secret", r"(?i)(?<![A-Za-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.=-]{8,}", "(instr(text, '=') > 0 OR instr(text, ':') > 0)", "true", 0.5, "auth|login|bearer|access", "example|placeholder"),
)
BASE = tuple(k for k in KINDS if k.base)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _confirmed(kind: Kind) -> str:
    """SQL over x (the match), before (the text since the match before) and around (the text on both sides)."""
    score = str(kind.score)
    for words, sign, place in ((kind.context, "+", "around"), (kind.against, "-", "before")):
        if words:
            score += f" {sign} (CASE WHEN lower({place}) RLIKE {_quoted(rf'(?:^|[^a-z])(?:{words})')} THEN 0.4 ELSE 0 END)"
    return kind.valid if score == "1.0" else f"({kind.valid}) AND ({score}) >= {LEAST}"


def _around(g: str, m: str) -> str:
    """SQL: the text on both sides of match i, from the pieces g and the matches m. Linear, as substr() in a long text isn't."""
    back = [f"coalesce(right(get({g}, i - {k}), {CONTEXT}), ''), coalesce(right(get({m}, i - {k}), {CONTEXT}), '')" for k in range(NEAR, 0, -1)]
    on = [f"coalesce(left(get({m}, i + {k}), {CONTEXT}), ''), coalesce(left(get({g}, i + {k + 1}), {CONTEXT}), '')" for k in range(1, NEAR + 1)]
    before = f"right(concat({', '.join(back)}, right(get({g}, i), {CONTEXT})), {CONTEXT})"
    return f"concat({before}, '|', left(concat(left(get({g}, i + 1), {CONTEXT}), {', '.join(on)}), {CONTEXT}))"


def _opened(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("has_digit", F.col("text").rlike("[0-9]"))


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and, for each kind, an array s_<kind> of (x, start, end), in code points; one narrow pass."""
    df = _opened(docs.select("doc_id", "text"))
    names = [k.name for k in kinds]
    cols = [e for k in kinds for e in (f"CASE WHEN {k.gate} THEN split(text, {_quoted(k.pattern)}, -1) END AS g_{k.name}", f"CASE WHEN {k.gate} THEN regexp_extract_all(text, {_quoted(k.pattern)}, 0) END AS m_{k.name}")]
    df = df.selectExpr("doc_id", *cols)
    kept = ["doc_id", *(f"{c}_{n}" for n in names for c in "gm")]
    # Each step names what it made twice, so that the optimiser doesn't write it into the lambdas of the next.
    df = df.selectExpr(*kept, *(f"CASE WHEN size(m_{n}) > 0 THEN transform(m_{n}, (x, i) -> length(g_{n}[i]) + length(x)) END AS l_{n}" for n in names))
    kept += [f"l_{n}" for n in names]
    df = df.selectExpr(*kept, *(f"CASE WHEN l_{n} IS NOT NULL THEN transform(sequence(0, (size(l_{n}) - 1) div {BLOCK}), b -> aggregate(slice(l_{n}, b * {BLOCK} + 1, {BLOCK}), 0, (a, y) -> a + y)) END AS b_{n}" for n in names))
    df = df.selectExpr(*kept, *(f"CASE WHEN b_{n} IS NOT NULL THEN transform(sequence(0, size(b_{n}) - 1), b -> aggregate(slice(b_{n}, 1, b), 0, (a, y) -> a + y)) END AS p_{n}" for n in names))
    df = df.selectExpr(*kept[: -len(names)], *(f"CASE WHEN p_{n} IS NOT NULL THEN transform(l_{n}, (y, i) -> element_at(p_{n}, cast(i div {BLOCK} AS int) + 1) + aggregate(slice(l_{n}, cast(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (a, z) -> a + z)) END AS e_{n}" for n in names))
    out = []
    for k in kinds:
        around = _around(f"g_{k.name}", f"m_{k.name}") if k.context else "''"
        made = f"transform(m_{k.name}, (x, i) -> named_struct('x', x, 'start', e_{k.name}[i] - length(x), 'end', e_{k.name}[i], 'before', right(g_{k.name}[i], {CONTEXT}), 'around', {around}))"
        test = _confirmed(k).replace("before", "s.before").replace("around", "s.around")
        test = f"exists(array(s.x), x -> {test})"
        out.append(f"CASE WHEN e_{k.name} IS NOT NULL THEN filter({made}, s -> {test}) END AS s_{k.name}")
    return df.selectExpr("doc_id", *out)


def _listed(name: str) -> str:
    return f"coalesce(transform(s_{name}, s -> concat('{name}:', s.start, ':', s.end)), array())"


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every confirmed span replaced by its kind in brackets, and n_chars brought up to date if there. A null text
    stays null. Kinds go one after the other; one narrow pass."""
    names = docs.columns
    df = docs.withColumn("_null", F.col("text").isNull())
    df = _opened(df)
    for k in kinds:
        held = [f"`{c}`" for c in names if c != "text"]
        df = df.selectExpr("*", f"CASE WHEN {k.gate} THEN split(text, {_quoted(k.pattern)}, -1) END AS _g", f"CASE WHEN {k.gate} THEN regexp_extract_all(text, {_quoted(k.pattern)}, 0) END AS _m")
        test = _confirmed(k).replace("before", "z.before").replace("around", "z.around")
        around = _around("_g", "_m") if k.context else "''"
        placed = f"transform(_m, (x, i) -> named_struct('x', x, 'piece', _g[i], 'before', right(_g[i], {CONTEXT}), 'around', {around}))"
        joined = f"concat(array_join(transform({placed}, z -> concat(z.piece, CASE WHEN exists(array(z.x), x -> {test}) THEN '[{k.name.upper()}]' ELSE z.x END)), ''), element_at(_g, -1))"
        df = df.selectExpr(*held, f"CASE WHEN size(_m) > 0 THEN {joined} ELSE text END AS text", "_null", "has_digit")
    df = df.withColumn("text", F.when(~F.col("_null"), F.col("text")))
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return df.select(*names)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    df = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = f"concat({', '.join(_listed(k.name) for k in BASE)})"
    every = f"concat({', '.join(_listed(k.name) for k in KINDS)})"
    counted = [f"cast(coalesce(size(s_{k.name}), 0) AS bigint) AS n_{k.name}" for k in BASE]
    return df.selectExpr("doc_id", *counted, f"sha2(array_join({base}, ','), 256) AS base_sha256", f"array_join({every}, ',') AS spans")
