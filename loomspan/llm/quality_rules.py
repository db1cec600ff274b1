"""Quality rules with compression bands: zstandard ratios of the whole text and of fixed chunks reject repetitive or
incompressible text by limits for its length.

The limits are those of the table itself. In every octave of length the logarithm of the ratio has a median and quartiles, over
distinct sizes of the texts that pass the base rules, so a large group of copies counts once; the median is followed between
octaves, and a text further from it than REACH times the quartile's distance (SPREAD at least) on its side is out of its band.
Chunks of CHUNK bytes have a band of their own; the last chunk ends with the text, and a shorter text is its only chunk. A text
goes if it is out of its band, or more than BAD_CHUNKS of its chunks are out of theirs.

Edge cases: a null or empty text has no words and fails the base rules. Words are parted by the six ASCII white-space
characters only. Octaves with fewer than LEAST distinct sizes take the nearest octaves' limits, wider by OUTSIDE an octave beyond the last; a table without any the documented
BANDS. An empty table gives no rows. Repeated rows are judged each by itself, with one verdict, as are ties; further columns don't
matter. Texts of any length are read whole; their chunks are compressed one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import written

LEVEL = 3
CHUNK = 2048
WINDOW = 5
REACH = 8.0
SPREAD = 0.01
LEAST = 50
#: Beyond the octaves that have limits, the nearest ones widen by so much an octave, as ratios go on changing.
OUTSIDE = 0.15
BAD_CHUNKS = 0.2
#: (log2 of the length, median log ratio, distances to the lower and upper limits) where a table is too small for its own.
BANDS = ((5.0, 0.14, 0.5, 0.25), (8.0, -0.45, 0.7, 0.35), (11.0, -0.74, 0.7, 0.5), (14.0, -0.87, 0.9, 0.6), (17.0, -0.94, 1.2, 0.65))
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows that occur at least twice, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h ^= h >> np.uint64(31)
    keys = np.zeros(n, np.uint64)
    for k in range(size):
        keys = (keys ^ (h[k : k + n] * _MIX[k])) * _MIX[0]
        keys ^= keys >> np.uint64(29)
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    covered = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(twice[at] == keys)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def compression(raw: bytes) -> tuple[int, list[int]]:
    """Compressed bytes of the whole text, and of each chunk."""
    if not raw:
        return 0, []
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    whole = len(press.compress(raw))
    if len(raw) <= CHUNK:
        return whole, [whole]
    starts = [*range(0, len(raw) - CHUNK, CHUNK), len(raw) - CHUNK]
    return whole, [len(press.compress(raw[i : i + CHUNK])) for i in starts]


def measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bytes, compressed bytes and those of each chunk."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes part at exactly the six ASCII blanks
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(BLANKS):
                dup += line in seen
                seen.add(line)
    repeat = repeated_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return len(words), chars, symbols, dup, repeat, failed, len(raw), *compression(raw)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bytes", "pressed", "chunks"]
_KINDS = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2 + [pa.list_(pa.int32())]
_MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, pressed long, chunks array<int>"


def measured(docs: DataFrame) -> DataFrame:
    """The measures of every document; one narrow pass without a shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols = zip(*[measures(t) for t in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], names=["doc_id", *_NAMES])

    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_MEASURED}")


class Limits:
    """Knots of the bands by log2 of the length: median log ratio and the distances down and up that are allowed."""

    def __init__(self, knots=BANDS, chunk: tuple[float, float, float] | None = None):
        self.x, self.mid, self.down, self.up = (np.array([k[i] for k in knots]) for i in range(4))
        self.chunk = chunk

    def within(self, size: np.ndarray, pressed: np.ndarray) -> np.ndarray:
        """Whether texts of so many bytes, compressed to so many, are in their band."""
        x, y = np.log2(np.maximum(1, size)), np.log(np.maximum(1, pressed) / np.maximum(1, size))
        off = y - np.interp(x, self.x, self.mid)
        beyond = OUTSIDE * np.abs(x - np.clip(x, self.x[0], self.x[-1]))
        return (off >= -np.interp(x, self.x, self.down) - beyond) & (off <= np.interp(x, self.x, self.up) + beyond)

    def chunk_within(self, pressed: np.ndarray) -> np.ndarray:
        """Whether full chunks are in their band."""
        if self.chunk is None:
            return self.within(np.full(len(pressed), CHUNK), pressed)
        mid, down, up = self.chunk
        off = np.log(np.maximum(1, pressed) / CHUNK) - mid
        return (off >= -down) & (off <= up)

    def passed(self, size: int, pressed: int, chunks: np.ndarray) -> bool:
        if not self.within(np.array([size]), np.array([pressed]))[0]:
            return False
        return size <= CHUNK or (~self.chunk_within(chunks)).mean() <= BAD_CHUNKS


def fit_limits(table: DataFrame, accuracy: int = 10_000) -> Limits:
    """Limits from the measures of a whole table: two aggregations with partial results, a row an octave comes back."""
    base = table.where("NOT base_failed AND n_bytes > 0")
    rows = base.select("n_bytes", "pressed").distinct().selectExpr("floor(log2(n_bytes)) AS octave", "log2(n_bytes) AS x", "ln(pressed / n_bytes) AS y")
    middle = rows.groupBy("octave").agg(F.percentile_approx("x", 0.5, accuracy).alias("x"), F.percentile_approx("y", 0.5, accuracy).alias("y"), F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy("octave").collect()
    full = base.where(f"n_bytes > {CHUNK}").select("doc_id", "n_bytes", "pressed", F.posexplode("chunks").alias("place", "size")).select("n_bytes", "pressed", "place", "size").distinct()
    y = F.log(F.col("size") / F.lit(CHUNK))
    chunk = full.agg(F.percentile_approx(y, [0.25, 0.5, 0.75], accuracy).alias("q"), F.count("*").alias("n")).first()
    of_chunk = None
    if chunk["n"] >= LEAST:
        low, mid, high = chunk["q"]
        of_chunk = mid, REACH * max(SPREAD, mid - low), REACH * max(SPREAD, high - mid)
    if not middle:
        return Limits(chunk=of_chunk)
    xs, ys = [r["x"] for r in middle], [r["y"] for r in middle]
    follow = F.lit(ys[-1])  # the median between octaves, as SQL
    for x0, x1, y0, y1 in reversed(list(zip(xs, xs[1:], ys, ys[1:], strict=False))):
        follow = F.when(F.col("x") <= x1, F.lit(y0) + (F.col("x") - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(follow)
    off = F.col("y") - F.when(F.col("x") <= xs[0], ys[0]).otherwise(follow)
    quartiles = rows.groupBy("octave").agg(F.percentile_approx(off, [0.25, 0.75], accuracy).alias("q")).collect()
    q = {r["octave"]: r["q"] for r in quartiles}
    return Limits([(r["x"], r["y"], REACH * max(SPREAD, -q[r["octave"]][0]), REACH * max(SPREAD, q[r["octave"]][1])) for r in middle], of_chunk)


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Measures and verdict of every document. The measures, not the texts, are written once; limits are theirs unless given."""
    table = written(measured(docs), "measures")
    bands = fit_limits(table) if limits is None else limits

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, pressed = b.column(7).to_numpy(), b.column(8).to_numpy()
            chunks, ends = b.column(9).values.to_numpy(), b.column(9).offsets.to_numpy()
            bad = np.concatenate([[0], np.cumsum(~bands.chunk_within(chunks))]) if len(chunks) else np.zeros(1, np.int64)
            n = np.diff(ends)
            share = np.where(size > CHUNK, (bad[ends[1:]] - bad[ends[:-1]]) / np.maximum(1, n), 0.0)
            ok = bands.within(size, pressed) & (share <= BAD_CHUNKS)
            failed = b.column(6).to_numpy(zero_copy_only=False)
            ratio = pressed / np.maximum(1, size)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(~failed & ok), pa.array(ratio), pa.array(share)], names=["doc_id", *_NAMES[:6], "kept", "zstd_ratio", "bad_chunk_share"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(judged, f"doc_id {kind}, {_MEASURED.rpartition(', n_bytes')[0]}, kept boolean, zstd_ratio double, bad_chunk_share double")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document, judged."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
