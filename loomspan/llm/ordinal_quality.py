"""Quality classifier: ordinal cumulative-link regression. One vector of hashed-text weights scores a document; ordered
thresholds turn the score into P(grade >= k), the expected grade and the decision to keep.

Grades from labels: 0 toxic, 1 of low quality, 2 good. Fitted on at most SAMPLE labelled documents, drawn by a hash of the id
over all labels. Edge cases: a null text is empty and scores as the bare thresholds; without labels every document gets
the prior of equal thirds. Repeated rows are scored each by itself; a document labelled twice counts twice; further columns
don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
SAMPLE = 6000
LEAST = 4
ROUNDS = 200
STRIP = " .,;:!?\"'()[]"
TAIL = 3
HEADS = (6,)
SHAPES = 4.0


def _bucket(raw: bytes) -> int:
    return zlib.crc32(raw) & ((1 << BITS) - 1)


_UPPER, _DIGIT, _SAME, _DISTINCT = (_bucket(b"\0" + x) for x in (b"upper", b"digit", b"same", b"distinct"))
_NONE = -1
_KNOWN: dict[str, tuple[tuple[int, ...], int]] = {}
_MOST = 300_000


def _word(w: str) -> tuple[tuple[int, ...], int]:
    """Buckets of the word and its beginnings, without case and marks around it, and that of its shape, -1 for none; kept for the next time."""
    if len(_KNOWN) >= _MOST:
        _KNOWN.clear()
    core = w.lower().strip(STRIP)
    tail = w[-TAIL:]
    if not tail[-1].isalnum():
        shape = _bucket(b"\0t:" + "".join("a" if c.isalnum() else c for c in tail).encode())
    elif w.isupper() and len(w) > 1:
        shape = _UPPER
    else:
        shape = _DIGIT if any(map(str.isdigit, w)) else _NONE
    cores = [_bucket(core.encode())] if core else []
    cores += [_bucket(b"\1" + core[:n].encode()) for n in HEADS if len(core) >= n]
    _KNOWN[w] = found = (tuple(cores), shape)
    return found


def features(text: str) -> dict[int, float]:
    """Bucket to value: 1 for each distinct word and beginning of a word; for shapes (how words end, case, repetition) their share of the words."""
    words = text.split()
    if not words:
        return {}
    tally = Counter(words)
    cores: set[int] = set()
    shapes: Counter = Counter()
    known = _KNOWN.get
    for w, n in tally.items():
        found, shape = known(w) or _word(w)
        cores.update(found)
        if shape >= 0:
            shapes[shape] += n
    out = dict.fromkeys(sorted(cores), 1.0)
    shapes[_SAME] = sum(map(str.__eq__, words[1:], words))
    shapes[_DISTINCT] = len(tally)
    for k, n in shapes.items():
        if n:
            out[k] = out.get(k, 0.0) + SHAPES * n / len(words)
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Ordinal:
    """P(grade >= k) = sigmoid(score - cut[k-1]), cuts ascending."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, x: dict[int, float]) -> np.ndarray:
        at = np.fromiter(x, np.int64, len(x))
        z = float(self.weights[at] @ np.fromiter(x.values(), float, len(x))) if len(x) else 0.0
        return _sigmoid(z - self.cuts)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], top: int = 2, rounds: int = ROUNDS, rate: float = 0.1, decay: float = 2e-4) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood, over (buckets, values) of each document; a bucket needs LEAST documents."""
    if not rows:
        return Ordinal(np.zeros(1 << BITS), np.log(np.arange(1, top + 1) / np.arange(top, 0, -1)))
    enough = sum(np.bincount(k, minlength=1 << BITS) for k, _ in rows) >= LEAST
    names = np.flatnonzero(enough)
    if not len(names):
        enough[0], names = True, np.zeros(1, np.int64)
    place = np.cumsum(enough, dtype=np.int32) - 1
    kept = [enough[k] for k, _ in rows]
    at = np.concatenate([place[k[x]] for (k, _), x in zip(rows, kept, strict=True)])
    v = np.concatenate([u[x] for (_, u), x in zip(rows, kept, strict=True)]).astype(np.float32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [int(x.sum()) for x in kept])
    y = np.array(grades)
    weight = (1 / np.maximum(1, np.bincount(y, minlength=top + 1)))[y]
    weight /= weight.sum()
    m = len(names)
    w = np.concatenate([np.zeros(m), [-0.7], np.full(top - 1, np.log(1.4))])  # weights, first cut, logs of the steps
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        cuts = w[m] + np.concatenate([[0.0], np.cumsum(np.exp(w[m + 1 :]))])
        z = np.bincount(row, w[at] * v, len(rows))
        tail = np.column_stack([np.ones(len(y)), _sigmoid(z[:, None] - cuts), np.zeros(len(y))])
        slope = tail * (1 - tail)
        i = np.arange(len(y))
        p = np.maximum(tail[i, y] - tail[i, y + 1], 1e-9)
        up, down = weight * slope[i, y] / p, weight * slope[i, y + 1] / p
        by_cut = np.zeros((len(y), top + 2))
        by_cut[i, y] += up
        by_cut[i, y + 1] -= down
        by_cut = by_cut[:, 1:-1].sum(0)  # of the negative log likelihood, by each cut
        grad = np.concatenate([np.bincount(at, -(up - down)[row] * v, m) + decay * w[:m], [by_cut.sum()], [by_cut[k:].sum() * np.exp(w[m + k]) for k in range(1, top)]])
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
    weights = np.zeros(1 << BITS)
    weights[names] = w[:m]
    return Ordinal(weights, w[m] + np.concatenate([[0.0], np.cumsum(np.exp(w[m + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The bounded sample is drawn from the labels, sent to the scan of the documents, and only hashed features come back."""
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(
        "doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.when(F.col("quality") == 1, 2).otherwise(1)).alias("grade")
    )
    drawn = graded.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "grade").limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.fromiter(x, np.int32, len(x)).tobytes() for x in found], pa.binary()), pa.array([np.fromiter(x.values(), np.float32, len(x)).tobytes() for x in found], pa.binary())], names=["grade", "at", "v"])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("grade", "text").mapInArrow(hashed, "grade int, at binary, v binary").collect()
    rows.sort(key=lambda r: (r["grade"], r["at"], r["v"]))
    grades = [r["grade"] for r in rows]
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32)) for r in rows], grades)


def classify(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2 and kept (P(grade >= 2) is at least `least`) of every row; one narrow pass."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = np.array([model.tails(features(x or "")) for x in b.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.sum(1)), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(t[:, 1] >= least)], names=["doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", "kept"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean")


def op1_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """The grade of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
