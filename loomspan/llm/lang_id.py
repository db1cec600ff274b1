"""Language identification by mixture inference: expectation-maximisation finds each document's language proportions from
character n-gram likelihoods, and a penalised likelihood selects the set of languages.

The n-gram tables are fitted on a sample of the labelled documents of each language, drawn by a hash of the id over all rows: all of
them up to SAMPLE, else as many as expected five standard deviations below SAMPLE, so that more are next to never drawn.
Edge cases: a null text, and one without a letter, is "und" with score 0. Documents with a null language, and held-out ones,
teach nothing. Without any labelled row everything is "und". Ties go to the language first in order. Repeated rows are
predicted each by itself; further columns don't matter; an empty table gives no rows. Texts of any length are counted in slices
that overlap by a trigram, so slices lose and add none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
SAMPLE = 3000
SMOOTH = 0.3
PENALTY = 3.0
ROUNDS = 40
SLICE = 1 << 22
UNKNOWN = "und"

#: Byte classes: 0 for whatever parts words, letters, and 32 classes of the bytes of other alphabets.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128) & 63)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams within and at the ends of words, and how often each occurs."""
    total = np.zeros(1 << BITS, np.int64)
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    last = 0  # classes that the next slice begins with
    held = np.zeros(0, np.int64)
    for at in range(0, len(raw), SLICE):
        c = _CLASS[raw[at : at + SLICE]]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
        keep[0] = not at or c[0] > 0 or last > 0
        last = int(c[-1])
        c = np.concatenate([held, c[keep]])
        held = c[-2:]
        code = ((c[:-2] * 91 + c[1:-1]) * 91 + c[2:])[c[1:-1] > 0]
        total += np.bincount((code * 0x9E3779B1 >> 7) & ((1 << BITS) - 1), minlength=1 << BITS)
    found = np.flatnonzero(total)
    return found, total[found]


def held_out(doc_id: str = "doc_id"):
    """Column: the document is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each bucket in each of them."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1 << BITS, 0))
    few = max(0.0, sample - 5 * sample**0.5)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 1.0 if n <= sample else few / n)])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), 1 << BITS), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, n = counts(text)
                table[langs.index(lang)][found] += n
        k, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(table[k, bucket])], names=["k", "bucket", "n"])

    # Each task of the scan gives the buckets that its part of the bounded sample fills; they are summed by bucket.
    found = drawn.select("lang", "text").mapInArrow(summed, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), 1 << BITS))
    table[found.column("k").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    table += SMOOTH
    return langs, (table / table.sum(1, keepdims=True)).T.copy()


def mixture(p: np.ndarray, n: np.ndarray, chosen: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood and proportions of the chosen languages, by expectation-maximisation."""
    q = p[:, chosen]
    total = n.sum()
    share = np.full(len(chosen), 1 / len(chosen))
    for _ in range(ROUNDS):
        now = share * (q.T @ (n / (q @ share))) / total
        moved = np.abs(now - share).max()
        share = now
        if moved < 1e-3:
            break
    return float(n @ np.log(q @ share)), share


def infer(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportion of each language; zero for those that the penalised likelihood leaves out. Languages enter one by one, in
    the order of their gain, as long as each pays for itself."""
    out = np.zeros(p.shape[1])
    single = n @ np.log(p)
    first = int(single.argmax())
    chosen, best, share = np.array([first]), single[first], np.ones(1)
    fee = PENALTY * np.log(1 + n.sum())
    while len(chosen) < p.shape[1]:
        gain = (n / (p[:, chosen] @ share)) @ p - n.sum()  # by concavity no language can gain more than this
        gain[chosen] = -np.inf
        if gain.max() <= fee:
            break
        wider = np.append(chosen, gain.argmax())
        score, proportions = mixture(p, n, wider)
        if score - best <= fee:
            break
        chosen, best, share = wider, score, proportions
    out[chosen] = share
    return out


def predict(text: str | None, langs: list[str], p: np.ndarray) -> tuple[str, float]:
    if not text or not langs or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    found, n = counts(text)
    if not len(found):
        return UNKNOWN, 0.0
    share = infer(p[found], n)
    k = int(share.argmax())
    return langs[k], min(1.0, float(share[k]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; one narrow pass. The closure holds 2^14 numbers a language."""
    langs, p = model

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(t, langs, p) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(predicted, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows, whole, whose text has a language."""
    langs, p = model

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [predict(t, langs, p)[0] != UNKNOWN for t in b.column(b.schema.names.index("text")).to_pylist()]
            yield b.filter(pa.array(told, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op5_lang_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
