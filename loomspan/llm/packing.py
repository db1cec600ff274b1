"""Best-fit packing by exact-complement hashing.

Documents become token ids; those longer than a sequence are cut. Only the number of pieces of each length (at most
`capacity` numbers, whatever the input) goes to the driver. There an index maps every sum to the single lengths, pairs and
triples at hand that make it, the most even first, as these leave the short pieces that fit anywhere. For the longest length
first, single complements before pairs and pairs before triples, the combinations that fill its gap exactly are consumed as
often as their lengths are available; a combination that ran out leaves the index. What is left goes best-fit. Every piece
then finds its place by its rank among the pieces of its length.

Edge cases: a null text is empty and still has its end id; an empty table gives no rows. Repeated rows are packed once each.
Pieces of one length are alike: which of them gets which place is by task and row. Further columns don't matter. A text of any
length is tokenised whole; marks such as <|endoftext|> in it are the tokens that the tokenizer makes of them.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import written

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Chunks and pre-tokens that a worker keeps, of each, within a task; workers live on after their stage.
_MOST = 400_000
#: Marks that, after letters, are a pre-token of their own.
_TAILS = ".,;:!?#$%&*|"
#: A blank that blanks or the end follow: only then does a blank not begin a token.
_LOOSE = re.compile(r" (?=\s|\Z)")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Token ids as little-endian 32-bit bytes. Byte-level pre-tokens never reach over a blank that begins a word, so a text is
    the sum of its blank-led chunks. A chunk of letters and trailing marks is two pre-tokens, which go to the merges of the
    model directly; any other goes through the whole tokenizer. Chunks and pre-tokens met are kept, up to a bound."""

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(marks) or r"(?!)")
        self.merge = self.tokenizer.model.tokenize
        plain = sorted(ByteLevel.alphabet())
        shown = {b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}  # bytes that stand for themselves
        rest = iter(sorted(set(plain) - {chr(b) for b in shown}))
        self.letters = {b: chr(b) if b in shown else next(rest) for b in range(256)}
        self.blank = self.letters[ord(" ")]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _part(self, text: str) -> bytes:
        """Ids of one pre-token, given in the letters that stand for its bytes."""
        return array("I", [t.id for t in self.merge(text)]).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks that follow a blank."""
        words, tails, known, rest = self.words, self.tails, self.chunks, []
        if len(words) > _MOST:
            words.clear()
        if len(tails) > _MOST:
            tails.clear()
        for c in chunks:
            core = c.rstrip(_TAILS)
            if core.isalpha():
                ids = words.get(core)
                if ids is None:
                    ids = words[core] = self._part(self.blank + (core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)))
                if core != c:
                    tail = c[len(core) :]
                    if tail not in tails:
                        tails[tail] = self._part(tail)
                    ids = ids + tails[tail]
                known[c] = ids
            else:
                rest.append(c)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            known.update(zip(part, self._ids([" " + c for c in part]), strict=True))

    def forget(self) -> None:
        self.chunks, self.words, self.tails = {}, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _LOOSE.search(t) or self.marks.search(t) else t.split(" ") for t in texts]
        if len(self.chunks) > _MOST:
            self.chunks = {}
        self._learn({c for x in split if x and len(x) > 1 for c in x[1:]}.difference(self.chunks))
        first = self._ids([t if x is None else x[0] for t, x in zip(texts, split, strict=True)])
        get = self.chunks.__getitem__
        return [a if x is None else a + b"".join(map(get, x[1:])) for a, x in zip(first, split, strict=True)]


def encoder(name: str = TOKENIZER) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a shorter first one if need be."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, with_ids also ids (little-endian 32-bit), and the task and number that tell pieces
    of a length apart. One narrow pass; to be written before its rows are counted, as task numbers may differ the next time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, last = encoder(name), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                row, out, raw = [], [], []
                for k, ids in enumerate(enc.encode(["" if t is None else t for t in part.column(1).to_pylist()])):
                    ids += end
                    for p, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row.append(k)
                        out.append((p, start, length, zlib.crc32(own), task, int(last[length])))
                        last[length] += 1
                        if with_ids:
                            raw.append(own)
                cols = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(raw, pa.binary())] if with_ids else []), names=names)
        enc.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Complements:
    """Index from a sum to the combinations of one, two or three lengths that make it and are available, the most even first.
    Availability only falls, so what has run out is dropped for good."""

    def __init__(self, left: np.ndarray):
        self.left, self.held = left, {}

    def _made(self, total: int, terms: int) -> np.ndarray:
        if terms == 1:
            rows = np.array([[total]])
        elif terms == 2:
            low = np.arange(total // 2, 0, -1)
            rows = np.stack([total - low, low], 1)
        else:  # a shortest length and a pair for the rest
            parts = [np.column_stack([pair, np.full(len(pair), c)]) for c in np.flatnonzero(self.left[: total // 3 + 1])[::-1].tolist() if len(pair := self.of(total - c, 2)) and len(pair := pair[pair[:, 1] >= c])]
            rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        return rows

    def of(self, total: int, terms: int) -> np.ndarray:
        """The combinations that still have a piece of each length."""
        if total < terms:
            return np.zeros((0, terms), np.int64)
        rows = self.held.get((total, terms))
        rows = self._made(total, terms) if rows is None else rows
        rows = rows[(self.left[rows] > 0).all(1)]
        if terms < 3:  # triples are asked for once
            self.held[total, terms] = rows
        return rows


def _filled(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills of at most `most` complements, all single ones before pairs and pairs before triples; then best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    index = Complements(left)
    for terms in range(1, most + 1):
        for a in range(capacity - 1, 0, -1):
            rows = index.of(capacity - a, terms) if left[a] else ()
            while len(rows) and left[a]:
                found = rows[0].tolist()
                lengths, need = np.unique((a, *found), return_counts=True)
                times = int((left[lengths] // need).min())
                if times:
                    left[lengths] -= need * times
                    out.append(((a, *found), times))
                rows = rows[1:]
                rows = rows[(left[rows] > 0).all(1)]
    bins: dict[int, list[list]] = {}  # gap to [lengths, how many]
    for a in range(capacity - 1, 0, -1):
        n = int(left[a])
        while n:
            gap = min((g for g in bins if g >= a), default=None)
            if gap is None:
                fit = capacity // a
                if n >= fit:
                    bins.setdefault(capacity - fit * a, []).append([(a,) * fit, n // fit])
                if n % fit:
                    bins.setdefault(capacity - n % fit * a, []).append([(a,) * (n % fit), 1])
                break
            lengths, many = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
            fit = min(gap // a, n)
            times = min(many, n // fit)
            bins.setdefault(gap - fit * a, []).append([lengths + (a,) * fit, times])
            if many > times:
                bins.setdefault(gap, []).append([lengths, many - times])
            n -= fit * times
    return out + [(lengths, many) for group in bins.values() for lengths, many in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using every piece once. In a small table pairs and triples can spend the
    short pieces that the best fit would want later, so the fewest sequences over the three limits on their number win, at a tie
    those of triples."""
    return min((_filled(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def places(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Sorted keys (length and first rank), with the sequence and the offset that the first rank gets; the ranks that follow get
    the sequences that follow."""
    used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for lengths, times in patterns:
        offset = 0
        for a in lengths:
            rows.append((a << 48 | int(used[a]), sequence, offset))
            used[a] += times
            offset += a
        sequence += times
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. Texts are read once and never shuffled."""
    cut = written(pieces(docs, capacity, name, with_ids), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, sequences, offsets = places(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("number"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy()
            key = b.column(3).to_numpy() << 48 | rank
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], names=[*columns, "sequence_id", "offset"])

    ready = ranked.select(*columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    return ready.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document, packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
