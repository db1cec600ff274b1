"""SimHash near-duplicates by bit-sliced comparison.

A pair within the radius agrees on at least one of more parts than the radius, so fingerprints that share a part meet in a
bucket. There their bits stand vertically: plane k packs bit k of all rows of a task. For each shift d the planes, xored with
themselves moved by d rows, give bit k of the differences of all pairs (i, i+d) at once; a carry-save counter of two planes
and an overflow plane adds them up, and blocks of lanes whose pairs all exceed the radius are abandoned.

Exact copies are one fingerprint before any bucket. Large buckets are dealt over several tasks by pairs of slices, so a task's
rows are bounded and no pair is lost; each task gives a spanning forest, not all pairs.
Edge cases: a null or empty text, and one of blanks, has fingerprint zero and links like any other. Rows that share a doc_id are
one document, as are rows without one that share a text; the latter link and bridge like others, and a component without any id
is null. Further columns don't matter, nor the ids' type. Repeated rows and ties at the radius need no rule: all links count.
An empty table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.llm.shared import ROW_KEY, written

RADIUS = 3
SEED = 42
CHUNK = 4096
STEP = 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)), np.uint64, min(STEP, n - at))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and fp (the 64 bits as a bigint) of every row; one narrow pass."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter(map(fingerprint, b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", f"{ROW_KEY} AS key", "text").mapInArrow(hashed, f"doc_id {kind}, key string, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables for n fingerprints: all choices of all but `radius` of the equal parts. More fingerprints get more
    parts and so longer keys, which keeps buckets small; at any number of parts every pair agrees on some choice."""
    parts = radius + (1 if n <= 1 << 22 else 2 if n <= 1 << 30 else 3)
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(parts)]
    return [sum(c) for c in combinations(part, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _packed(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    raw = np.packbits(bits, bitorder="little")
    out[: len(raw)] = raw
    return out.view(np.uint64)


def close_pairs(planes: np.ndarray, wanted: np.ndarray, d: int, radius: int = RADIUS) -> np.ndarray:
    """Rows i with wanted bit i whose distance to row i+d is within the radius (at most 3)."""
    over, live = ~wanted, np.flatnonzero(wanted)
    if not len(live):
        return live
    over = over[live]
    ones, twos = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
    words, bits = divmod(d, 64)
    for k in range(64):
        plane = planes[k]
        there = plane[live + words] >> np.uint64(bits) if bits else plane[live + words]
        if bits:
            there = there | (plane[live + words + 1] << np.uint64(64 - bits))
        x = plane[live] ^ there
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7:
            keep = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():  # whole blocks of 64 pairs are beyond the radius
                live, over, ones, twos = live[keep], over[keep], ones[keep], twos[keep]
                if not len(live):
                    return live
    near = ~over
    if radius < 3:
        near &= {0: ~ones & ~twos, 1: ~twos, 2: ~(ones & twos)}[radius]
    lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, bit = np.nonzero(lanes)
    return live[block] * 64 + bit


def forest(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of a spanning forest of the links within groups; rows of a group stand together."""
    n = len(fp)
    empty = np.zeros(0, np.int64)
    if n < 2:
        return empty, empty
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, n))
    many = size > 1
    keep = np.repeat(many, size)
    rows = np.flatnonzero(keep)
    if not len(rows):
        return empty, empty
    fp, size = fp[rows], size[many]
    size_of = np.repeat(size, size)
    left = size_of - 1 - (np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size))  # rows of the group that follow
    pad = -(-int(size.max()) // 64) + 2  # words read beyond the last row
    planes = np.stack([np.append(_packed((fp >> np.uint64(k)) & np.uint64(1) != 0), np.zeros(pad, np.uint64)) for k in range(64)])
    label = np.arange(len(rows))
    parts = np.repeat(size, 1).copy()  # components left in each group
    of = np.repeat(np.arange(len(size)), size)
    out_a, out_b = [], []
    for d in range(1, int(size.max())):
        open_rows = (left >= d) & (parts[of] > 1)
        if not open_rows.any():
            if not (left >= d).any():
                break
            continue
        i = close_pairs(planes, _packed(open_rows), d, radius)
        i = i[label[i] != label[i + d]]
        if len(i):
            for a in i.tolist():
                x, y = a, a + d
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                while label[y] != y:
                    label[y] = label[label[y]]
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    parts[of[a]] -= 1
                    out_a.append(a)
                    out_b.append(a + d)
            while True:  # flat again
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return rows[np.array(out_a, np.int64)], rows[np.array(out_b, np.int64)]


def links(reps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges u, v between the node ids of distinct fingerprints (node, fp) that connect exactly what the radius links."""
    n = reps.count()
    keyed = reps.select(
        "node", "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("key")) for t, m in enumerate(masks(n, radius))])).alias("k")
    ).select("node", "fp", "k.t", "k.key")
    large = keyed.groupBy("t", "key").count().where(F.col("count") > chunk).select("t", "key", F.ceil(F.col("count") / chunk).cast("int").alias("slices"))
    dealt = keyed.join(large, ["t", "key"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "fp")
    dealt = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "fp")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            t, key, a, b, node, fp = cols
            new = np.zeros(len(t), np.int64)
            new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            x, y = forest(fp.view(np.uint64), np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["u", "v"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            t, key, a, b = cols[:4]
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]) | (a != a[-1]) | (b != b[-1])) if len(t) else []
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield solve([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield solve(held)

    return dealt.mapInArrow(compared, "u long, v long")


def leaders(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """For each fp of rows (doc_id, key, fp): component_id, the least doc_id reachable over edges between fps and rows of one key, and
    winner, that document's key (without any id the least key)."""
    several = rows.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v <> most").select("key", "v")
    same = rows.join(several, "key").select(F.col("fp").alias("u"), "v")
    tied = components(edges.select("u", "v").unionByName(same))
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    each = each.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = each.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min("key").alias("key"))
    least = least.select("class", "component_id", F.coalesce(F.col("component_id").cast("string"), "key").alias("winner"))
    return each.select("fp", "class").join(least, "class").select("fp", "component_id", "winner")


def grouped(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """The fingerprints and their leaders."""
    fps = written(fingerprints(docs), "fingerprints")
    return fps, leaders(fps, links(fps.select(F.col("fp").alias("node"), "fp").distinct(), radius))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of every row."""
    fps, led = grouped(docs, radius)
    return fps.join(led, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = grouped) -> DataFrame:
    """The rows, whole, of the document with the least id in each group. The rows' text is shuffled once, past a hash table of keys."""
    kept = groups(docs)[1].select(F.col("winner").alias("_winner")).distinct().hint("shuffle_hash")
    return docs.withColumn("_key", F.expr(ROW_KEY)).join(kept, F.col("_key") == F.col("_winner"), "left_semi").select(docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
