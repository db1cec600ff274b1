"""Near copies: SimHash links of five-word shingles and an exact prefix join, all confirmed by the Jaccard similarity of the texts.

A radius of 3 of 64 bits reaches few of the pairs with a similarity of LEAST (5 of 48 on the 0.1 tables), so SimHash alone can't
give right results here; the rest comes from an exact join. Two sets of shingles that reach LEAST share one among the first
n - ceil(LEAST * n) + 1 of each, in any order that all documents use; so documents that share such a shingle meet in a bucket,
and no pair is lost. The order is by hash, with the shingles that are frequent in a sample of documents last, which keeps buckets
small: the sample changes cost, never results. A first round takes the bit-sliced SimHash links and ties each bucket's rows to one
of them, a second to its most central one; a third compares only rows that are still in different components, by sizes and by how
many shingles can still be common. Large buckets are dealt over tasks by pairs of slices, without a cap.

Rows of a bucket that share little else are many, and their number grows faster than the table, so no text moves for them: parities
of the hashes, about a bit a shingle, bound from below in how many shingles two sets differ, which drops a pair only where LEAST is
out of reach. What remains is confirmed by the exact similarity of the texts, and only texts of such pairs are shuffled.

Edge cases: words are lower-cased in ASCII and parted at ASCII blanks, as in simhash; a text of fewer words than a shingle is one
shingle; null, empty and blank texts have none and are copies of each other. Rows that share a doc_id are one document, as are rows
without one that share a text. An empty table gives no rows. Further columns don't matter. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import simhash
from loomspan.llm.components import components
from loomspan.llm.shared import ROW_KEY, written
from loomspan.llm.simhash import _LOWER, CHUNK, SEED

WIDTH = 5
#: Similarity of a link, as a fraction.
LEAST = (4, 5)
SAMPLE = 100_000
FREQUENT = 16
MOST_FREQUENT = 100_000
#: Hashes that a task sorts at once, and the bits that tell their parts.
BLOCK = 1 << 18
PART_BITS = 12
#: A list of so many large buckets or fewer is broadcast.
MOST_LARGE = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The distinct shingles themselves."""
    words = (text or "").encode().translate(_LOWER).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, sorted. Words are hashed once, shingles combine numbers."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    key = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        key = (key ^ (h[k : k + n] * _MIX[k])) * _MIX[0]
        key ^= key >> np.uint64(29)
    return np.unique(key)


def alike(a: set, b: set) -> bool:
    common = len(a & b)
    return common * LEAST[1] >= LEAST[0] * (len(a) + len(b) - common)


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur often in a sample of documents, sorted, and how often. Nearly all occur once, so a hash table of them took
    hundreds of MB a task; they move as blocks of hashes by their highest bits, and a task counts one part at a time."""
    every = -(-docs.count() // SAMPLE)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for t in b.column(0).slice(at, 256).to_pylist():
                    held.append(hashes(t))
                    size += len(held[-1])
                    if size >= BLOCK:
                        yield _parted(held)
                        held, size = [], 0
        if size:
            yield _parted(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for p, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and held:
                    yield _often(held)
                    held = []
                part = p
                held.append(tokens)
        if held:
            yield _often(held)

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, every))) == 0).select("text").mapInArrow(blocks, "part int, tokens binary")
    part = part.repartition("part").sortWithinPartitions("part").mapInArrow(counted, "token long, count long")
    top = written(part, "frequent").orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy()
    by = np.argsort(token)
    return token[by], n[by]


def _parted(held: list[np.ndarray]) -> pa.RecordBatch:
    """The hashes of several texts as a block for each part that has any."""
    token = np.sort(np.concatenate(held))
    start = np.searchsorted(token, np.arange(1 << PART_BITS, dtype=np.uint64) << np.uint64(64 - PART_BITS))
    stop = np.append(start[1:], len(token))
    some = np.flatnonzero(stop > start)
    tokens = [token[a:b].tobytes() for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(tokens, pa.binary())], names=["part", "tokens"])


def _often(held: list[bytes]) -> pa.RecordBatch:
    """The hashes in FREQUENT texts or more, of all blocks of a part."""
    token, n = np.unique(np.frombuffer(b"".join(held), np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(token[n >= FREQUENT]), pa.array(n[n >= FREQUENT], pa.int64())], names=["token", "count"])


def ordered(h: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """h in the order that all documents share: frequent shingles last."""
    token, n = often
    if not len(token):
        return h
    at = np.minimum(np.searchsorted(token, h), len(token) - 1)
    known = token[at] == h
    last = h[known]
    return np.concatenate([h[~known], last[np.argsort(n[at[known]], kind="stable")]])


def parities(h: np.ndarray) -> bytes:
    """A bit for each value of the lowest bits of a hash: whether an odd number of hashes has it. At least as many bits as hashes."""
    size = max(64, 1 << max(0, len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many hashes the sets of two parities differ at least. The longer is folded: fewer of the lowest bits tell values apart."""
    if len(a) > len(b):
        a, b = b, a
    x, bits = int.from_bytes(b, "little"), 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(a, "little")).bit_count()


def majority(h: np.ndarray) -> int:
    """SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.int64)[0])


def prefixes(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp (a hash of the set of shingles), bits (its SimHash), n (its size), its parities and the shingles of its prefix,
    of every row; one narrow pass."""
    often = frequent(docs)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [hashes(t) for t in part.column(2).to_pylist()]
                fp = [xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets]
                first = [ordered(h, often)[: len(h) + (-LEAST[0] * len(h)) // LEAST[1] + 1 if len(h) else 0].view(np.int64) for h in sets]
                ends = np.cumsum([0, *map(len, first)])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(map(majority, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(parities, sets), pa.binary()), prefix],
                    names=["doc_id", "key", "fp", "bits", "n", "parity", "prefix"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", f"{ROW_KEY} AS key", "text").mapInArrow(made, f"doc_id {kind}, key string, fp long, bits long, n long, parity binary, prefix array<long>")


def _by_bucket(df: DataFrame, keys: int, solve, schema: str) -> DataFrame:
    """solve over the columns of whole buckets; df is partitioned and sorted by its first `keys` columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            other = np.zeros(len(cols[0]), bool)
            for c in cols[:keys]:
                other |= c != c[-1]
            last = np.flatnonzero(other)
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield from _tables(solve, [c[:cut] for c in cols], keys, names)
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from _tables(solve, held, keys, names)

    return df.mapInArrow(compared, schema)


def _tables(solve, cols: list[np.ndarray], keys: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols[:keys]:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    for out in solve(cols, start, np.diff(np.append(start, len(new)))):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)


def possible(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles, the first common one at places pos and at, can reach LEAST."""
    most = 1 + np.minimum(n - pos, m - at) - 1
    return most * sum(LEAST) >= LEAST[0] * (n + m)


def _tied(cols, start, size):
    """Rows of buckets of at least two, each with the first of its bucket, where the two can be alike."""
    token, _, node, n, pos = cols
    hub = np.repeat(start, size)
    many = np.repeat(size > 1, size)
    fits = many & (node != node[hub]) & possible(n, pos, n[hub], pos[hub])
    yield token[many], node[many], n[many], pos[many], np.where(fits, node[hub], node)[many], np.repeat(size, size)[many]


def _centred(cols, start, size):
    """Rows of a bucket with its most central one, which stands first, where the two are in different components and can be alike."""
    _, _, _, node, n, pos, comp = cols
    hub = np.repeat(start, size)
    at = (comp != comp[hub]) & possible(n, pos, n[hub], pos[hub])
    yield np.maximum(node, node[hub])[at], np.minimum(node, node[hub])[at]


def _open_pairs(cols, start, size):
    """Pairs of rows of a bucket in different components that can be alike."""
    _, _, _, node, n, pos, comp = cols
    left = np.repeat(start + size, size) - np.arange(len(node)) - 1  # rows of the bucket that follow
    lone = np.minimum.reduceat(comp, start) == np.maximum.reduceat(comp, start)
    live = np.flatnonzero(np.repeat(~lone, size) & (left > 0))
    d = 1
    while len(live):
        to = live + d
        at = (comp[live] != comp[to]) & possible(n[live], pos[live], n[to], pos[to])
        if at.any():
            a, b = node[live[at]], node[to[at]]
            yield np.maximum(a, b), np.minimum(a, b)
        d += 1
        live = live[left[live] >= d]


def _within_reach(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of the pairs u, v (of fps) those that can be alike by their parities, with the keys ku, kv of a document for each."""
    own = reps.select("fp", "key", "n", "parity")
    both = pairs.join(own.toDF("u", "ku", "nu", "pu"), "u").join(own.toDF("v", "kv", "nv", "pv"), "v").select("u", "v", "ku", "kv", "nu", "nv", "pu", "pv")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.fromiter(map(differing, b.column(6).to_pylist(), b.column(7).to_pylist()), np.int64, b.num_rows)
            total = b.column(4).to_numpy() + b.column(5).to_numpy()
            yield b.select(["u", "v", "ku", "kv"]).filter(pa.array(far * sum(LEAST) <= total * (LEAST[1] - LEAST[0])))

    return written(both.mapInArrow(kept, "u long, v long, ku string, kv string"), "within_reach")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs u, v (of fps) whose texts are alike; reps has the key of a document for each fp."""
    pairs = _within_reach(pairs, reps)
    wanted = pairs.select(F.explode(F.array(F.xxhash64("ku"), F.xxhash64("kv"))).alias("h")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_LARGE else wanted
    texts = docs.selectExpr(f"{ROW_KEY} AS key", "text").join(wanted, F.xxhash64("key") == F.col("h"), "left_semi")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, set()
        for b in batches:
            good = []
            for u, v, x, y in (row for at in range(0, b.num_rows, 128) for row in zip(*(c.to_pylist() for c in b.slice(at, 128).columns), strict=True)):
                if v != hub or not held:
                    hub, text_v, held = v, y, shingles(y)
                elif y != text_v:
                    text_v, held = y, shingles(y)
                if alike(shingles(x), held):
                    good.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["u", "v"])

    both = pairs.join(texts.withColumnsRenamed({"key": "ku", "text": "x"}), "ku").join(texts.withColumnsRenamed({"key": "kv", "text": "y"}), "kv")
    return written(both.select("u", "v", "x", "y").mapInArrow(checked, "u long, v long"), "links")


def links(reps: DataFrame, docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges u, v between the fps of reps (fp, key, bits, n, parity, prefix) that connect exactly what similarity links."""
    tokens = reps.select(F.col("fp").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    large = written(tokens.groupBy("token").count().where(F.col("count") > chunk).select("token", F.ceil(F.col("count") / chunk).cast("int").alias("slices")), "large")
    few = F.broadcast(large) if large.count() <= MOST_LARGE else large
    dealt = tokens.join(few, "token", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("token", "node"), F.col("slices")).cast("int"), F.lit(0)))
    dealt = dealt.select("token", "own", "node", "n", F.col("pos").cast("bigint").alias("pos")).repartition("token", "own").sortWithinPartitions("token", "own", "node")
    tied = written(_by_bucket(dealt, 2, _tied, "token long, node long, n long, pos long, hub long, size long"), "tied")
    near = tied.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    near = near.union(simhash.links(reps.select(F.col("fp").alias("node"), F.col("bits").alias("fp")), chunk=chunk).select("u", "v")).where("u <> v")
    near = written(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    found = _confirmed(near, reps, docs)
    rows = tied.select("token", "node", "n", "pos").distinct()
    # Copies of one text are alike to it more than to each other; as all its shingles are theirs, it stands in the largest buckets.
    central = tied.groupBy("node").agg(F.sum("size").alias("central"))
    own = F.pmod(F.xxhash64("token", "node"), F.col("slices")).cast("int")
    open_ = _with_slices(rows, found, few).join(central, "node").withColumn("own", own).select("token", "own", "central", "node", "n", "pos", "comp")
    open_ = open_.repartition("token", "own").sortWithinPartitions("token", "own", F.desc("central"), "node")
    second = written(_by_bucket(open_, 2, _centred, "u long, v long").distinct().join(near, ["u", "v"], "left_anti"), "pairs")
    found = found.union(_confirmed(second, reps, docs))
    rows = _with_slices(rows, found, few).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "n", "pos", "comp")
    rows = rows.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "node")
    more = _by_bucket(rows, 3, _open_pairs, "u long, v long").distinct().join(near.union(second), ["u", "v"], "left_anti")
    return found.union(_confirmed(more, reps, docs))


def _with_slices(rows: DataFrame, found: DataFrame, large: DataFrame) -> DataFrame:
    """rows with the component of their node, and how many slices their bucket has."""
    tied = rows.join(components(found), "node", "left").withColumn("comp", F.coalesce("component", "node"))
    return tied.join(large, "token", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their fp, and the leaders."""
    sets = written(prefixes(docs), "prefixes")
    least = sets.groupBy("fp").agg(F.min("key").alias("key"))  # rows that are alike in both are one node, so they do no harm
    reps = written(sets.join(least, ["fp", "key"], "left_semi").select("fp", "key", "bits", "n", "parity", "prefix"), "reps")
    return sets, simhash.leaders(sets.select("doc_id", "key", "fp"), links(reps, docs))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of every row."""
    sets, led = grouped(docs)
    return sets.select("doc_id", "fp").join(led, "fp").select("doc_id", "fp", "component_id")
