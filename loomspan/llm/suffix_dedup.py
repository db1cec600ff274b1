"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts earlier are removed.

1. Anchors. Of every SPAN bytes the least hashed GRAM of them is an anchor (winnowing), so equal strings have equal anchors.
   Only anchors that two texts, or two places of one text, share can lie in a repeat; all other text is done.
2. Shards. Around shared anchors text is gathered, up to SHARD bytes in order of (doc_id, place). Its suffix array comes from
   Larsson-Sadakane refinement in numpy: ranks of h bytes and ranks h further on give ranks of 2h bytes, in one sort of packed
   integers over the groups that aren't single yet, until the order is finer than SPAN bytes. Whether neighbours share SPAN bytes
   their common prefixes tell, by Kasai's rule: along a run of places they shrink by one, so bytes are compared only where a run
   begins. What repeats in its shard is decided there.
3. Merging. The other strings travel, as runs of text about their anchor, to the owner of the anchor, in order of (doc_id,
   place). The owner holds the sorted keys of the strings seen, finds each new one among them by binary search, and compares the
   bytes by common prefixes as above. A task merges its own shards in the same way first, for anchors that several of them send.
4. The removed spans meet their texts again.

Exact copies of a text with a smaller id are told by their hash and never searched. Before the shuffle of anchors a task sends
each anchor once, and of each distinct string about an anchor it sends two or three, however many shards it sorts, so a passage
that a third of all texts share gives its owner a few rows for each task. Texts travel compressed.

Edge cases: a null text is empty; an empty one has no bytes and the hash of none. Rows with one doc_id and one text are one
document; with different texts they count as documents in the order of the texts' hashes. A null doc_id comes before all. An
empty table gives no rows; doc_id is a whole number. Further columns don't matter. Whole texts, of any length and any bytes, are searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 100
GRAM = 20
SHARD = 1 << 21
#: A task of the merge should read about so many bytes of text.
TASK_BYTES = 1 << 28
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PLACE = 21
_PLACES = np.uint64((1 << _PLACE) - 1)
_STEP = (1 << 20) - SPAN
#: What a task remembers at most: anchors told to be shared, and bytes of strings sent. Beyond, it forgets and sends again.
MOST_TOLD, MOST_HELD = 1 << 21, 1 << 24
_NONE = np.zeros(0, np.int64)


def _words(raw: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from every place as an integer; bytes past the end are zero."""
    n = len(raw)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = raw
    out = np.empty(n + 8 - n % 8, np.uint64)
    kind = ">u8" if big else "<u8"
    for j in range(8):
        out[j::8] = padded[j : j + len(out)].view(kind)
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place that has them."""
    w, n = _words(raw), len(raw) - GRAM + 1
    return _mixed(w[:n] * _M1 + w[8 : 8 + n] * _M2 + w[12 : 12 + n] * _M3)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor, and the first string that it is the anchor of; strings up to the next anchor's first one
    have it too. Long texts go in slices that overlap by a string."""
    places, hashes, firsts = [], [], []
    for at in range(0, len(raw) - SPAN + 1, _STEP):
        part = raw[at : at + _STEP + SPAN - 1]
        v = _grams(part)
        least = (v & ~_PLACES) | np.arange(len(v), dtype=np.uint64)
        reach, wide = 1, SPAN - GRAM + 1
        while 2 * reach <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if wide > reach:
            least = np.minimum(least[: reach - wide], least[wide - reach :])
        place = (least & _PLACES).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        places.append(place[new] + at)
        hashes.append(v[place[new]])
        firsts.append(new + at)
    if not places:
        return _NONE, _NONE.view(np.uint64), _NONE
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(firsts)


def suffix_order(text: np.ndarray, valid: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Places among `valid` in suffix-array order, ties beyond the last doubling by place, without those that refinement up to half
    the depth shows to share with no other. Ranks of h bytes and ranks h further on give ranks of 2h bytes, until 2h reaches the
    depth; so the order is finer than the depth, and how much two neighbours share is for their common prefix to tell.
    text: at most SHARD bytes; valid places have `depth` bytes."""
    n = len(text)
    index = np.arange(n, dtype=np.uint64)
    bits = np.uint64(_PLACE)
    key = np.sort((_words(text, big=True) >> np.uint64(24)) << bits | index)
    order, head = key & _PLACES, key >> bits
    rank = np.empty(n, np.uint64)
    new = np.concatenate([[True], head[1:] != head[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, index, np.uint64(0)))
    known, live = 5, None
    while known < depth:
        single = new & np.append(new[1:], True)
        live = order[~single] if live is None else live[~single]
        if not len(live):
            return _NONE
        further = np.minimum(live + np.uint64(known), np.uint64(n - 1))  # a valid place has more bytes than that
        key = np.sort(rank[live] << (bits + bits) | rank[further] << bits | live)
        live, head = key & _PLACES, key >> bits
        new = np.concatenate([[True], head[1:] != head[:-1]])
        group = head >> bits
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        offset = np.arange(len(live)) - np.repeat(start, np.diff(np.append(start, len(live))))
        rank[live] = group + np.maximum.accumulate(np.where(new, np.arange(len(live)), 0)).astype(np.uint64) - np.arange(len(live), dtype=np.uint64) + offset.astype(np.uint64)
        known *= 2
    allowed = np.zeros(n, bool)
    allowed[valid] = True
    return live[allowed[live.astype(np.int64)]].astype(np.int64)


def repeated(text: np.ndarray, valid: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Flags the places in `valid` whose string of `depth` bytes also starts earlier: neighbours in suffix order whose common
    prefix reaches the depth are one string, and all its places but the first repeat it."""
    again = np.zeros(len(text), bool)
    order = suffix_order(text, valid, depth)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        by = np.argsort(a)
        same = np.empty(len(a), bool)
        same[by] = common_prefixes(text, a[by], b[by], depth) >= depth
        group = np.concatenate([[0], np.cumsum(~same)])
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        again[order] = order != np.minimum.reduceat(order, start)[group]
    return again


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Lengths, up to `most`, of the common prefixes of the suffixes at a and b, a ascending. By Kasai's rule the length at a+1
    with b+1 is one less; bytes are compared where a run of such pairs begins, and at its end to reach full length."""
    if not len(a):
        return _NONE
    padded = np.append(text, np.zeros(most, np.uint8))
    begins = np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])
    run = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(a)) - 1
    reach = np.zeros(len(first), np.int64)  # equal bytes from the run's first place on
    span, active = a[last] - a[first] + most, np.arange(len(first))
    while len(active):
        width = 64
        x = a[first[active]] + reach[active]
        y = b[first[active]] + reach[active]
        window = np.arange(width)
        same = padded[np.minimum(x[:, None] + window, len(padded) - 1)] == padded[np.minimum(y[:, None] + window, len(padded) - 1)]
        got = np.where(same.all(1), width, same.argmin(1))
        reach[active] += got
        active = active[(got == width) & (reach[active] < span[active])]
    return np.clip(reach[run] - (a - a[first][run]), 0, most)


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals with ascending starts; touching ones join."""
    if not len(starts):
        return starts, ends
    top = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > top[:-1]])
    return starts[new], np.append(top[:-1][new[1:]], top[-1])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Shard:
    """Text around shared anchors, in order of (doc_id, place), until there is enough to be sorted."""

    def __init__(self):
        self.parts, self.docs, self.starts, self.size = [], [], [], 0
        self.own: list[tuple] = []

    def add(self, doc: int, raw: np.ndarray, segments: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, ...]) -> None:
        """segments of raw; own: hash, first and last string of each shared anchor, all within segments."""
        for a, b in zip(*(x.tolist() for x in segments), strict=True):
            self.parts.append(raw[a:b])
            self.docs.append(doc)
            self.starts.append(a)
            self.size += b - a
        self.own.append((doc, *own))

    def solve(self) -> tuple[list[tuple], list[tuple]]:
        """(doc, start, end) removed here, and (anchor, doc, start, text) of the strings to be merged."""
        if not self.size:
            return [], []
        text = np.concatenate(self.parts)
        sizes = np.array([len(p) for p in self.parts])
        at = np.cumsum(sizes) - sizes
        docs, starts = np.array(self.docs), np.array(self.starts)
        valid = np.ones(len(text), bool)
        for k in range(len(sizes)):
            valid[max(at[k], at[k] + sizes[k] - SPAN + 1) : at[k] + sizes[k]] = False
        again = repeated(text, np.flatnonzero(valid))
        removed = []
        s, e = _runs(again)
        segment = np.searchsorted(at, s, "right") - 1
        for d, x, y in zip(docs[segment].tolist(), (s - at[segment] + starts[segment]).tolist(), (e - 1 - at[segment] + starts[segment] + SPAN).tolist(), strict=True):
            removed.append((d, x, y))
        sent, first_of = [], {}
        for k, d in enumerate(self.docs):
            first_of.setdefault(d, k)
        for doc, hashes, lows, highs in self.own:
            k = first_of.get(doc)
            if k is None:
                continue
            last = k
            while last < len(docs) and docs[last] == doc:
                last += 1
            seg = k + np.searchsorted(starts[k:last], lows, "right") - 1
            lo = at[seg] + lows - starts[seg]
            hi = at[seg] + highs - starts[seg]
            for h, a, b, low in zip(hashes.tolist(), lo.tolist(), hi.tolist(), lows.tolist(), strict=True):
                open_ = np.flatnonzero(~again[a : b + 1])
                if len(open_):
                    x, y = int(open_[0]), int(open_[-1])
                    sent.append((h, doc, low + x, text[a + x : a + y + SPAN].tobytes()))
        return removed, sent


def string_keys(raw: np.ndarray) -> np.ndarray:
    """A hash of the SPAN bytes from every place that has them."""
    w, n = _words(raw), len(raw) - SPAN + 1
    rng = np.random.default_rng(7)
    out = np.zeros(n, np.uint64)
    for k in [*range(0, SPAN - 8, 8), SPAN - 8]:
        x = w[k : k + n] ^ rng.integers(1, 1 << 63, dtype=np.uint64)
        x *= rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
        x ^= x >> np.uint64(31)
        out += x * _M3
    return _mixed(out)


class Held:
    """Strings met before, found by binary search among their sorted keys. A key only proposes: the common prefix with the string
    that it stands for decides."""

    def __init__(self):
        self.text, self.keys, self.places = np.zeros(0, np.uint8), np.zeros(0, np.uint64), _NONE

    def meet(self, raw: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each string of the runs (raw between offsets, in order; only runs of one salt are compared): its run, its place there,
        whether it was met before, here or among the held, and the place in raw and the key of all, with what is new."""
        key, count = string_keys(raw), np.diff(offsets) - SPAN + 1
        row = np.repeat(np.arange(len(count)), count)
        local = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[row] + local
        key = _mixed(key[at] + salt[row] * _M1)
        text, rep = np.concatenate([self.text, raw]), np.full(len(key), -1)
        if len(self.keys):
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            rep[hit] = self.places[k[hit]]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        first = first[which]
        own = np.arange(len(key))
        later = (rep < 0) & (first != own)
        rep[later] = len(self.text) + at[first[later]]
        asked = np.flatnonzero(rep >= 0)
        known = np.zeros(len(key), bool)
        known[asked] = common_prefixes(text, len(self.text) + at[asked], rep[asked]) >= SPAN
        return row, local, known, at, key, rep < 0

    def keep(self, raw: np.ndarray, offsets: np.ndarray, row: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        """Holds the strings at these places, with the text of their runs."""
        runs, which = np.unique(row, return_inverse=True)
        if not len(runs):
            return
        size = offsets[runs + 1] - offsets[runs]
        shift = len(self.text) + np.cumsum(size) - size - offsets[runs]
        self.text = np.concatenate([self.text, *(raw[offsets[r] : offsets[r + 1]] for r in runs.tolist())])
        keys, places = np.concatenate([self.keys, key]), np.concatenate([self.places, at + shift[which]])
        by = np.argsort(keys)
        self.keys, self.places = keys[by], places[by]


def _spans(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string of each stretch of flagged ones within a run."""
    new = np.concatenate([[True], row[1:] != row[:-1]])
    begins = flags & (np.concatenate([[True], ~flags[:-1]]) | new)
    ends = flags & (np.concatenate([~flags[1:], [True]]) | np.append(new[1:], True))
    return np.flatnonzero(begins), np.flatnonzero(ends)


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dealt, anchor, text (its hash), shared: each anchor of each text once. What a task itself tells to be shared goes anywhere,
    but for one row that tells the others; what it told it remembers, within a bound."""
    told = np.zeros(0, np.uint64)
    for b in batches:
        hashes, texts, twice = [], [], []
        for t in b.column(0).to_pylist():
            if t is None or len(raw := t.encode()) < SPAN:
                continue
            h = np.sort(anchors(np.frombuffer(raw, np.uint8))[1])
            new = np.concatenate([[True], h[1:] != h[:-1]])
            at = np.flatnonzero(new)
            hashes.append(h[at])
            twice.append(np.diff(np.append(at, len(h))) > 1)
            texts.append(np.full(len(at), np.uint64(xxhash.xxh64_intdigest(raw, 42))))
        if not hashes:
            continue
        h, t, own = np.concatenate(hashes), np.concatenate(texts), np.concatenate(twice)
        order = np.lexsort((t, h))
        h, t, own = h[order], t[order], own[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
        start = np.flatnonzero(fresh)
        own = np.logical_or.reduceat(own, start)
        h, t = h[fresh], t[fresh]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(first) - 1
        shared = (np.bincount(group) > 1)[group] | (np.bincount(group, own) > 0)[group]
        known = _among(told, h)
        tells = first & ~known
        told = np.union1d(told if len(told) < MOST_TOLD else told[:0], h[tells & shared])
        dealt = np.where(tells, h, t ^ (h * _M1))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (dealt, h, t)] + [pa.array(shared | known), pa.array(tells)], names=["dealt", "anchor", "text", "shared", "tells"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and anchor of the shared ones; rows come sorted by what they were dealt by, the telling ones of an anchor together."""

    def told(cols: list[np.ndarray]) -> pa.RecordBatch:
        dealt, anchor, text, shared, tells = cols
        new = np.concatenate([[True], dealt[1:] != dealt[:-1]])
        group = np.cumsum(new) - 1
        first = text[np.flatnonzero(new)][group]
        many = np.bincount(group, tells & (text != first)) > 0
        many |= np.bincount(group, tells & shared) > 0
        keep = shared | (tells & many[group])
        return pa.RecordBatch.from_arrays([pa.array(text[keep]), pa.array(anchor[keep])], names=["text", "anchor"])

    held = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        other = np.flatnonzero(cols[0] != cols[0][-1]) if len(cols[0]) else _NONE
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield told([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        yield told(held)


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = [("" if t is None else t).encode() for t in b.column(1).to_pylist()]
        hashes = np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in raw), np.uint64, len(raw)).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes), pa.array([press.compress(r) for r in raw], pa.binary())], names=["id", "text", "z"])


_SHARD_SCHEMA = "dealt long, id long, text long, start long, stop long, run binary"


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans (run is null) and runs of strings to be merged. Texts come sorted by id and hash."""
    plain = zstandard.ZstdDecompressor()
    shard, keys, last = Shard(), [], None
    held, sent_once = Held(), np.zeros(0, np.uint64)

    def unsent(sent: list[tuple], removed: list[tuple]) -> list[tuple]:
        """What an earlier shard of this task hasn't sent already: an anchor's strings are held from its second shard on."""
        nonlocal held, sent_once
        anchor = np.array([x[0] for x in sent], np.uint64)
        seen = _among(sent_once, anchor)
        sent_once = np.union1d(sent_once if len(sent_once) < MOST_TOLD else sent_once[:0], anchor)
        out, again = [x for x, y in zip(sent, seen.tolist(), strict=True) if not y], [x for x, y in zip(sent, seen.tolist(), strict=True) if y]
        if not again:
            return out
        if len(held.text) > MOST_HELD:
            held = Held()
        raw, offsets = np.frombuffer(b"".join(x[3] for x in again), np.uint8), np.cumsum([0, *(len(x[3]) for x in again)])
        row, local, known, at, key, new = held.meet(raw, offsets, anchor[seen])
        for a, b in zip(*(x.tolist() for x in _spans(known, row)), strict=True):
            _, i, start, _ = again[row[a]]
            removed.append((i, start + int(local[a]), start + int(local[b]) + SPAN))
        a, b = _spans(~known, row)
        lows, highs = np.full(len(again), -1), np.full(len(again), -1)
        lows[row[a][::-1]], highs[row[b]] = local[a][::-1], local[b]  # the first and the last open string of each run
        for (h, i, start, text), x, y in zip(again, lows.tolist(), highs.tolist(), strict=True):
            if x >= 0:
                out.append((h, i, start + x, text[x : y + SPAN]))
        held.keep(raw, offsets, row[new], at[new], key[new])
        return out

    def out() -> pa.RecordBatch:
        removed, sent = shard.solve()
        sent = unsent(sent, removed) if sent else sent
        rows = [(hash((keys[i], x)), *keys[i], x, y, None) for i, x, y in removed]
        rows += [(h - (1 << 64) if h >> 63 else h, *keys[i], x, x + len(r), r) for h, i, x, r in sent]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dealt", "id", "text", "start", "stop", "run"])

    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for k in range(b.num_rows):
            if (ids[k], texts[k]) == last:
                continue
            last = (ids[k], texts[k])
            raw = np.frombuffer(plain.decompress(b.column(2)[k].as_py()), np.uint8)
            wanted = np.sort(np.array(b.column(3)[k].as_py(), np.int64).view(np.uint64))
            place, h, low = anchors(raw)
            high = np.append(low[1:], len(raw) - SPAN + 1) - 1
            hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            h, low, high = h[hit], low[hit], high[hit]
            segments = _joined(low, high + SPAN)
            for part in _cut(segments, h, low, high):
                if shard.size and shard.size + int((part[0][1] - part[0][0]).sum()) > SHARD:
                    yield out()
                    shard, keys = Shard(), []
                keys.append((ids[k], texts[k]))
                shard.add(len(keys) - 1, raw, *part)
    if shard.size:
        yield out()


def _cut(segments, h, low, high):
    """The segments and anchors of a text, in parts of at most half a shard; strings stay whole."""
    most = SHARD // 2
    if int((segments[1] - segments[0]).sum()) <= most:
        yield segments, (h, low, high)
        return
    start = 0
    for k in range(1, len(low) + 1):
        if k == len(low) or high[k] + SPAN - low[start] > most:
            yield _joined(low[start:k], high[start:k] + SPAN), (h[start:k], low[start:k], high[start:k])
            start = k


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, start, stop of removed spans. Runs come sorted by anchor, then id, hash and place, so an equal string met before
    is an earlier one; a place of the same text and start is itself."""
    held, of = Held(), None
    for b in batches:
        if not b.num_rows:
            continue
        dealt, ids, texts, starts, stops = (b.column(k).to_numpy() for k in range(5))
        is_run = b.column(5).is_valid().to_numpy(zero_copy_only=False)
        done = ~is_run
        out = [(ids[done], texts[done], starts[done], stops[done])]
        if is_run.any():
            runs = b.column(5).filter(pa.array(is_run))
            offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
            raw = np.frombuffer(runs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            anchor = dealt[is_run]
            if of != anchor[0]:
                held = Held()
            row, local, known, at, key, new = held.meet(raw, offsets, anchor.view(np.uint64))
            s, e = _spans(known, row)
            r = row[s]
            out.append((ids[is_run][r], texts[is_run][r], starts[is_run][r] + local[s], starts[is_run][r] + local[e] + SPAN))
            if anchor[0] != anchor[-1]:
                held = Held()
            of = anchor[-1]
            fresh = new & (anchor[row] == of)
            held.keep(raw, offsets, row[fresh], at[fresh], key[fresh])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "text", "start", "stop"])


def _final_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for i, z, copy, starts, stops in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            raw = plain.decompress(z)
            s, e = np.array(starts or [], np.int64), np.array(stops or [], np.int64)
            if copy:
                s, e = (np.array([0]), np.array([len(raw)])) if len(raw) >= SPAN else (_NONE, _NONE)
            order = np.argsort(s, kind="stable")
            s, e = _joined(s[order], e[order])
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            rows.append((i, len(raw), int((e - s).sum()), len(s), kept.hexdigest(), s.tolist(), e.tolist()))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])


_NULL = -(1 << 63)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (starts, stops) of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    total = texts.agg(F.sum(F.octet_length("t").cast("bigint"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    found = texts.select("t").mapInArrow(_anchor_rows, "dealt long, anchor long, text long, shared boolean, tells boolean")
    shared = found.repartition(parts, "dealt").sortWithinPartitions("dealt", "text").mapInArrow(_shared_rows, "text long, anchor long")
    wanted = shared.groupBy("text").agg(F.collect_set("anchor").alias("anchors"))

    named = texts.select("id", F.xxhash64("t").alias("text"), F.md5(F.col("t").cast("binary")).alias("m"))
    least = named.groupBy("text", "m").agg(F.min("id").alias("first"))
    copies = named.join(least, ["text", "m"]).where("id > first").select("id", "text", F.lit(True).alias("copy")).distinct()
    firsts = least.select(F.col("first").alias("id"), "text").distinct()

    by_text = ("id", "text")
    pressed = texts.mapInArrow(_pressed, "id long, text long, z binary").repartition(parts, *by_text)  # both joins read this one shuffle
    listed = firsts.join(wanted, "text").select("id", "text", "anchors").repartition(parts, *by_text).hint("shuffle_hash")
    dense = pressed.join(listed, [*by_text]).select("id", "text", "z", "anchors").sortWithinPartitions(*by_text)
    sharded = dense.mapInArrow(_shard_rows, _SHARD_SCHEMA)
    spans = sharded.repartition(parts, "dealt").sortWithinPartitions("dealt", "id", "text", "start").mapInArrow(_merged_rows, "id long, text long, start long, stop long")
    spans = spans.groupBy("id", "text").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    told = spans.select("id", "text", "spans", F.lit(False).alias("copy")).unionByName(copies.select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "copy"))
    told = told.repartition(parts, *by_text).hint("shuffle_hash")
    ready = pressed.join(told, [*by_text], "left").select("id", "z", F.coalesce("copy", F.lit(False)).alias("copy"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    final = ready.mapInArrow(_final_rows, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>")
    return final.select(F.when(F.col("id") != _NULL, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of every document."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("starts", "stops")
