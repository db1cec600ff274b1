"""The corpus operators against brute-force versions on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import components, decontaminate, html_extract, lang_id, near_copies, ordinal_quality, packing, pii, quality_rules, shared, simhash, suffix_dedup, url_filter

rng = random.Random(5)
WORDS = ["the", "and", "rain", "Öl", "x1", "banana", "zz.", "to", "ver", "keit"]


def words(n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


PASSAGES = [words(60), words(40), "ab" * 120, "a" * 300]
ROWS = [(i, words(rng.randint(0, 60)) + " " + rng.choice(PASSAGES)[rng.randint(0, 20) :]) for i in range(60)]
ROWS += [(60 + i, ROWS[rng.randint(0, 20)][1]) for i in range(12)]
ROWS += [(100, None), (101, ""), (102, "short"), (103, "short"), (104, "a" * 99), (105, "a" * 100), (106, " \n\t "), (107, words(9000))]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    for name in ("id", "fp", "z", "count", "status", "x"):  # names that operators use inside
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_suffix_dedup(docs, none):
    seen, want = set(), {}
    for i, t in sorted(ROWS, key=lambda r: r[0]):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                cover[k] += 1
                cover[k + 100] -= 1
            seen.add(raw[k : k + 100])
        on = np.cumsum(cover)[:-1] > 0
        want[i] = (len(raw), int(on.sum()), len(suffix_dedup._runs(on)[0]) if len(raw) else 0, hashlib.sha256(bytes(x for x, y in zip(raw, on, strict=True) if not y)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_across_shards(docs, monkeypatch):
    """Small shards and small memories change no result."""
    whole = sorted(suffix_dedup.suffix_dedup(docs).drop("starts", "stops").collect())
    parts = []
    texts = [(t or "").encode() for _, t in sorted(ROWS, key=lambda r: r[0])]
    monkeypatch.setattr(suffix_dedup, "SHARD", 4096)
    import zstandard

    press = zstandard.ZstdCompressor()
    anchors = sorted({int(h) for t in texts for h in suffix_dedup.anchors(np.frombuffer(t, np.uint8))[1].view(np.int64)})
    batch = suffix_dedup.pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": list(range(len(texts))), "z": [press.compress(t) for t in texts], "anchors": [anchors] * len(texts)})
    rows = [r for b in suffix_dedup._shard_rows(iter([batch])) for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["dealt"], r["id"], r["text"], r["start"]))
    table = suffix_dedup.pa.RecordBatch.from_pylist(rows, suffix_dedup.pa.schema([(c, suffix_dedup.pa.int64()) for c in ("dealt", "id", "text", "start", "stop")] + [("run", suffix_dedup.pa.binary())]))
    parts = [table.slice(k, 50) for k in range(0, table.num_rows, 50)]
    covered = {}
    for b in suffix_dedup._merged_rows(iter(parts)):
        for r in b.to_pylist():
            covered.setdefault(r["id"], set()).update(range(r["start"], r["stop"]))
    assert [len(covered.get(k, ())) for k in range(len(texts))] == [r["n_removed"] for r in whole]


def test_repeats_by_common_prefix():
    text = np.frombuffer(" ".join(t or "" for _, t in ROWS[:40]).encode(), np.uint8)
    places, seen, want = np.arange(len(text) - 99), set(), set()
    for k in places.tolist():
        want |= {k} if text[k : k + 100].tobytes() in seen else set()
        seen.add(text[k : k + 100].tobytes())
    assert set(np.flatnonzero(suffix_dedup.repeated(text, places)).tolist()) == want
    order = suffix_dedup.suffix_order(text, places)
    both = sorted(zip(order[1:].tolist(), order[:-1].tolist(), strict=True))
    got = suffix_dedup.common_prefixes(text, *(np.array(x) for x in zip(*both, strict=True))).tolist()
    raw = text.tobytes()
    assert got == [next((n for n in range(100) if raw[a + n] != raw[b + n]), 100) for a, b in both]
    assert min(got) < 100 == max(got)  # the prefixes decide: neighbours in order need not be equal


def test_held_strings_are_compared_by_bytes(monkeypatch):
    gen = np.random.default_rng(4)
    runs = [gen.integers(97, 100, 130).astype(np.uint8) for _ in range(6)]
    runs += [runs[0][10:120], runs[2], runs[5][:101]]
    raw, offsets = np.concatenate(runs), np.cumsum([0, *map(len, runs)])
    salt = np.ones(len(runs), np.uint64)

    def brute(seen):
        out = []
        for r in runs:
            for k in range(len(r) - 99):
                x = r[k : k + 100].tobytes()
                out.append(x in seen)
                seen.add(x)
        return out

    held = suffix_dedup.Held()
    row, local, known, at, key, new = held.meet(raw, offsets, salt)
    assert known.tolist() == brute(set()) and (new == ~known).all()
    held.keep(raw, offsets, row[new], at[new], key[new])
    assert held.meet(raw, offsets, salt)[2].all()
    monkeypatch.setattr(suffix_dedup, "string_keys", lambda raw: np.zeros(len(raw) - 99, np.uint64))  # every key collides
    found = suffix_dedup.Held().meet(raw, offsets, salt)[2]
    assert not (found & ~np.array(brute(set()))).any()  # nothing unequal is ever taken for equal


def brute_fingerprint(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def joined(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_simhash(docs, none):
    fp = {i: brute_fingerprint(t) for i, t in ROWS}
    ids = sorted(fp)
    root = joined(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 3])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (fp[i], ids[root[k]]) for k, i in enumerate(ids)}
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {ids[k] for k in set(root)}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("chunk", [3, 4096])
def test_near_copies(spark, docs, chunk, monkeypatch):
    gen = random.Random(9)
    rows = [r for r in ROWS if r[0] != 107]
    for g in range(8):
        base = [f"w{gen.randint(0, 3000)}" for _ in range(gen.choice([30, 120, 300]))]
        for k in range(9):
            copy = list(base)
            for _ in range(gen.randint(0, len(base) // 40 + 1)):
                copy[gen.randrange(len(copy))] = f"v{gen.randint(0, 3000)}"
            rows.append((1000 + 10 * g + k, " ".join(copy)))
    sets = {i: near_copies.shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if not sets[ids[a]] | sets[ids[b]] or len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    root = joined(len(ids), pairs)
    far = [1 for a, b in pairs if bin(brute_fingerprint(dict(rows)[ids[a]]) ^ brute_fingerprint(dict(rows)[ids[b]])).count("1") > 3]
    assert len(far) > 20  # pairs that the query's radius loses
    monkeypatch.setattr(near_copies.links, "__defaults__", (chunk,))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()}
    assert got == {i: ids[root[k]] for k, i in enumerate(ids)}
    if chunk == 3:
        import corpus_pipeline

        assert {r["doc_id"] for r in corpus_pipeline.deduplicated(spark, df, "").collect()} == {ids[k] for k in set(root)}


def test_parities_bound_the_difference():
    gen = np.random.default_rng(4)
    for n, m, same in [(0, 0, 0), (0, 70, 0), (1, 1, 1), (64, 65, 60), (700, 700, 640), (700, 3000, 650), (5000, 5000, 5000)]:
        both, a, b = (gen.integers(0, 1 << 63, k, np.uint64) for k in (same, n - same, m - same))
        far = near_copies.differing(near_copies.parities(np.concatenate([both, a])), near_copies.parities(np.concatenate([b, both])))
        assert far <= n + m - 2 * same and far % 2 == (n + m) % 2
    a, b = (near_copies.parities(gen.integers(0, 1 << 63, 700, np.uint64)) for _ in range(2))
    assert 9 * near_copies.differing(a, b) > 1400  # texts with nothing in common are told apart


def test_unlike_texts_are_not_moved(spark, monkeypatch):
    """Texts that share a passage only meet in buckets, but none of their pairs is confirmed on the texts."""
    gen = random.Random(3)
    passages = [" ".join(f"p{k}" for k in range(30 * g, 30 * g + 30)) for g in range(4)]  # of ten texts each, so not frequent
    rows = [(i, " ".join(f"w{gen.randint(0, 10**6)}" for _ in range(200)) + " " + passages[i % 4]) for i in range(40)]
    rows += [(40, rows[7][1] + " end")]
    held, write = {}, near_copies.written

    def kept(df, name):
        held.setdefault(name, []).append(write(df, name))
        return held[name][-1]

    monkeypatch.setattr(near_copies, "written", kept)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 7 if i == 40 else i for i in range(41)}
    assert sum(t.count() for t in held["pairs"]) > 20  # they do meet
    assert sum(t.count() for t in held["within_reach"]) == 1


def test_frequent_shingles_move_in_blocks(spark, monkeypatch):
    """The same counts as one by one, but no row for each of the shingles, which nearly all occur once."""
    gen = random.Random(5)
    usual = [" ".join(f"u{k}" for k in range(9 * g, 9 * g + 9)) for g in range(3)]
    rows = [(i, " ".join(f"w{gen.randint(0, 10**7)}" for _ in range(1500)) + " " + usual[i % 3 if i < 50 else 0]) for i in range(60)]
    rows += [(60, None), (61, " "), *((62 + k, "Few words") for k in range(near_copies.FREQUENT))]
    n = Counter(h for _, t in rows for h in near_copies.hashes(t).tolist())
    monkeypatch.setattr(near_copies, "BLOCK", 20_000)
    spark.sparkContext.setJobGroup("frequent", "")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token, often = near_copies.frequent(df)
    assert dict(zip(token.tolist(), often.tolist(), strict=True)) == {h: k for h, k in n.items() if k >= near_copies.FREQUENT}
    assert list(token) == sorted(token) and len(token) > 10
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("frequent") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    moved = max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 0 < moved < len(n) / 3
    assert near_copies.frequent(df.limit(0))[0].size == 0


def test_written_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" "))}

    before, setting = files(), spark.conf.get(shared._CLEANUP)
    table = shared.written(spark.range(1000).repartition(7, "id"), "some")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and table.count() == 1000
    assert spark.conf.get(shared._CLEANUP) == setting


@pytest.mark.parametrize("chunk", [3, 4096])
def test_links_with_hot_buckets(spark, chunk):
    gen = np.random.default_rng(2)
    fp = []
    for _ in range(6):
        base = int(gen.integers(0, 1 << 63))
        for _ in range(20):
            fp.append(base ^ sum(1 << int(b) for b in gen.choice(40, gen.integers(0, 6), False)))
    fp = sorted(set(fp))
    reps = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fp)], "node long, fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(reps, chunk=chunk)).collect()}
    root = joined(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 3])
    assert [got.get(k, k) for k in range(len(fp))] == root


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 60), (60, 50), (70, 70)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 50: 50, 60: 50}


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, with_ids=True).collect()
    by, places = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["length"] <= 1024
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert b"".join(x[2] for x in sorted(by[i])) == np.array(ids, "<u4").tobytes()
        head = len(ids) % 1024
        assert [x[1] for x in sorted(by[i])] == [0] * (head > 0) + list(range(head, len(ids), 1024))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 1024) + 2
    assert packing.pack(none).count() == 0


def test_plan_uses_every_piece():
    counts = {k: rng.randint(0, 50) for k in range(1, 1025)}
    patterns = packing.plan(counts)
    used = {}
    for lengths, n in patterns:
        assert sum(lengths) <= 1024 and n > 0
        for a in lengths:
            used[a] = used.get(a, 0) + n
    assert used == {k: v for k, v in counts.items() if v}
    assert sum(n for _, n in patterns) <= -(-sum(k * v for k, v in counts.items()) // 1024) * 1.01 + 1


def test_encoder_ids():
    e = packing.encoder()
    odd = ["", " ", "a ", "  a", "a\n b", "foo\n  bar", "a\n \nb", "x\t y", "it's a  b", "　 a", "don't x_y 12,3", "日本 語。 ß... a.b ²x ǅ! İI", "THE!! a%%% b&&&"]
    assert e.encode(odd) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_encoder_keeps_what_it_met(monkeypatch):
    e = packing.Encoder(packing.TOKENIZER)
    asked, part = [], e._part
    monkeypatch.setattr(e, "_part", lambda text: asked.append(text) or part(text))
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in letters[:13])  # 228,488 words
    many += " Öl äöü, naïve."
    first = e.encode([many])
    assert e.encode([many]) == first and len(asked) == len(set(asked)) > 220_000
    assert first == [np.array(e.tokenizer.encode(many, add_special_tokens=False).ids, "<u4").tobytes()]
    e.forget()
    assert not e.chunks and not e.words and e.encode(["a b"]) == [np.array(e.tokenizer.encode("a b", add_special_tokens=False).ids, "<u4").tobytes()]


def test_pii(spark, none):
    texts = [None, "", "a@b.c_d@e.f x@y a.b@c.d-e.f.g. é@b.cc", "1.2.3.4.5.6.7.8 256.1.1.1 0000000000001.2.3.4", "4111 1111 1111 1111 x4111111111111111 4111111111111112", "+1 (559) 555-3817%%% ++12345678901 +1((( +49.30.123456-7", "𝒳 é a@b.co " * 150, "1" * 3000 + "." + "a" * 3000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("m_ip", F.lit(1)).withColumn("has_digit", F.lit(1))

    def luhn(d):
        return sum(v - 9 if v > 9 else v for k, c in enumerate(reversed(d)) for v in [int(c) * (1 + k % 2)]) % 10 == 0

    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    got = {r["doc_id"]: r for r in pii.find_spans(df).collect()}
    for i, t in enumerate(texts):
        for kind, (pattern, ok) in base.items():
            want = [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, t or "") if ok(m.group())]
            assert [(s["x"], s["start"], s["end"]) for s in got[i][f"s_{kind}"] or []] == want, (i, kind)
    more = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32 ok GB83WEST12345698765432"), (2, "call 555-123-4567, order 555-123-4567"), (3, 'token = "c80fd45a66f8564a"')], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_spans(more).collect()}
    assert len(found[1]["s_iban"]) == 1 and len(found[2]["s_local_phone"]) == 1 and len(found[3]["s_secret"]) == 1
    red = {r["doc_id"]: r for r in pii.redact(df.withColumn("n_chars", F.lit(7).cast("long"))).collect()}
    assert red[0]["text"] is None and red[2]["text"].startswith("[EMAIL][EMAIL]") and red[2]["n_chars"] == len(red[2]["text"])
    assert pii.redact(none).count() == 0 and pii.find_spans(none).count() == 0


def test_pii_context_past_other_matches(spark):
    texts = ["call 555-123-4567 or 555-987-6543", "555-123-4567 (cell)", "phone: 555-123-4567, 555-987-6543, 555-222-3333", "555-123-4567 or 555-987-6543", "call " + "x" * 60 + " 555-123-4567", "order 555-123-4567, call 555-987-6543 é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["x"] for s in r["s_local_phone"]] for r in pii.find_spans(df).collect()}
    want = [["555-123-4567", "555-987-6543"], ["555-123-4567"], ["555-123-4567", "555-987-6543", "555-222-3333"], [], []]
    assert [got[i] for i in range(5)] == want and got[5] == ["555-987-6543"]
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        for x in got[i]:
            t = t.replace(x, "[LOCAL_PHONE]")
        assert red[i] == t


def test_decontamination(spark, none):
    item = "In the year 1995 Alice bought 12 kg of apples from Bob and paid 30 dollars to him today."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    rows = [(1, f"x y. {item} z"), (2, "So In the year 2003 Carol bought 99 kg of apples from Dan and paid 17 dollars to him today. z"), (3, None), (4, words(200)), (5, "of apples from Bob and"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(1))
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag_contaminated(df, bench).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.flag_contaminated(none, bench).count() == 0
    wide = "Alice met Alice and Alice saw Alice near the old mill by the river"
    mixed = "Alice met Bob and Carol saw Dave near the old mill by the river"
    one = spark.createDataFrame([(1, wide)], "item_id long, text string")
    held = decontaminate.held_items(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), one).first()
    assert held["coverage"] == 1 and held["agreement"] < 0.8


def test_decontamination_by_occurrence(spark):
    item = "In the year 1995 Alice bought 12 kg of apples from Bob and paid 30 dollars to him today."
    other = "In the year 2003 Carol bought 99 kg of apples from Dan and paid 17 dollars to him today."
    longer = "In the year 2003 Anna Maria bought 99 kg of apples from Dan and paid 1,700 dollars to him today."
    table = "The sums of the last run were 11 12 13 14 15 and all agreed with what had been written before"
    bench = spark.createDataFrame([(1, item), (2, table)], "item_id long, text string")
    numbers = " ".join(str(100 + 7 * k % 311) for k in range(300))
    texts = [f"{item} {other}", f"{other} {other.replace('Dan', 'Eve')}", f"{table} {numbers}", f"{numbers} {table} {numbers}", f"{longer} {item}", longer, numbers, "x y z " * 30 + "of apples from Dan and"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag_contaminated(df, bench).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False}


def test_decontamination_in_any_case(spark):
    item = "Alice Brown met Carol Dean near York. A day later Frank Green wrote to Henry Irving. Then James Kent left for Leeds with 12 kg of Tea."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item, item.upper(), item.lower(), item.title(), item.lower().replace("12 kg", "31 kg"), "near York a day later he left for Leeds", item.upper()[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag_contaminated(df, bench).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False}


def test_quality_rules(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)} if len(w) < 2000 else None
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        if cover is not None:
            assert r["n_repeat_words"] == len(cover) and r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.measures("a b\nc\n\na b\n \na b")[3] == 2
    n, whole, chunks = quality_rules.measures("ab " * 10 + "x" * 5000)[6:]
    assert not quality_rules.Limits().passed(n, whole, np.array(chunks))  # repetitive
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_bands(spark):
    gen = random.Random(8)
    vocab = ["".join(gen.choice("etaoinshrdlu") for _ in range(gen.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(gen.choice(vocab) for _ in range(n))
    junk = lambda n: " ".join("".join(chr(gen.randint(33, 126)) for _ in range(9)) for _ in range(n // 10))
    phrases = [prose(4) for _ in range(40)]
    rows = [(k, prose(gen.randint(60, 1500))) for k in range(700)] + [(5000 + k, rows_) for k, rows_ in enumerate([prose(300)] * 300)]  # a group of copies
    bad = [junk(900), junk(6000), prose(700) + " " + junk(4000), " ".join(f"{gen.choice(phrases)} {k}" for k in range(300)), " ".join(f"{w}%%%%%%%%" for w in prose(400).split())]
    df = spark.createDataFrame(rows + [(9000 + k, t) for k, t in enumerate(bad)], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert [(k, len(t), got[k]["zstd_ratio"], got[k]["bad_chunk_share"]) for k, t in rows if not got[k]["kept"]] == []
    assert [got[9000 + k]["kept"] for k in range(len(bad))] == [False] * len(bad)
    assert not any(got[9000 + k]["base_failed"] for k in (0, 1, 2, 4))  # the bands alone reject these
    limits = quality_rules.fit_limits(quality_rules.measured(df))
    for k, t in rows[:50]:  # brute force: whole text and every chunk, the last at the end
        n, raw = len(t.encode()), t.encode()
        whole, chunks = quality_rules.compression(raw)
        parts = [raw] if n <= 2048 else [raw[i : i + 2048] for i in range(0, n - 2048, 2048)] + [raw[-2048:]]
        assert len(chunks) == len(parts) and limits.passed(n, whole, np.array(chunks)) == got[k]["kept"]


@pytest.mark.parametrize("name", ["quality_base", "url_rules", "pii_counts"])
def test_sql_of_base_columns(spark, name):
    import duckdb

    from loomspan.llm import queries

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    want = db.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(names).collect())


def test_main_text_by_ratios_alone(spark):
    """No article, no telling names: ratios choose the region."""
    links = "".join(f"<li><a href='/{k}'>Link {k}</a></li>" for k in range(6))
    page = f"<body><div><ul>{links}</ul></div><div>Short note.</div><div><h2>Title</h2><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div>All rights reserved.</div></body>"
    assert html_extract.main_text(page) == f"Title {LONG.strip()} Yes. {LONG.strip()}"
    empty = f"<body><nav><a>x</a></nav><article></article><footer>{MORE}</footer></body>"
    assert html_extract.main_text(empty) == ""
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "u", "<p>" + "word " * 200_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["n_chars"]) for r in html_extract.extract_main_text(pages).orderBy("page_id").collect()]
    n = len(html_extract.main_text(page))
    assert got == [(1, n), (1, n), (2, 0), (3, 999_999)]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_complement_index_and_marks():
    left = np.zeros(1025, np.int64)
    left[[100, 200, 300, 400]] = 1, 2, 1, 0
    index = packing.Complements(left)
    assert index.of(300, 1).tolist() == [[300]] and index.of(400, 2).tolist() == [[200, 200], [300, 100]] and index.of(600, 3).tolist() == [[200, 200, 200], [300, 200, 100]]
    left[100] = 0
    assert index.of(400, 2).tolist() == [[200, 200]]
    plan = packing.plan({700: 3, 224: 3, 100: 3})
    assert plan[0] == ((700, 224, 100), 3) and sum(n for _, n in plan) == 3
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "no mark here. <|end of text|>"]
    assert packing.encoder().encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_rows_without_an_id_link_and_bridge(spark):
    a, b = " ".join(f"w{k}" for k in range(400)), " ".join(f"w{k}" for k in range(400)) + " tail"
    df = spark.createDataFrame([(1, a), (None, b), (None, b), (None, "alone " * 3), (7, b)], "doc_id long, text string")
    fps = {t: brute_fingerprint(t) for t in (a, b)}
    near = bin(fps[a] ^ fps[b]).count("1") <= 3
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1 if near else 7), (None, 1 if near else 7), (None, None), (7, 1 if near else 7)], key=str)
    kept = simhash.keep_one(df).collect()
    assert {r["doc_id"] for r in kept} == ({1, None} if near else {1, 7, None}) and sum(r["text"].startswith("alone") for r in kept) == 1


def test_lang_id(spark, none):
    text = {"en": "the and of to in is that for with", "de": "der die und ist nicht mit auf schön für", "fr": "le la les des est dans avec pour été"}
    rows = [(3 * k + j, " ".join(rng.choice(text[g].split()) for _ in range(20)), g) for k in range(60) for j, g in enumerate(text)]
    rows += [(900, None, "en"), (901, "123 ...", "en"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    got = {r["doc_id"]: r for r in lang_id.identify(df, model).collect()}
    for i, t, g in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] == (g if i < 900 else "und")
    langs, p = model
    found, n = lang_id.counts(" ".join([text["en"]] * 20 + [text["fr"]] * 10))
    share = dict(zip(langs, lang_id.infer(p[found], n), strict=True))
    assert share["en"] > share["fr"] > 0.15 and share["de"] == 0
    assert {r["doc_id"] for r in df.join(lang_id.keep_identified(df, model).select("doc_id"), "doc_id", "left_anti").collect()} == {900, 901, 902}
    assert lang_id.train(none)[0] == [] and lang_id.predict("abc", [], p) == ("und", 0.0)


def test_ordinal(spark, none):
    rows = [(k, words(30) + (" idiot scum" if k % 3 == 0 else " ### %%% ###" * 8 if k % 3 == 1 else ""), k % 3) for k in range(150)]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(g == 2), int(g == 0)) for k, _, g in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(df, labels)
    assert (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in ordinal_quality.classify(df, model).collect()}
    assert np.mean([got[k]["kept"] == (g == 2) for k, _, g in rows]) > 0.9
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] and abs(r["expected_grade"] - r["p_at_least_1"] - r["p_at_least_2"]) < 1e-9 for r in got.values())
    flat = ordinal_quality.fit([], [])
    assert ordinal_quality.classify(df, flat).count() == 151


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        (None, "", "", None),
        ("no scheme", "", "", None),
        ("http://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7"),
        ("https://x.com/en/1", "x.com", "/en/1", "com/en/"),
        ("ftp://com/en/?x", "com", "/en/", "com/en/"),
        ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8"),
        ("http://q.net#/de/", "q.net", "", None),
        ("http://xcom/en/", "xcom", "/en/", None),
    ],
)
def test_urls(url, host, path, rule):
    assert url_filter.parts(url) == (host, path)
    assert url_filter.matching(host, path)[0] == rule


def test_url_rule_verdicts(spark):
    """The contract's word of every rule, whatever the model says of the url."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {domain + prefix: verdict for verdict, domain, prefix in url_filter.RULES} == want
    urls = ["http://x.com/en/1", "http://www.example.com/en/71", "http://casino-bets.net/de/1", "http://example.net/de/8/a", "http://example.net/de/7", "http://library.org/es/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.url_filter(df).orderBy("page_id").collect()] == [(k, want[k]) for k in ("com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "net/de/", "org/es/")]


def test_url_model(spark):
    w = url_filter.fit()
    table = url_filter.labelled_urls()
    assert np.mean([(url_filter.score(w, *url_filter.parts(u)) >= 0.5) == y for u, y in table]) > 0.98
    df = spark.createDataFrame([(1, "http://casino-bets.example.com/fr/1"), (2, None), (3, "http://library.example.com/fr/1")], "page_id long, url string").withColumn("rule", F.lit(1))
    assert [r["verdict"] for r in url_filter.url_filter(df, w).orderBy("page_id").collect()] == ["block", "allow", "allow"]


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>t</title></head><body><nav><a>m</a></nav><article><h1>Head</h1><p>One &amp; two<br>three <b>b</b>old</p><p>x</article><footer>f</footer>", "Head One & two three bold x"),
        ("<body><div class='ad'>buy now this long advertisement text</div><main><p>Short.</p><div class='comments'><p>reader says</p></div></main></body>", "Short."),
        ("<article><script>var a='</p>';</script><style>p{}</style><p>a\n\n b</p><form><input>q</form><![bad[ x></article>", "a b"),
        ("<div><p>" + "long text here " * 30 + "</p><p>tail</p></div>", ("long text here " * 30).strip() + " tail"),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


LONG = "some long text of the story goes on here " * 10
MORE = "and a second part of it ends here " * 4


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><div><h1>Title</h1><div><p>{LONG}</p></div><div><p>{MORE}</p></div></div></body>", f"Title {LONG.strip()} {MORE.strip()}"),
        (f"<body><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>The end.</p></body>", f"Title {LONG.strip()} {LONG.strip()} The end."),
        (f"<body><article><p>{LONG}</p></article><article><p>Short one.</p></article></body>", f"{LONG.strip()} Short one."),
        (f"<body><div class='layout has-sidebar'><h1>Title</h1><p>{LONG}</p><div class='sidebar'><p>links</p></div></div></body>", f"Title {LONG.strip()}"),
        (f"<body><div id='menu'><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<body><div><p>{MORE}</p></div><div class='comments'><p>{LONG}</p></div></body>", MORE.strip()),
    ],
)
def test_main_text_whole(html, text):
    assert html_extract.main_text(html) == text


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, PASSAGES[1])], "item_id long, text string")
    source = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), "n_chars")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    lettered = {i: t for i, t in ROWS if t and any(map(str.isalpha, t))}
    ids = sorted(lettered)
    sets = {}  # the stage's rule: five-word shingles, similarity of 0.8
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", lettered[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = joined(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(sets[ids[a]] & sets[ids[b]]) >= 4 * len(sets[ids[a]] | sets[ids[b]])])
    kept = {ids[k] for k in set(root)}
    clean = {i for i in kept if PASSAGES[1][20:] not in lettered[i]}  # the passages lack at most 20 characters
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean
    stage = corpus_pipeline.STAGES[0][1](spark, source, str(tmp_path))
    assert stage.columns == source.columns and {r["doc_id"] for r in stage.collect()} == set(ids)
