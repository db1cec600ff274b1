"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words (runs of letters and digits) become a template: numbers, units after numbers, and names (capitalised words, wherever they
stand) turn into typed placeholders, all else is lower-cased. Windows with names also stand in a form where names are
lower-cased words, so that an item is found in capitals or small letters too. A document holds an item if it has at least COVER
of the item's windows, and LEAST of them or all there are, and the placeholders agree: each value of the item stands for one
value in the document, so a question with other numbers or names is still found, and a chance mixture isn't.

1. Search. The hashes of the documents' windows meet those of each item's rarest windows in a hash join. An item has so few
   others that no document reaches COVER without one of these, so nothing is lost, and windows that many items share meet no
   document unless an item has none else. A window of numbers and units alone matches any table: it is searched by its values.
2. Verdict. For the pairs found, all windows count, those of placeholders alone included. Both tests are made for each
   occurrence by itself: for the hits at one distance between document and item, for those within two tilings of distances as
   wide as the item (values of more or fewer words shift what follows), and for the whole document; any one that passes is enough.

Items that differ in their numbers only are one for the search and the verdict; the least id stands for them.

Edge cases: null and empty texts, and those with fewer words than a window, hold nothing; such items are never held. An item of
numbers alone is held where a window of it stands with the same values. Rows that share a doc_id count as one document, as do
rows without one that share a text. Of items that tie the least id is told. An empty benchmark or an empty table gives no hit;
repeated items don't matter, nor do further columns. Whole texts are windowed, whatever their length; the search for equal
values within an item takes the square of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import ROW_KEY, written

WINDOW = 5
COVER = 0.5
AGREE = 0.8
LEAST = 4
#: A benchmark of more windows than this is joined by a shuffle of hashes instead of a broadcast.
BROADCAST_WINDOWS = 1_000_000
UNITS = (
    "mm cm m km in ft mi inch inches foot feet mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg "
    "gram grams kilogram kilograms oz lb lbs pound pounds ton tons tonne tonnes ml l litre litres liter liters gallon gallons s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw watt watts v "
    "volt volts a amp amps j kj joule joules cal kcal pa kpa bar k celsius fahrenheit degree degrees percent usd eur gbp dollar "
    "dollars euro euros cent cents mph kmh"
).split()
#: Texts of so many documents or fewer are fetched for the verdict by a broadcast of their keys, of more by a shuffle.
BROADCAST_KEYS = 1_000_000
_SLOTS = [f"s{k}" for k in range(WINDOW)]


def _templates(df: DataFrame, key: str) -> DataFrame:
    """key; h: the template's codes (1 number, 2 unit, 3 name, else a word's hash); s: hashed values of the placeholders (0: none);
    f: the codes with names as words, null without names.

    Words are hashed once, windows combine numbers. Each step names what the one before it made twice, so that the optimiser
    doesn't write it into the lambdas."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    df = df.selectExpr(key, r"filter(split(coalesce(text, ''), '[^\\p{L}\\p{N}]+', -1), x -> x <> '') AS t")
    df = df.selectExpr(
        key,
        "t",
        "transform(t, (x, i) -> CASE WHEN ascii(x) BETWEEN 48 AND 57 THEN 1L "
        f"WHEN i > 0 AND ascii(t[i - 1]) BETWEEN 48 AND 57 AND lower(x) IN ({units}) THEN 2L "
        "WHEN x = lower(x) THEN xxhash64(x) WHEN substr(x, 2) = lower(substr(x, 2)) THEN 3L ELSE xxhash64(lower(x)) END) AS h",
    )
    return df.selectExpr(
        key,
        "h",
        "transform(h, (k, i) -> CASE WHEN k BETWEEN 1L AND 3L THEN xxhash64(lower(t[i])) ELSE 0L END) AS s",
        "CASE WHEN array_contains(h, 3L) THEN transform(h, (k, i) -> CASE WHEN k = 3L THEN xxhash64(lower(t[i])) ELSE k END) END AS f",
    )


def _each(form: str, joined: str = ", ") -> str:
    return joined.join(form.format(f"i + {k}") for k in range(WINDOW))


_PLACES = f"sequence(0, size(h) - {WINDOW})"
_HASH, _FOLDED, _VALUES = f"xxhash64({_each('h[{}]')})", f"xxhash64({_each('f[{}]')})", f"xxhash64({_each('s[{}]')}, 1)"
_BARE, _NAMED = _each("h[{}] BETWEEN 1L AND 3L", " AND "), _each("h[{}] = 3L", " OR ")
#: What a window is searched by: its template if that has a word, else, of numbers and units, its values.
_SOUGHT = f"CASE WHEN NOT ({_BARE}) THEN {_HASH} WHEN NOT ({_NAMED}) THEN {_VALUES} END"


def _inlined(df: DataFrame, key: str, made: str, more: str, out: str) -> DataFrame:
    """made for every window, and more for every window that has names."""
    more = f"transform(filter({_PLACES}, i -> {_NAMED}), i -> {more})"
    made = f"transform({_PLACES}, i -> {made})"
    return df.selectExpr(key, f"{out}(CASE WHEN size(h) >= {WINDOW} AND size(s) = size(h) THEN CASE WHEN size(f) = size(h) THEN concat({made}, {more}) ELSE {made} END END)")


def windows(templates: DataFrame, key: str) -> DataFrame:
    """key, place, hash, what to search by (sought, null for none; worded: whether that has a word) and the slots s0, s1, ... of every
    window, once more with names lower-cased and no placeholders of every window that has names; one narrow pass."""
    slots = ", ".join(f"'s{k}', s[i + {k}]" for k in range(WINDOW))
    kept = ", ".join(f"'s{k}', CASE WHEN h[i + {k}] = 3L THEN 0L ELSE s[i + {k}] END" for k in range(WINDOW))
    made = f"named_struct('place', i, 'hash', {_HASH}, 'sought', {_SOUGHT}, 'worded', NOT ({_BARE}), {slots})"
    more = f"named_struct('place', i, 'hash', {_FOLDED}, 'sought', {_FOLDED}, 'worded', true, {kept})"
    return _inlined(templates, key, made, more, "inline")


def _classes(benchmark: DataFrame) -> DataFrame:
    """item_id, n (items alike), h, s, f: one row for the items with one template, equal names and values that repeat alike."""
    rows = _templates(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), "item_id").where(f"size(h) >= {WINDOW}")
    rows = rows.withColumn("alike", F.expr("transform(s, x -> CASE WHEN x <> 0 THEN array_position(s, x) ELSE 0L END)"))
    one = rows.groupBy(F.xxhash64("h", "f", "alike").alias("class"), "h", "alike").agg(F.min(F.struct("item_id", "s", "f")).alias("first"), F.count_distinct("item_id").alias("n"))
    return one.select("first.item_id", "n", "h", "first.s", "first.f")


def _sought(items: DataFrame) -> DataFrame:
    """item_id, sought: each item's rarest windows, so many that a document with COVER of them all has one of these."""
    places = items.groupBy("item_id", "place").agg(F.max("worded").alias("worded"))
    asked = items.where("sought IS NOT NULL").select("item_id", "place", "sought").distinct()
    often = asked.groupBy("sought").agg(F.count_distinct("item_id").alias("often"))
    rare = asked.join(often, "sought").groupBy("item_id", "place").agg(F.max("often").alias("often"))
    w = Window.partitionBy("item_id")
    ranked = places.join(rare, ["item_id", "place"], "left")
    ranked = ranked.withColumn("all", F.count("*").over(w)).withColumn("words", F.count_if("worded").over(w))
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("worded"), "often", "place")))
    bare = F.col("all") - F.col("words")
    needed = F.ceil(F.col("all") * COVER) - bare  # windows with words that a holder has at least
    kept = ranked.where((F.col("worded") & (F.col("rank") <= F.col("words") - F.greatest(needed, F.lit(1)) + 1)) | (~F.col("worded") & (needed <= 0)))
    return asked.join(kept.select("item_id", "place"), ["item_id", "place"]).select("item_id", "sought").distinct()


def held_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (of the document), item_id, n (items alike), windows (of the item, found), coverage and agreement of every pair found, of its
    best occurrence."""
    classes = written(_classes(benchmark), "classes")
    items = written(windows(classes, "item_id").distinct(), "windows")
    small = items.count() <= BROADCAST_WINDOWS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    texts = docs.selectExpr(f"{ROW_KEY} AS key", "text").where("text IS NOT NULL")
    found = _inlined(_templates(texts, "key"), "key", _SOUGHT, _FOLDED, "explode").withColumnRenamed("col", "sought")
    pairs = written(found.join(near(_sought(items)), "sought").select("key", "item_id").distinct(), "pairs")
    keys = pairs.select("key").distinct()
    few = keys.count() <= BROADCAST_KEYS
    asked = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    items = items.drop("sought", "worded").join(items.groupBy("item_id").agg(F.countDistinct("place").alias("of_item")), "item_id")
    items = items.withColumnsRenamed({c: f"item_{c}" for c in ("place", *_SLOTS)})
    hits = windows(_templates(asked, "key"), "key").drop("sought", "worded").join(near(items), "hash").join(F.broadcast(pairs) if few and pairs.count() <= BROADCAST_KEYS else pairs, ["key", "item_id"], "left_semi")
    wide = f"(of_item + {WINDOW - 1})"
    spots = ["0L", "place - item_place", f"floor((place - item_place) / {wide})", f"floor((place - item_place) / {wide} + 0.5)"]
    spots = F.expr("array(" + ", ".join(f"named_struct('kind', {k}, 'at', cast({x} AS bigint))" for k, x in enumerate(spots)) + ")")
    hits = hits.select("key", "item_id", "of_item", "item_place", *_SLOTS, *(f"item_{c}" for c in _SLOTS), F.inline(spots))
    spot = ["key", "item_id", "of_item", "kind", "at"]
    hits = hits.groupBy(*spot, "item_place", *_SLOTS, *(f"item_{c}" for c in _SLOTS)).agg(F.count("*").alias("n"))
    hits = written(hits, "hits")
    covered = hits.groupBy(*spot).agg(F.countDistinct("item_place").alias("windows")).withColumn("coverage", F.col("windows") / F.col("of_item"))
    covered = covered.where((F.col("kind") == 0) | (F.col("coverage") >= COVER))
    values = hits.select(*spot, "n", F.inline(F.array(*[F.struct(F.col(f"item_{c}").alias("a"), F.col(c).alias("b")) for c in _SLOTS]))).where("a <> 0")
    values = values.groupBy(*spot, "a", "b").agg(F.sum("n").alias("n"))
    values = values.groupBy(*spot, "a").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    agreed = values.groupBy(*spot).agg((F.sum("most") / F.sum("n")).alias("agreement"))
    both = covered.join(agreed, spot, "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
    best = F.max(F.struct(_passes().alias("passes"), "coverage", "agreement", "windows"))
    told = both.groupBy("key", "item_id").agg(best.alias("best")).select("key", "item_id", "best.windows", "best.coverage", "best.agreement")
    return told.join(near(classes.select("item_id", F.col("n"))), "item_id")


def _passes() -> Column:
    return (F.col("coverage") >= COVER) & (F.col("agreement") >= AGREE) & ((F.col("windows") >= LEAST) | (F.col("coverage") == 1))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document that holds an item: its key, the item covered best, its coverage and agreement, and how many are held."""
    held = held_items(docs, benchmark).where(_passes())
    best = F.max(F.struct("coverage", "agreement", (-F.col("item_id")).alias("less")))
    return held.groupBy("key").agg(best.alias("best"), F.sum("n").alias("n_items")).selectExpr(
        "key", "-best.less AS item_id", "best.coverage AS coverage", "best.agreement AS agreement", "n_items"
    )


def flag_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row's doc_id with contaminated and, if so, what it holds. Texts aren't shuffled."""
    flagged = written(contaminated(docs, benchmark), "flagged")
    joined = docs.selectExpr("doc_id", f"{ROW_KEY} AS key").join(flagged, "key", "left")
    return joined.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "coverage", "agreement", F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, whole, of documents that hold no item. The flagged keys are written first, so that their size is known to the join."""
    flagged = written(contaminated(docs, benchmark).select(F.col("key").alias("_flagged")), "flagged")
    return docs.withColumn("_key", F.expr(ROW_KEY)).join(flagged, F.col("_key") == F.col("_flagged"), "left_anti").select(docs.columns)


def op2_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document, flagged if it holds a benchmark item."""
    return flag_contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
