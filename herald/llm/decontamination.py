"""Operator 13: benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

1. *Statistics*: how often each word of the benchmark occurs in all documents (words are exploded, looked up in the
   benchmark's vocabulary and counted, partially before the shuffle).
2. *Probes*: a window is ``WINDOW`` consecutive words of an item (an item of fewer words is one window). Each window is
   searched by its two rarest words; a window with a word that no document has cannot occur.
3. *Index*: (text, term) -> the sorted positions of a probe's term in a document's text. Texts are known by 128 bits of
   hash, so the index holds one list for all copies of a text. The index is written to the shared checkpoint folder.
4. *Intersection*: lists are shifted by their probe's place in the item; an item lies at a shift of a text only if two
   probes of one window agree on it. Lists are dealt by text and item, never by term: a very common word is no hot key.
5. *Check*: the item is laid over the text at each shift that is left, and its words are compared one by one. So
   collisions of hashes cost time and never change a result.

``near`` returns proximity matches from the same index: windows whose two rarest words stand up to SLACK words further
apart, or closer, than in the item.

What is broadcast (vocabulary, probes, items, candidates) is counted first and joined by a shuffle beyond its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.llm.common import cut, fresh, table

#: Everything but digits, a to z and what is beyond ASCII stands between words, once A to Z are lower-case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Words by which the distance of two probes may differ in a proximity match.
SLACK = 5
#: Rows that may be broadcast: terms of the vocabulary (16 bytes each) and probes (about 50), and bytes of items and candidates.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")


def terms(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _texts(documents: DataFrame) -> DataFrame:
    """h1, h2 (hashes of the text) and text."""
    return documents.select(*_hashes(F.col("text")), F.col("text").alias("text"))


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(13), text).alias("h2")]


def _tokens(documents: DataFrame) -> DataFrame:
    """h1, h2, pos, term: every word of every text."""
    each = _texts(documents).select("h1", "h2", F.posexplode(terms(F.col("text"))).alias("pos", "word"))
    return each.select("h1", "h2", "pos", F.xxhash64("word").alias("term"))


def _small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows that stand in a checkpoint, to be broadcast if they are few enough; else Spark shuffles and splits skewed keys."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _small_bytes(rows: DataFrame, size: Column) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0).cast("bigint"))).first()[0]
    return F.broadcast(rows) if total <= BROADCAST_BYTES else rows


def items_of(benchmark: DataFrame) -> DataFrame:
    """content (an id), words, ids (of the items with just these words, as strings, null left out), n_items. Items without a word are left out."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), terms(F.col("text")).alias("words")).where(F.size("words") > 0)
    same = rows.groupBy("words").agg(F.collect_list("item").alias("ids"), F.count("*").alias("n_items"))
    return cut(same.withColumn("content", F.monotonically_increasing_id()))


def frequencies(documents: DataFrame, items: DataFrame) -> DataFrame:
    """term, count: of the items' words that documents have, over all documents."""
    vocabulary = cut(items.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("term")).distinct())
    counted = _tokens(documents).select("term")
    if vocabulary.count() <= BROADCAST_ROWS:
        return cut(counted.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").count())
    return cut(counted.groupBy("term").count().join(vocabulary, "term", "left_semi"))


def windows_of(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """content, size (words of a window), start, probes: array of (pos, term), the window's two rarest words (or its only one), by place in the item."""
    each = items.select("content", F.posexplode("words").alias("pos", "word")).select("content", "pos", F.xxhash64("word").alias("term"))
    known = each.join(counts, "term", "left").select("content", F.struct("pos", "term", F.coalesce("count", F.lit(0)).alias("count")).alias("w"))
    rows = known.groupBy("content").agg(F.array_sort(F.collect_list("w")).alias("ws")).withColumn("size", F.least(F.size("ws"), F.lit(window)))
    by_count = lambda s: F.array_sort(F.transform(F.slice("ws", s + 1, F.col("size")), lambda x: F.struct(x["count"].alias("count"), x["pos"].alias("pos"), x["term"].alias("term"))))
    starts = F.sequence(F.lit(0), F.size("ws") - F.col("size"))
    found = rows.select("content", "size", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), by_count(s).alias("rare")))).alias("x")).where("x.rare[0].count > 0")
    chosen = F.array_sort(F.transform(F.slice("x.rare", 1, 2), lambda r: F.struct(r["pos"].alias("pos"), r["term"].alias("term"))))
    return found.select("content", "size", "x.start", chosen.alias("probes"))


def index_of(documents: DataFrame, probes: DataFrame) -> DataFrame:
    """The index of the probes' terms: h1, h2, term, positions (ascending), one row for all copies of a text."""
    wanted = cut(probes.select("term").distinct())
    held = _tokens(documents).join(_small(wanted), "term", "left_semi")
    return cut(held.groupBy("h1", "h2", "term").agg(F.sort_array(F.collect_set("pos")).alias("positions")))


def _shifts(entries: Column, size: Column) -> Column:
    """Shifts on which two probes less than a window apart agree (or any, for a window of one word)."""
    nearer = lambda x, y: (x["shift"] == y["shift"]) & (y["pos"] - x["pos"] < size)
    agreed = lambda s: F.filter(s, lambda x, i: (size == 1) | nearer(x, F.get(s, i + 1)).eqNullSafe(True))
    return F.array_distinct(F.transform(F.transform(F.array(F.array_sort(entries)), agreed)[0], lambda x: x["shift"]))


def candidates(index: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """h1, h2, found: for each text the items that may lie in it: array of (shifts, words, size, ids, n_items)."""
    probes = cut(windows.select("content", "size", F.explode("probes").alias("p")).select("content", "size", F.col("p.pos").alias("at"), "p.term").distinct())
    shifted = F.transform("positions", lambda p: F.struct((p - F.col("at")).alias("shift"), F.col("at").alias("pos")))
    entries = index.join(_small(probes), "term").select("h1", "h2", "content", "size", shifted.alias("entries"))
    lists = entries.groupBy("h1", "h2", "content", "size").agg(F.flatten(F.collect_list("entries")).alias("entries"))
    agreed = lists.select("h1", "h2", "content", "size", _shifts(F.col("entries"), F.col("size")).alias("shifts")).where(F.size("shifts") > 0)
    shown = items.select("content", F.array_join("words", " ").alias("words"), "ids", "n_items")
    joined = agreed.join(_small_bytes(shown, F.octet_length("words") + 16 * F.col("n_items")), "content")
    return cut(joined.groupBy("h1", "h2").agg(F.collect_list(F.struct("shifts", "words", "size", "ids", "n_items")).alias("found")))


def _spans(words: Column, f: Column) -> Column:
    """Where runs of a window's words or more agree with an item: array of (lo, hi), positions in the text."""

    def at(shift: Column, item: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(words) - shift)
        # a shift comes from an index of this text or (by a collision) of another one
        others = F.filter(F.sequence(lo, hi - 1), lambda k: ~F.get(item, k).eqNullSafe(F.get(words, k + shift)))
        edges = F.concat(F.array(lo - 1), others, F.array(hi))
        runs = lambda e: F.transform(e, lambda p, i: F.struct((p + 1 + shift).alias("lo"), (F.get(e, i + 1) + shift).alias("hi")))
        found = F.filter(F.transform(F.array(edges), runs)[0], lambda r: r["hi"] - r["lo"] >= f["size"])
        return F.when(hi > lo, found).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))

    return F.transform(F.array(F.split(f["words"], " ")), lambda item: F.flatten(F.transform(f["shifts"], lambda s: at(s, item))))[0]


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    add = lambda acc, s: F.struct(F.greatest(acc["end"], s["hi"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(acc["end"], s["lo"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), begin, add, lambda acc: acc["n"])


def phrases(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents' columns and n_words, n_hit, n_items, items (their ids, ascending strings), contaminated.

    A null or empty text has no words, nor has an item's: no document holds it. Rows that repeat are judged alike; items
    that repeat count each, an item whose id is null counts and is not listed; two windows as rare as each other are
    searched alike, whichever is chosen; a very long text or item is searched whole; empty documents give no rows, an
    empty benchmark no hits; columns with the names of the added ones are replaced, all others stay.
    """
    items = items_of(benchmark)
    windows = cut(windows_of(items, frequencies(documents, items), window))
    index = index_of(documents, windows.select(F.explode("probes").alias("p")).select("p.term"))
    found = candidates(index, items, windows)
    rows = documents.select(F.struct("*").alias("row"), *_hashes(F.col("text")), terms(F.col("text")).alias("words"))
    size = F.aggregate("found", F.lit(0), lambda acc, f: acc + 64 + F.octet_length(f["words"]) + 4 * F.size(f["shifts"]) + 16 * F.size(f["ids"]))
    joined = rows.join(_small_bytes(found, size), ["h1", "h2"], "left")
    looked = lambda w: F.transform(F.coalesce("found", F.array()), lambda f: F.struct(_spans(w, f).alias("spans"), f["ids"].alias("ids"), f["n_items"].alias("n")))
    hits = F.filter(F.transform(F.array(F.col("words")), looked)[0], lambda h: F.size(h["spans"]) > 0)
    judged = joined.select("row", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"))
    added = judged.select(
        "row", "n_words", _covered(F.flatten(F.transform("hits", lambda h: h["spans"]))).alias("n_hit"), F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, h: acc + h["n"]).alias("n_items"),
        F.array_sort(F.flatten(F.transform("hits", lambda h: h["ids"]))).alias("items"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
    kept = [c for c in documents.columns if c.lower() not in ADDED]
    return added.select(*[F.col("row").getField(c).alias(c) for c in kept], *ADDED)


def near(documents: DataFrame, benchmark: DataFrame, slack: int = SLACK, window: int = WINDOW) -> DataFrame:
    """Proximity matches: the documents' columns and item (id, as string), start (of the window in the item), apart: the
    least difference, up to ``slack`` words, between the distance of the window's two rarest words in the text and that
    in the item. 0 is where they stand as in the item, whatever is between them. Windows of one word have none.

    Nulls, ties, repeats and empty tables are as in ``phrases``; clashing names get underscores.
    """
    items = items_of(benchmark)
    windows = cut(windows_of(items, frequencies(documents, items), window).where(F.size("probes") == 2))
    index = index_of(documents, windows.select(F.explode("probes").alias("p")).select("p.term"))
    each = cut(windows.select("content", "start", F.posexplode("probes").alias("which", "p")).select("content", "start", "which", F.col("p.pos").alias("at"), "p.term"))
    placed = index.join(_small(each), "term").select("h1", "h2", "content", "start", "which", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("shift"))
    # the first word's shifts stand in their own band, the second's in those of all that it may be near
    bands = F.when(F.col("which") == 0, F.array(F.floor(F.col("shift") / (slack + 1)))).otherwise(F.sequence(F.floor((F.col("shift") - slack) / (slack + 1)), F.floor((F.col("shift") + slack) / (slack + 1))))
    banded = placed.withColumn("band", F.explode(bands)).groupBy("h1", "h2", "content", "start", "band").agg(*[F.collect_set(F.when(F.col("which") == k, F.col("shift"))).alias(f"s{k}") for k in (0, 1)])
    least = F.array_min(F.flatten(F.transform("s0", lambda a: F.transform("s1", lambda b: F.abs(a - b)))))
    best = banded.withColumn("apart", least).where(F.col("apart") <= slack).groupBy("h1", "h2", "content", "start").agg(F.min("apart").alias("apart"))
    item, start, apart = fresh(documents, "item", "start", "apart")
    named = best.join(items.select("content", F.explode("ids").alias("item")), "content").select("h1", "h2", F.col("item").alias("_i"), F.col("start").alias("_s"), F.col("apart").alias("_a"))
    rows = documents.select(F.struct("*").alias("row"), *_hashes(F.col("text"))).join(named, ["h1", "h2"])
    return rows.select(*[F.col("row").getField(c).alias(c) for c in documents.columns], F.col("_i").alias(item), F.col("_s").alias(start), F.col("_a").alias(apart))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrases(documents, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')"
SQL = f"""with d as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents),
i as (select row_number() over () as iid, item_id, {_WORDS} as ws, least(len({_WORDS}), {WINDOW}) as size from benchmark where len({_WORDS}) > 0),
iw as (select iid, size, array_to_string(ws[s : s + size - 1], ' ') as g from (select *, unnest(range(1, len(ws) - size + 2)) as s from i)),
dw as (select rid, s, size, array_to_string(ws[s : s + size - 1], ' ') as g from (select rid, ws, size, unnest(range(1, len(ws) - size + 2)) as s from d, (select distinct size from i))),
m as (select distinct rid, iid, s, dw.size from dw join iw on dw.size = iw.size and dw.g = iw.g),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + size)) as p from m) group by 1),
held as (select rid, count(*) as n_items, string_agg(cast(item_id as string), ',' order by cast(item_id as string)) as ids from (select distinct rid, iid from m) x join i on x.iid = i.iid group by 1)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.rid = hit.rid left join held on d.rid = held.rid"""
