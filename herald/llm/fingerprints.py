"""Operator 6: document fingerprints by winnowing (DataFrame functions only).

Every run of ``GRAM`` words is hashed; in each window of ``WINDOW`` consecutive hashes the smallest is selected, the
rightmost one of equals, with its position. Two texts that share ``WINDOW + GRAM - 1`` words in a row therefore share a
selected hash, and no shared run below ``GRAM`` words counts.

A hash (43 bits) and its position are packed into one number, the position reversed in the lower 20 bits, so that the
smallest number of a window is its smallest hash, rightmost first; a window's smallest grows from those of 1, 2, 4 and
8 places. A text of more than 2**20 runs has (hash, -position) pairs in the numbers' place: the same result, slower.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.llm.common import place_among, table, words

GRAM = 5
#: A power of two.
WINDOW = 16
PLACES = 20
BITS = 43
#: Rows of one range of the document order; the order is dealt by ranges, so no task sees all rows.
RANGE_ROWS = 2000
#: Ranges at most, as their edges stand in the plan. From 260 million rows on, a range has more rows, and its task spills.
RANGES = 1 << 17


def winnow(text: Column, places: int = PLACES) -> Column:
    """Array of (hash, position), by position; of a text of fewer than GRAM words, one; of no words, none."""
    hashed = F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), _grams)[0]
    return F.transform(F.array(hashed), lambda g: F.when(F.size(g) > 1 << places, _pairs(g)).otherwise(_packed(g, places)))[0]


def _grams(w: Column) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - GRAM, F.lit(0)))
    made = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + k) for k in range(GRAM)]), 64 - BITS))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(made)


def _packed(grams: Column, places: int) -> Column:
    mask = (1 << places) - 1
    least = F.transform(grams, lambda h, i: F.shiftleft(h, places).bitwiseOR(F.lit(mask) - i))
    done = 1
    while done < WINDOW:
        least = F.transform(F.array(least), _merge(done))[0]
        done *= 2
    return F.transform(F.array_distinct(least), lambda x: F.struct(F.shiftright(x, places).alias("hash"), (F.lit(mask) - x.bitwiseAND(F.lit(mask))).cast("int").alias("position")))


def _merge(done: int):
    """The smallest of twice as many places, from those of ``done``; where fewer follow, the last whole window's."""
    return lambda a: F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - done, F.lit(1))), lambda x, i: F.least(x, F.get(a, F.least(i + done, F.size(a) - 1))))


def _pairs(grams: Column) -> Column:
    each = F.transform(grams, lambda h, i: F.struct(h.alias("hash"), (-i).alias("back")))

    def chosen(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(pairs) - WINDOW + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda s: F.array_min(F.slice(pairs, s, WINDOW))))

    return F.transform(F.transform(F.array(each), chosen)[0], lambda x: F.struct(x["hash"].alias("hash"), (-x["back"]).alias("position")))


def hashes(fingerprint: Column) -> Column:
    """The set of selected hashes, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, 1.0).otherwise(shared / either)


def shown(fingerprint: Column) -> Column:
    """position:hash, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", x["position"].cast("string"), F.hex(x["hash"]))), ",")


def _ranges(documents: DataFrame, range_rows: int) -> list[int]:
    """Ids that cut the rows into ranges of about ``range_rows`` rows, ascending; one that very many rows share stands more than once."""
    parts = min(RANGES, documents.count() // range_rows)
    if parts < 2:
        return []
    share = F.from_json(F.lit("[" + ",".join(str(k / parts) for k in range(1, parts)) + "]"), "array<double>")
    return sorted(documents.agg(F.percentile_approx("key", share, F.lit(min(1 << 21, 20 * parts)))).first()[0] or [])


def _part(key: Column, edges: list[int]) -> Column:
    """The range of a row: the edges below its id, and, of the edges at its id, as many as its text's hash is far."""
    below, times = place_among(key, [e + 1 for e in edges]), place_among(key, edges)
    many = times - below
    far = F.floor((F.col("hash") / 2.0**64 + 0.5) * many).cast("int") + 1
    return below + F.when(many > 0, F.least(far, many)).otherwise(0)


def pairs(documents: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, object]:
    """doc_id, text, next (the text that follows in ascending doc_id; the last row's: the first), copy; and the window.

    Rows are dealt to ranges of (doc_id, hash of the text), cut at approximate percentiles of the ids and, for an id that
    fills several ranges, evenly by hash; they are ordered inside each range. Every range also gets a copy of the first row
    of the range after it (one row a range, ``copy`` = 1), so the texts are shuffled once and no task holds more than a
    range. The window orders a range. Null ids come first, cut as any other id; rows with equal ids follow each other by
    hash and text. Null texts count as empty.
    """
    # null ids: below all others
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key")).withColumn("hash", F.xxhash64("text"))
    dealt = keyed.withColumn("part", _part(F.col("key"), _ranges(keyed.select("key"), range_rows)))
    firsts = dealt.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("first"))
    before = F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.partitionBy()))
    ends = firsts.select("part", "first.key", "first.hash", before.alias("to"))  # one row per range
    heads = dealt.join(F.broadcast(ends), ["part", "key", "hash"]).groupBy("to", "doc_id", "key", "hash").agg(F.min("text").alias("text"))
    copies = heads.select("doc_id", "text", "key", "hash", F.col("to").alias("part"), F.lit(1).alias("copy"))
    window = W.partitionBy("part").orderBy("copy", "key", "hash", "text")
    return dealt.withColumn("copy", F.lit(0)).unionByName(copies).withColumn("next", F.lead("text").over(window)), window


def edited(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, next_hashes (the hash set of the next document).

    ``edited``: the last half of the code points (rounded down) replaced by the first as many, or all, of the next text.
    Null texts count as empty; equal rows have equal fingerprints and follow each other; a table of one row has itself
    as next; an empty one gives no rows; other columns are not used, whatever their names.
    """
    paired, window = pairs(documents, range_rows)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.col("next"), F.lit(1), half))
    made = paired.withColumn("edited", F.when(F.col("copy") == 0, changed)).drop("next").withColumns({"fingerprint": winnow(F.col("text")), "edited_fingerprint": winnow(F.col("edited"))})
    return made.withColumn("next_hashes", F.lead(hashes(F.col("fingerprint"))).over(window)).where("copy = 0").drop("copy", "key", "hash", "part")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = edited(table(spark, sf_dir, "documents"))
    own = hashes(F.col("fingerprint"))
    return made.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"),
        shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), likeness(own, hashes(F.col("edited_fingerprint"))).alias("near_edited"), likeness(own, F.col("next_hashes")).alias("near_next"),
    )
