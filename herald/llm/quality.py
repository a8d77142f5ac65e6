"""Operator 3: quality rules (DataFrame functions only).

Base rules count words, symbols, repeated lines and repeated 5-word windows of a whole text. The method on top is a
hashed n-gram log-likelihood ratio: words and word pairs are hashed to ``BUCKETS`` features, whose frequencies make two
multinomials, one of a trusted target (documents labelled of good quality) and one of the whole raw corpus. A
document's score is the mean of log(target / raw) over its features, so length does not matter, and every document is
kept or not by one fixed threshold, with no random draw. The target's multinomial is joined by a share PRIOR of features
drawn as in the raw corpus, so that a feature which the target lacks says no more than log(PRIOR / (1 + PRIOR)). All of
it is made of shares: a table and many copies of it give the same scores. PRIOR and THRESHOLD were fitted together on
labels held out of the target (see README).

Bounds: the trusted target is at most ``TRUSTED`` labelled documents (in a hashed order of doc_id), broadcast as ids;
the raw multinomial counts all documents. The model is one array of BUCKETS numbers, whatever the corpus.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.llm.common import table, words

BUCKETS = 10_000
TRUSTED = 20_000
#: Mean log-ratio from which a document is kept. Text like the corpus scores about 0; text unlike the target, below.
THRESHOLD = -0.05
#: Weight of the raw corpus in the target's multinomial, as a share of the target's own features.
PRIOR = 0.5
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20
SYMBOLS = r"[#*$%&|<>]"
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _after(w: Column) -> Column:
    """The words that follow each word; one fewer."""
    return F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))


def ratios(documents: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> list[float]:
    """log(target / raw) of each feature, the target joined by a share PRIOR of the raw corpus; 0 for features that no document has."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted)
    docs = documents.select("doc_id", words(F.col("text")).alias("words"))
    marked = docs.join(F.broadcast(good.withColumn("good", F.lit(1))), "doc_id", "left").select("words", F.coalesce("good", F.lit(0)).alias("good"))
    pairs = marked.select("good", F.inline(F.arrays_zip(F.col("words").alias("a"), _after(F.col("words")).alias("b"))))
    features = pairs.select("good", F.explode(F.array(_bucket("a"), F.when(F.col("b").isNotNull(), _bucket("a", "b")))).alias("bucket"))
    counts = {r["bucket"]: (r["n"], r["g"]) for r in features.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("g")).collect()}
    raw, target = sum(n for n, _ in counts.values()), sum(g for _, g in counts.values())
    if not target:
        return [0.0] * BUCKETS
    # quotients of whole numbers alone: they do not change if all counts are multiplied
    return [math.log(((g / target) / (n / raw) + PRIOR) / (1 + PRIOR)) if n else 0.0 for n, g in (counts.get(k, (0, 0)) for k in range(BUCKETS))]


def _score(w: Column, logs: list[float]) -> Column:
    """Mean log-ratio of the features of a word array; null where there is none."""
    model = F.from_json(F.lit(json.dumps([round(x, 6) for x in logs])), "array<double>")  # folded to one constant
    pair = lambda a, b: F.when(b.isNotNull(), F.get(model, _bucket(a, b))).otherwise(0.0)
    each = F.zip_with(w, _after(w), lambda a, b: F.get(model, _bucket(a)) + pair(a, b))
    return F.when(F.size(w) > 0, F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / (2 * F.size(w) - 1))


def _repeated_words(w: Column, hashes: Column) -> Column:
    """Words that lie in a 5-word window which the text has twice or more.

    Windows are hashed, from the hashes of words; only a text in which a hash occurs twice sorts its windows by hash, and
    compares the words of neighbours.
    """
    last = F.size(w) - WINDOW
    at = F.sequence(F.lit(0), last)
    hashed = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    ordered = F.sort_array(F.transform(at, lambda i: F.struct(hashed(i).alias("hash"), i.alias("at"))))
    same = lambda x, y: ((x["hash"] == y["hash"]) & (F.slice(w, x["at"] + 1, WINDOW) == F.slice(w, y["at"] + 1, WINDOW))).eqNullSafe(True)
    twice = lambda o: F.sort_array(F.transform(F.filter(o, lambda x, i: same(x, F.get(o, i - 1)) | same(x, F.get(o, i + 1))), lambda x: x["at"]))
    new_words = lambda t: F.transform(t, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(t, i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(F.transform(F.array(F.transform(F.array(ordered), twice)[0]), new_words)[0], F.lit(0), lambda acc, x: acc + x)
    return F.when(last < 1, 0).when(F.size(F.array_distinct(F.transform(at, hashed))) == last + 1, 0).otherwise(covered)


def rules(documents: DataFrame, logs: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    A null text has no words and fails, as does an empty one; rows that repeat are judged alike, and so are ties: a
    score equal to the threshold is kept; a very long text is judged whole; an empty table gives no rows; input columns
    with the names of the added ones are replaced, all others stay.
    """
    own = documents.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    text, w, hashes = F.coalesce(F.col("text"), F.lit("")), F.col("words"), F.col("hashes")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = own.withColumns({"words": words(F.col("text")), "lines": lines}).withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x))).select(
        "row",
        F.size(w).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(w, hashes).cast("bigint").alias("n_repeat_words"),
        _score(w, logs).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    kept = [c for c in documents.columns if c.lower() not in (a.lower() for a in ADDED)]
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], *ADDED)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules(documents, ratios(documents, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
