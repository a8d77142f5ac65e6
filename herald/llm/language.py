"""Operator 8: language identification with a linear-chain conditional random field.

The words of a text (runs of letters, lower-cased) are a sequence whose labels are languages. A word's features are its
prefixes and suffixes of one to three letters, all its letter trigrams (a text without spaces is a word of any length),
and a lexicon entry if it is frequent among the training words; features are hashed to ``HASHED`` weights a language.
Transitions between the languages of neighbouring words are learned too. Forward-backward over the whole text gives each
word's posterior; a text's language is the one with the largest mean posterior over its words, which is also the score,
so code-switched texts get their main language and a lower score.

Forward-backward works on runs of ``RUN`` words side by side: the product of a run's steps is a matrix, and with those
messages pass from run to run of a text, in both directions, before they pass from word to word. The result is that of
one chain over the text, whatever its length.

Training: ``PER_LANGUAGE`` documents of each language at most (those of the least hashes of id and text), of ``LONGEST``
code points at most, none of them held out; every word of such a text has the text's label.
Training sequences are runs of at most ``RUN`` words. Every language that stands in ``lang`` is learned, so the model
and the training grow with the number of languages, but not with the table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from herald.llm.common import BROADCAST_KEYS, cut, fresh, small_batches, table

HASHED = 1 << 16
LEXICON = 4000
PER_LANGUAGE = 300
LONGEST = 20_000
RUN = 64
ROUNDS = 30
RATE = 0.5
DECAY = 1e-4
#: Letters whose features are held at once; a longer word is taken in slices.
SLICE = 1 << 20
#: Posteriors (steps * runs * languages) that training holds at once.
HELD = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    # the pattern also takes numbers that are no digits, as fractions are
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def _hashed(kind: int, *letters: np.ndarray) -> np.ndarray:
    """Weight rows of features: a kind and some letters."""
    h = np.full(len(letters[0]), kind + 1, np.uint64)
    for x in letters:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(40)).astype(np.int64) % HASHED


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _trigrams(points: np.ndarray) -> np.ndarray:
    return _hashed(0, points[:-2], points[1:-1], points[2:])


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the words' features, and the position of each one's word."""
    points = _points("".join(f"<{w}>" for w in words))
    sizes = np.array([len(w) for w in words])
    begins = np.r_[0, np.cumsum(sizes + 2)[:-1]]
    owners = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(owners)) + 2 * owners  # first letters of trigrams
    rows, of = [_hashed(0, points[at], points[at + 1], points[at + 2])], [owners]
    letter = lambda place, k: np.where(sizes > k, points[place], 0).astype(np.uint64)
    starts = [letter(begins + 1 + np.minimum(k, sizes - 1), k) for k in range(3)]
    ends = [letter(begins + sizes - np.minimum(k, sizes - 1), k) for k in range(3)]
    for k in range(1, 4):
        rows += [_hashed(k, *starts[:k]), _hashed(3 + k, *ends[:k])]
        of += [np.arange(len(words))] * 2
    entries = np.array([lexicon.get(w, -1) for w in words])
    listed = np.flatnonzero(entries >= 0)
    return np.concatenate([*rows, HASHED + entries[listed]]), np.concatenate([*of, listed])


def _chained(e: np.ndarray, t: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages that reach each run from the runs before it in its text, and from those after it."""
    steps, many, k = e.shape
    through = np.where(first[:, None, None], np.eye(k, dtype=e.dtype), t) * e[0][:, None, :]
    for i in range(1, steps):
        live = np.flatnonzero(lengths > i)
        if len(live):
            moved = (through[live].reshape(-1, k) @ t).reshape(-1, k, k) * e[i][live][:, None, :]
            through[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
    place = np.arange(many) - np.maximum.accumulate(np.where(first, np.arange(many), 0))
    order = np.argsort(place, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(place[order])) + 1)
    into, onward = np.ones((many, k), e.dtype), np.ones((many, k), e.dtype)
    for runs_ in levels[1:]:
        found = np.einsum("rk,rkl->rl", into[runs_ - 1], through[runs_ - 1])
        into[runs_] = found / found.sum(axis=1, keepdims=True)
    for runs_ in reversed(levels[1:]):
        found = np.einsum("rkl,rl->rk", through[runs_], onward[runs_])
        onward[runs_ - 1] = found / found.sum(axis=1, keepdims=True)
    return into, onward


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False, first: np.ndarray | None = None):
    """Forward-backward over runs side by side. scores: (steps, runs, languages), log; each run uses its first ``lengths``
    steps. ``first``: whether a run begins its text; others go on from the run before them; without it, all begin one.
    -> posteriors of the same shape (zero beyond the ends), and the summed pair posteriors inside the runs."""
    steps, many, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(transitions)
    live = np.arange(steps)[:, None] < lengths[None, :]
    start, back = np.ones((many, k), e.dtype), np.ones((many, k), e.dtype)
    if first is not None and not first.all():
        into, back = _chained(e, t, lengths, first)
        start = np.where(first[:, None], start, into @ t)
    forward = np.empty_like(e)
    forward[0] = start * e[0]
    forward[0] /= forward[0].sum(axis=1, keepdims=True)
    for i in range(1, steps):
        a = (forward[i - 1] @ t) * e[i]
        forward[i] = a / a.sum(axis=1, keepdims=True)
    out = np.zeros_like(e)
    joint = np.zeros((k, k))
    for i in range(steps - 1, -1, -1):
        g = forward[i] * back
        g /= g.sum(axis=1, keepdims=True)
        out[i] = np.where(live[i][:, None], g, 0)
        if i:
            ahead = e[i] * back
            if pairs:
                before, after = forward[i - 1][live[i]], ahead[live[i]]
                joint += t * ((before / ((before @ t) * after).sum(axis=1, keepdims=True)).T @ after)
            ahead = ahead @ t.T
            ahead /= ahead.sum(axis=1, keepdims=True)
            back = np.where(live[i][:, None], ahead, back)
    return out, joint


def runs(codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in a row (owners: their texts, ascending) laid out as runs: (steps, runs) of codes, lengths, owner of each run."""
    n = len(codes)
    first = np.r_[True, owners[1:] != owners[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place = (np.arange(n) - start) % RUN
    run = np.cumsum(place == 0) - 1
    laid = np.zeros((min(RUN, int(place.max()) + 1), int(run[-1]) + 1), np.int64)
    laid[place, run] = codes
    return laid, np.bincount(run), owners[place == 0]


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    #: Which weight rows are of features of the training words.
    seen: np.ndarray


def _summed(weights: np.ndarray, rows: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
    """(many, languages): the weights of the rows, summed by what they are of."""
    return np.stack([np.bincount(of, weights[rows, j], many) for j in range(weights.shape[1])], axis=1)


def word_scores(words: list[str], model: Model, known: np.ndarray | None = None) -> np.ndarray:
    """(words, languages): the score of each language for each word, the sum over its features. ``known``: gets the share
    of each word's features that training words have too."""
    out = np.zeros((len(words), len(model.languages)))
    ends = np.cumsum([min(len(w), SLICE) for w in words]) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(words)]
    for a, z in zip(edges, edges[1:]):
        # of a very long word: a short one with its affixes, then what its trigrams differ in, in slices
        part = [w if len(w) <= SLICE else w[:3] + w[-3:] for w in words[a:z]]
        rows, of = features(part, model.lexicon)
        out[a:z] = _summed(model.weights, rows, of, len(part))
        if known is not None:
            known[a:z] = np.bincount(of, model.seen[rows], len(part)) / np.bincount(of, minlength=len(part))
        for k, (w, short) in enumerate(zip(words[a:z], part)):
            if w is not short:
                marked, hits = f"<{w}>", 0
                for at in range(0, len(w), SLICE):
                    found = _trigrams(_points(marked[at : at + SLICE + 2]))
                    out[a + k] += model.weights[found].sum(axis=0)
                    hits += int(model.seen[found].sum())
                if known is not None:
                    known[a + k] = hits / len(w)
                out[a + k] -= model.weights[_trigrams(_points(f"<{short}>"))].sum(axis=0)
    return out


def train(texts: list[str], labels: list[str]) -> Model:
    """Fit by gradient ascent on the conditional likelihood (adaptive steps), in a fixed order: reruns agree."""
    languages = sorted(set(labels))
    label = {x: i for i, x in enumerate(languages)}
    words = [words_of(t) for t in texts]
    lexicon = {w: i for i, (w, _) in enumerate(sorted(Counter(w for ws in words for w in ws).items(), key=lambda x: (-x[1], x[0]))[:LEXICON])}
    k = len(languages)
    weights, transitions = np.zeros((HASHED + LEXICON, k)), np.zeros((k, k))
    owners = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    if not len(owners):
        return Model(languages, lexicon, weights, transitions, np.zeros(len(weights), bool))
    codes, known = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    rows, word_of = features(list(known), lexicon)
    laid, lengths, owner = runs(codes, owners)
    live = np.arange(len(laid))[:, None] < lengths[None, :]
    truth = np.array([label[x] for x in labels])[owner]
    wanted = np.zeros((len(known), k))
    np.add.at(wanted, (laid[live], np.broadcast_to(truth, laid.shape)[live]), 1.0)
    wanted_pairs = np.zeros((k, k))
    np.add.at(wanted_pairs, (truth, truth), np.maximum(lengths - 1, 0))
    total = live.sum()
    width = max(1, HELD // (len(laid) * k))
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    for _ in range(ROUNDS):
        scores = _summed(weights, rows, word_of, len(known))
        gradient, joint = wanted.copy(), np.zeros((k, k))
        for at in range(0, laid.shape[1], width):
            part, alive = laid[:, at : at + width], live[:, at : at + width]
            found, some = posteriors(scores[part], lengths[at : at + width], transitions, pairs=True)
            joint += some
            for j in range(k):
                gradient[:, j] -= np.bincount(part[alive], found[alive][:, j], len(known))
        step = np.stack([np.bincount(rows, gradient[word_of, j], len(weights)) for j in range(k)], axis=1) / total - DECAY * weights
        turn = (wanted_pairs - joint) / total - DECAY * transitions
        seen_w += step**2
        seen_t += turn**2
        weights += RATE * step / np.sqrt(seen_w)
        transitions += RATE * turn / np.sqrt(seen_t)
    return Model(languages, lexicon, weights, transitions, np.bincount(rows, minlength=len(weights)) > 0)


def training_rows(documents: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and labels of the sample, in the order of doc_id: ``per_language`` documents of a language at most, whatever
    their ids (null or repeated ones too), those of the least hashes of id and text. Rows that repeat count once.

    A first look counts a language's different documents, about; then only hashes up to some four times the wanted number
    pass, equal ones are merged in each task before a shuffle, and the rest is ordered: no task gets more than a few
    thousand documents of a language, however large the table and whatever share of it one document has."""
    hashed = F.xxhash64("doc_id", "text")
    learnable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.char_length("text") <= LONGEST)).select("doc_id", "text", F.col("lang").alias("label"), hashed.alias("hash"))
    rates = cut(learnable.groupBy(F.col("label").alias("of")).agg((4.0 * per_language / F.approx_count_distinct("hash")).alias("rate")))
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_KEYS else rates  # one row a language; a shuffle would deal all texts by language
    passed = learnable.join(rates, F.col("label") == F.col("of")).where((F.col("hash") / 2.0**64 + 0.5) <= F.col("rate"))
    once = passed.groupBy("label", "hash").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    chosen = once.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("hash"))).where(F.col("place") <= per_language)
    # null ids come first (the column may hold some)
    rows = sorted(chosen.select("row.doc_id", "row.text", "label").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["label"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    return judged(texts, model)[:2]


def judged(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and the share of its words that look like words of any learned language: those
    half of whose features or more training words have. That share does not depend on how many languages there are."""
    words = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    shares = np.zeros((len(texts), max(1, len(model.languages))))
    familiar = np.zeros(len(texts))
    if total and model.languages:
        owners = np.repeat(np.arange(len(texts)), counts)
        codes, known = pd.factorize(np.fromiter((w for ws in words for w in ws), dtype=object, count=total))
        laid, lengths, owner = runs(codes, owners)
        first = np.r_[True, owner[1:] != owner[:-1]]
        alike = np.zeros(len(known))
        posterior, _ = posteriors(word_scores(list(known), model, alike)[laid], lengths, model.transitions, first=first)
        familiar = np.bincount(owners, alike[codes] >= 0.5, len(texts)) / np.maximum(counts, 1)
        summed = posterior.sum(axis=0)
        for j in range(shares.shape[1]):
            shares[:, j] = np.bincount(owner, summed[:, j], len(texts))
        shares /= np.maximum(counts, 1)[:, None]
    best = shares.argmax(axis=1)
    some = (counts > 0) & bool(model.languages)
    return [model.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, np.clip(shares.max(axis=1), 0, 1), 0.0), familiar


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per input row, rows that repeat alike.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned; ties go
    to the first language by name; a very long text is one chain, a very long word is scored in slices; an empty table
    gives no rows; other columns are not used, whatever their names.
    """
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = predict(list(b["text"]), sent.value)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    shape = "doc_id bigint, held_out boolean, lang_pred string, score double"
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(work, shape)


def labelled(documents: DataFrame, model: Model) -> tuple[DataFrame, str, str, str]:
    """The documents in all their columns, with three more, language, score and share of familiar words, and their names."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")
    names = fresh(documents, "lang_pred", "score", "familiar")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, judged(b.column(place).to_pylist(), sent.value))], [*b.schema.names, *names])

    added = [StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), DoubleType()))]
    return documents.mapInArrow(work, StructType([*documents.schema.fields, *added])), *names


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(*training_rows(documents)))
