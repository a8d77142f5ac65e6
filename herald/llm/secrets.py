"""Operator 7: secret scans with inferred format grammars.

Three base patterns find labelled credentials. Their values, a bounded sample of them, train one probabilistic automaton
for each pattern: a prefix tree of the values, over classes of characters, whose states are merged where their
frequencies of ending and of each next class agree within a Hoeffding bound.

A candidate is scored by how many bits a character the best format saves against characters drawn at random; a short
one pays for the unlikeliness of its end too. Base spans are scored as any other, but stay whatever their score. What
they leave of a text's runs of token characters is a candidate, from ``SHORTEST`` characters: first whole, then its
parts between ``=``, then between ``/`` and between ``.``, in both orders. It is added (kind ``format``) if it saves
enough and has a digit and a letter: numbers alone fit a format of hexadecimal digits. All scores are in the result.

Bound: at most ``SAMPLE`` distinct values a pattern, the first in a hashed order, each of ``LONGEST`` characters or
fewer. All documents are searched for them, and all candidates are scored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.llm.common import small_batches, table

# The base kinds, in this order.
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
JAVA = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""",
    "access": r"(AKIA[A-Z0-9]{12,})",
    "hex": r"([0-9a-f]{32,})",
}

SAMPLE = 1000
LONGEST = 128
#: Confidence parameter of the merge test; larger keeps more states apart.
ALPHA = 0.05
#: Bits a character that a format must save.
SAVED = 1.5
#: Characters of a candidate at least; below LONG the end of a format counts too.
SHORTEST, LONG = 8, 16
#: Scores that a worker keeps; emptied when full.
KEPT_SCORES = 100_000
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
_assign, _access, _hex = re.compile(ASSIGN), re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
_RANDOM_BITS = math.log2(67)
_CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")}
_SIZES = {"d": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_END = ""
#: What a candidate neither begins nor ends with, and what splits one.
_EDGE, SPLITS = ".=-_/+", ("=", "/", ".")


class Grammar:
    """A probabilistic automaton: of each state, the count of each next class (or the end) and the state it leads to."""

    def __init__(self, values: list[str]) -> None:
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.next: list[dict[str, int]] = [{}]
        for value in values:
            at = 0
            for c in value:
                k = _CLASSES.get(c, c)
                self.count[at][k] += 1
                if k not in self.next[at]:
                    self.next[at][k] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                at = self.next[at][k]
            self.count[at][_END] += 1
        self._infer()

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states, and those that both lead to by the same classes, have compatible frequencies."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            ca, cb = self.count[a], self.count[b]
            na, nb = sum(ca.values()), sum(cb.values())
            if not na or not nb:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if any(abs(ca.get(k, 0) / na - cb.get(k, 0) / nb) > bound for k in {*ca, *cb}):
                return False
            pending += [(self.next[a][k], self.next[b][k]) for k in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a state that still roots a tree, and all below it, to another state."""
        pending = [(into, tree)]
        while pending:
            into, tree = pending.pop()
            for k, n in self.count[tree].items():
                self.count[into][k] += n
            for k, child in self.next[tree].items():
                if k in self.next[into]:
                    pending.append((self.next[into][k], child))
                else:
                    self.next[into][k] = child

    def _infer(self) -> None:
        """Red states stay; a blue state (a child of a red one) is merged with the first red one alike, or turns red."""
        red = [0]
        settled = {0}
        while True:
            blue = [(r, k, b) for r in red for k, b in self.next[r].items() if b not in settled]
            if not blue:
                break
            parent, k, b = max(blue, key=lambda x: (sum(self.count[x[2]].values()), x[1]))  # the best supported first
            for r in red:
                if self._alike(r, b):
                    self.next[parent][k] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
                settled.add(b)
        names = {s: i for i, s in enumerate(red)}
        self.ends = [math.log2((sum(self.count[s].values()) + 1) / n) if (n := self.count[s].get(_END, 0)) else math.inf for s in red]
        self.bits = []  # of each state: class -> (cost of a character in bits, state)
        for s in red:
            total = sum(self.count[s].values()) + 1
            self.bits.append({k: (math.log2(total / n) + math.log2(_SIZES.get(k, 1)), names[self.next[s][k]]) for k, n in self.count[s].items() if k != _END})
        del self.count, self.next

    def saved(self, value: str) -> float:
        """Bits a character saved against characters at random; minus infinity for a value the grammar does not make."""
        at, cost = 0, 0.0
        for c in value:
            step = self.bits[at].get(_CLASSES.get(c, c))
            if step is None:
                return -math.inf
            cost += step[0]
            at = step[1]
        if len(value) < LONG:
            cost += self.ends[at]
        return _RANDOM_BITS - cost / len(value)


def learn(documents: DataFrame, sample: int = SAMPLE) -> dict[str, Grammar]:
    """A grammar for each base kind that has values, from one reading of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hints = {"assign": text.rlike("(?i)pass|secret|token|api"), "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{32}")}
    none = F.array().cast("array<struct<kind:string,value:string>>")
    named = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    found = documents.select(F.inline(F.concat(*[F.when(hints[kind], named(kind, pattern)).otherwise(none) for kind, pattern in JAVA.items()])))
    distinct = found.where(F.char_length("value") <= LONGEST).distinct()
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))  # the first ones are kept before the shuffle
    values = defaultdict(list)
    for r in distinct.withColumn("place", place).where(F.col("place") <= sample).select("kind", "place", "value").collect():
        values[r["kind"]].append((r["place"], r["value"]))
    return {kind: Grammar([v for _, v in sorted(values[kind])]) for kind in KINDS if values[kind]}


class Scorer:
    """The best format's score of a string; the scores of short ones are remembered."""

    def __init__(self, grammars: dict[str, Grammar]) -> None:
        self.grammars = list(grammars.values())
        self.known: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        found = self.known.get(value)
        if found is None:
            found = max((g.saved(value) for g in self.grammars), default=-math.inf)
            if len(value) <= LONGEST:
                if len(self.known) >= KEPT_SCORES:
                    self.known.clear()
                self.known[value] = found
        return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, by start, then in the order of KINDS."""
    found = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    for m in _TOKEN.finditer(text):  # a run of 32 hex digits lies in such a token
        if m.end() - m.start() >= 32:
            found += [(h.start() + m.start(), 2, h.end() + m.start()) for h in _hex.finditer(m[0])]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _parts(text: str, start: int, end: int, splits: tuple[str, ...], score: Scorer, tried: dict[tuple[int, int], float]) -> set[tuple[int, int]]:
    """The accepted candidates between two places: the whole, or else those of its parts. All scores go to ``tried``."""
    while start < end and text[start] in _EDGE:
        start += 1
    while start < end and text[end - 1] in _EDGE:
        end -= 1
    if end - start < SHORTEST:
        return set()
    tried[start, end] = saved = score(text[start:end])
    if saved >= SAVED and _MIXED.match(text, start, end):
        return {(start, end)}
    out: set[tuple[int, int]] = set()
    for k, mark in enumerate(splits):
        if text.find(mark, start, end) < 0:
            continue
        at = start
        for piece in text[start:end].split(mark):
            out |= _parts(text, at, at + len(piece), splits[:k] + splits[k + 1 :], score, tried)
            at += len(piece) + 1
        if mark == "=":
            # what follows the first "=", in one piece: a value may hold the mark itself
            out |= _parts(text, text.index(mark, start, end) + 1, end, (), score, tried)
            break
    return out


def added_spans(text: str, base: list[tuple[int, str, int]], score: Scorer) -> tuple[list[tuple[int, str, int]], dict[tuple[int, int], float]]:
    """(start, "format", end) of what base spans leave of tokens, or of its parts, if some format's likelihood stands out
    for it; and the score of every candidate."""
    tried: dict[tuple[int, int], float] = {}
    found: set[tuple[int, int]] = set()
    taken = iter(sorted((a, b) for a, _, b in base))
    span = next(taken, None)
    for m in _RUN.finditer(text):
        at = m.start()
        while span and span[0] < m.end():
            if span[1] > at:
                found |= _parts(text, at, span[0], SPLITS, score, tried)
                at = span[1]
            if span[1] > m.end():
                break
            span = next(taken, None)
        found |= _parts(text, at, m.end(), SPLITS, score, tried)
    out: list[tuple[int, str, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):  # the longer of two that overlap
        if not out or start >= out[-1][2]:
            out.append((start, "format", end))
    return out, tried


def scored(text: str, score: Scorer) -> tuple[list[dict], list[dict]]:
    """The spans of a text with their scores, by start, then kind, and its other candidates with theirs."""
    base = base_spans(text)
    added, tried = added_spans(text, base, score)
    order = {k: i for i, k in enumerate([*KINDS, "format"])}
    finite = lambda x: None if x == -math.inf else x
    value = lambda kind, a, e: _assign.match(text, a, e)[2] if kind == "assign" else text[a:e]
    spans = [{"kind": k, "start": a, "end": e, "score": finite(score(value(k, a, e)))} for a, k, e in sorted(base + added, key=lambda s: (s[0], order[s[1]]))]
    taken = {(a, e) for a, _, e in added}
    return spans, [{"start": a, "end": e, "score": finite(x)} for (a, e), x in sorted(tried.items()) if (a, e) not in taken]


def scan(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, score) in code points, base kinds and ``format``, by start, then kind;
    candidates: array of (start, end, score) of those that are no span. A score is null where no format makes the string.

    Null and empty texts have none; repeated rows are scanned alike; a very long text or token is scanned whole; of added
    spans that overlap the first stays, of those that begin together the longest; without any labelled credential nothing
    is added; an empty table gives no rows; other columns are not used, whatever their names.
    """
    small_batches(documents.sparkSession)
    grammars = learn(documents, sample)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(grammars)
        for b in batches:
            rows = [scored(text or "", score) for text in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": [r[0] for r in rows], "candidates": [r[1] for r in rows]})

    shape = "doc_id bigint, spans array<struct<kind:string,start:int,end:int,score:double>>, candidates array<struct<start:int,end:int,score:double>>"
    return documents.select("doc_id", "text").mapInPandas(work, shape)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.coalesce(F.format_number(s["score"], 3), F.lit("-"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    best = F.array_max(F.transform("candidates", lambda c: c["score"]))
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), shown(F.col("spans")).alias("scores"),
        F.size("candidates").cast("bigint").alias("n_candidates"), F.round(best, 3).alias("best_candidate"),
    )
