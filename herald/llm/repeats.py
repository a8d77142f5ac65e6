"""Operator 4: removal of long repeated byte strings, exactly.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a document of smaller doc_id, or
earlier in its own). Sorting the suffixes of all texts, as external induced sorting does, would write tens of bytes of
suffix tuples and common-prefix values for every byte of text; that does not fit the disk and CPU limits (see the
README), so the work is done on sampled suffixes instead, with the same results:

1. In every window of LENGTH bytes the ``GRAM``-byte string with the smallest hash, the first of equals, is its anchor:
   equal windows have equal anchors at the same place, and one anchor serves about 35 windows in a row.
2. Anchors are shuffled by hash and sorted, with a hash of all the bytes that their windows cover. An anchor that
   occurs once has no repeated window. One whose covered bytes occurred before, in (doc_id, position) order, has
   repeated windows only. These two are settled without their bytes; most anchors are. A task settles by itself what it
   has met before in a smaller doc_id, and deals that by a hash of its place: of a passage that stands everywhere, the
   task of its anchor gets a row or so from every task, not one from every document.
3. The others stand at the ends of repeats: their covered bytes are sorted by (anchor, doc_id, position) in Spark's
   external sort and streamed: a window is repeated if it occurred before in that order. Where an anchor has ``OFTEN`` or
   more such occurrences, as at the ends of a passage with many surroundings, each window goes by its own hash instead:
   one that a task has met before in a smaller doc_id is settled there, so a window that stands everywhere is a row or so
   of every task, and no task gets all windows of such an anchor.
4. Repeated windows are united per document and its other bytes hashed.

Strings are compared by two 64-bit hashes. No step holds more than a document, a batch, or the different windows of
one anchor, of fewer than ``OFTEN`` occurrences, in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from herald.llm.common import small_batches, table

LENGTH = 100
GRAM = 32
#: Open occurrences of an anchor from which its windows are dealt by their own hashes.
OFTEN = 1024
#: Rows that are sent in one batch, or a few more.
WINDOWS = 1 << 14
#: Bit of a packed place that says that its windows are dealt so.
_DEALT = 1 << 62
#: Repeated pairs that a task remembers.
MET = 1 << 18
#: Window starts that are handled at a time in a long text.
CHUNK = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_IN_CHUNK = np.uint64((1 << 20) - 1)


@cache
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    base = _BASES[which]
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def sums(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes times powers of the base (one longer than data), and powers of its inverse."""
    n = len(data)
    up, down = _powers(which, max(1 << 16, 1 << (n + 1).bit_length()))
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=out[1:])
    return out, down


def _spread(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Polynomial hash (modulo 2**64, spread) of every string of a length in an array of bytes."""
    running, down = sums(data, which)
    return _spread((running[length:] - running[:-length]) * down[: len(data) + 1 - length])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of the anchors' hashes and positions, first and last starts of the windows that each serves, and hashes of
    the bytes that those cover."""
    whole = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(whole) - length + 1), CHUNK):
        data = whole[at : at + CHUNK + length - 1]
        running, down = sums(data)
        h = _spread((running[gram:] - running[:-gram]) * down[: len(data) + 1 - gram])
        least = (h & ~_IN_CHUNK) | np.arange(len(h), dtype=np.uint64)  # the place breaks ties: the first
        width, done = length - gram + 1, 1
        while done < width:  # smallest of 1, 2, 4, ... and at last of ``width`` places in a row
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        place = (least & _IN_CHUNK).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        place = place[first]
        last = np.r_[first[1:] - 1, len(least) - 1]
        covered = _spread((running[last + length] - running[first]) * down[first] + (last - first).astype(np.uint64))
        yield h[place], place + at, first + at, last + at, covered


class _Met:
    """Pairs of hashes that repeat in a task, with the smallest key met. Forgets all when full: less is settled early."""

    def __init__(self) -> None:
        self.pairs, self.keys = np.empty(0, np.uint64), np.empty(0, np.int64)

    def later(self, pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which of them have been met with a smaller key, here or before."""
        order = np.lexsort((keys, pairs))
        sorted_pairs, sorted_keys = pairs[order], keys[order]
        opens = np.flatnonzero(np.r_[True, sorted_pairs[1:] != sorted_pairs[:-1]])
        sizes = np.diff(np.r_[opens, len(order)])
        names, least = sorted_pairs[opens], sorted_keys[opens].copy()
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, names), len(self.pairs) - 1)
            known = self.pairs[at] == names
            least[known] = np.minimum(least[known], self.keys[at[known]])
        out = np.empty(len(order), bool)
        out[order] = sorted_keys > np.repeat(least, sizes)
        often = sizes > 1
        if len(self.pairs):
            often |= known
        merged = np.r_[names[often], self.pairs] if len(self.pairs) < MET else names[often]
        keys_ = np.r_[least[often], self.keys] if len(self.pairs) < MET else least[often]
        self.pairs, first = np.unique(merged, return_index=True)
        self.keys = keys_[first]
        return out


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """anchor, key and row (of the document), place (position, and how far before it windows start: packed), covered
    (hash), sure (settled here: its windows are repeated; then anchor is a hash of its place)."""
    met = _Met()
    for b in batches:
        found = []
        for doc, row, text in zip(b["key"], b["row"], b["data"]):
            for h, place, first, last, covered in anchors(bytes(text)):
                found.append((h, np.full(len(h), doc), np.full(len(h), row), place << 16 | (place - first) << 8 | (place - last), covered))
        if found:
            h, key, row, place, covered = (np.concatenate([x[i] for x in found]) for i in range(5))
            sure = met.later(_spread(h * np.uint64(_BASES[1]) ^ covered), key)
            spread = _spread(row.view(np.uint64) ^ place.view(np.uint64) * np.uint64(_BASES[0]))
            yield pd.DataFrame({"anchor": np.where(sure, spread, h).view(np.int64), "key": key, "row": row, "place": place, "covered": covered.view(np.int64), "sure": sure})


def _unpacked(places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = np.asarray(places, np.int64)
    return places >> 16, (places >> 16) - (places >> 8 & 255), (places >> 16) - (places & 255)


def _marked(marks, settled: bool) -> np.ndarray:
    """Of a document's marks the packed places that are settled as repeated, or those that are still open (below 0)."""
    marks = np.asarray([] if marks is None else marks, np.int64)
    return marks[marks >= 0] if settled else -1 - marks[marks < 0]


def _dealt_parts(met: _Met, found: list[tuple]) -> Iterator[tuple]:
    """The windows of anchors that occur often, by their own hashes; runs of those met in a smaller key are ranges.
    found: key, row, text, starts of windows and their two hashes, for the documents of a batch."""
    pairs = np.concatenate([_spread(x * np.uint64(_BASES[1]) ^ y) for *_, x, y in found])
    known = met.later(pairs, np.concatenate([np.full(len(start), key, np.int64) for key, _, _, start, _, _ in found]))
    for (key, row, text, start, x, _), sure in zip(found, np.split(known, np.cumsum([len(f[3]) for f in found])[:-1])):
        left = np.flatnonzero(~sure)
        for at in range(0, len(left), WINDOWS):
            some = left[at : at + WINDOWS]
            yield x[some].view(np.int64), key, row, start[some], [text[a : a + LENGTH] for a in start[some].tolist()], np.zeros(len(some), np.int64)
        held = start[sure]
        if len(held):
            opens = held[np.r_[True, held[1:] != held[:-1] + 1]]
            until = held[np.r_[held[1:] != held[:-1] + 1, True]] + LENGTH
            spread = _spread(np.full(len(opens), row, np.int64).view(np.uint64) ^ opens.astype(np.uint64) * np.uint64(_BASES[0]))
            yield spread.view(np.int64), key, row, opens, [b""] * len(opens), until


def _context_parts(met: _Met, b: pd.DataFrame) -> Iterator[tuple]:
    """Columns of ``_context_rows`` for some rows of one document."""
    often = []
    for doc, row, text, marks in zip(b["key"], b["row"], b["data"], b["marks"]):
        places = np.unique(_marked(marks, settled=False))
        if not len(places):
            continue
        text = bytes(text)
        data = np.frombuffer(text, np.uint8)
        dealt = places & _DEALT != 0
        place, first, last = _unpacked(places[~dealt])
        if len(place):
            h = hashes(data, GRAM)[place].view(np.int64)
            yield h, doc, row, first, [text[a : z + LENGTH] for a, z in zip(first.tolist(), last.tolist())], np.zeros(len(place), np.int64)
        if dealt.any():
            _, first, last = _unpacked(places[dealt] & ~_DEALT)
            start = np.concatenate([np.arange(a, z + 1) for a, z in zip(first.tolist(), last.tolist())])
            often.append((doc, row, text, start, hashes(data, LENGTH, 0)[start], hashes(data, LENGTH, 1)[start]))
    if often:
        yield from _dealt_parts(met, often)


def _context_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each anchor that is not settled: its hash, where its windows start, and the bytes that they cover (until 0); of
    one that occurs often, a row for each window, or the end (until) of a range that is settled here."""
    met = _Met()

    def together(parts: list[tuple]) -> pd.DataFrame:
        anchor, key, row, first, covered, until = zip(*parts)
        sizes = [len(x) for x in first]
        return pd.DataFrame({
            "anchor": np.concatenate(anchor), "key": np.repeat(np.array(key, np.int64), sizes), "row": np.repeat(np.array(row, np.int64), sizes),
            "first": np.concatenate(first), "covered": [c for some in covered for c in some], "until": np.concatenate(until)})

    for b in batches:
        parts, size = [], 0
        for part in _context_parts(met, b):
            parts.append(part)
            size += len(part[3])
            if size >= WINDOWS:
                yield together(parts)
                parts, size = [], 0
        if parts:
            yield together(parts)


def _again(windows: pd.DataFrame) -> np.ndarray:
    """Which windows stand earlier too: in a smaller key, or in the same row before. For rows that share a key."""
    smallest = windows.groupby(["x", "y"])["key"].transform("min")
    start = windows.groupby(["x", "y", "key", "row"])["start"].transform("min")
    return ((windows["key"] > smallest) | (windows["start"] > start)).to_numpy()


def _repeated_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges of bytes under repeated windows. Rows come sorted by anchor, key, row and place."""
    seen: pd.DataFrame | None = None
    held = last = None
    for b in batches:
        ranges = b[b["until"] > 0]
        if len(ranges):
            yield pd.DataFrame({"key": ranges["key"], "row": ranges["row"], "start": ranges["first"], "end": ranges["until"]})
            b = b[b["until"] == 0].reset_index(drop=True)
        if not len(b):
            continue
        covered, anchor = b["covered"].tolist(), b["anchor"].to_numpy()
        lengths = np.array([len(c) for c in covered])
        joined = np.frombuffer(b"".join(covered), np.uint8)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        windows = lengths - LENGTH + 1
        row = np.repeat(np.arange(len(b)), windows)
        offset = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows)
        at = starts[row] + offset
        key, name, first = b["key"].to_numpy(), b["row"].to_numpy(), b["first"].to_numpy()
        found = pd.DataFrame({"x": hashes(joined, LENGTH, 0)[at], "y": hashes(joined, LENGTH, 1)[at], "key": key[row], "row": name[row], "start": first[row] + offset})
        goes_on = seen is not None and held == anchor[0]
        together = pd.concat([seen, found], ignore_index=True) if goes_on else found
        # in order, a window that has been seen stands earlier, but where rows share a key, or are the same row twice
        keys, names, firsts, groups = (np.r_[[x], y] if goes_on else y for x, y in zip(last or (0,) * 4, (key, name, first, anchor)))
        tied = (keys[1:] == keys[:-1]) & (groups[1:] == groups[:-1]) & ((names[1:] != names[:-1]) | (firsts[1:] == firsts[:-1]))
        again = (_again(together) if tied.any() else together.duplicated(["x", "y"]).to_numpy())[len(together) - len(found) :]
        held, last = anchor[-1], (key[-1], name[-1], first[-1], anchor[-1])
        tail = together[np.r_[np.full(len(together) - len(found), anchor[0] == held), anchor[row] == held]]
        needed = ~tail.duplicated(["x", "y"]) | (tail["key"] == key[-1])
        seen = tail[needed].drop_duplicates(["x", "y", "key", "row"])
        spots = np.flatnonzero(again)
        if len(spots):
            new = np.r_[True, (spots[1:] != spots[:-1] + 1) | (row[spots[1:]] != row[spots[:-1]])]
            ends = np.r_[np.flatnonzero(new)[1:] - 1, len(spots) - 1]
            opens, closes = spots[new], spots[ends]
            yield pd.DataFrame({"key": key[row[opens]], "row": name[row[opens]], "start": first[row[opens]] + offset[opens], "end": first[row[closes]] + offset[closes] + LENGTH})


def kept_runs(size: int, starts, ends) -> tuple[list[tuple[int, int]], int, int]:
    """Ranges of kept bytes, number of removed bytes, and of maximal removed runs."""
    kept, at, spans, removed = [], 0, 0, 0
    reach = -1
    for a, z in sorted(zip(starts, ends)):
        if a > reach:  # not joined to the run before
            spans += 1
            if a > at:
                kept.append((at, a))
            removed += z - a
            reach = at = z
        elif z > reach:
            removed += z - reach
            reach = at = z
    if at < size:
        kept.append((at, size))
    return kept, removed, spans


def _kept_rows(digest: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, marks, spans in zip(b["data"], b["marks"], b["spans"]):
                text = bytes(text)
                _, first, last = _unpacked(_marked(marks, settled=True))
                starts, ends = first.tolist(), (last + LENGTH).tolist()
                for s in [] if spans is None else spans:
                    starts.append(s["start"])
                    ends.append(s["end"])
                kept, removed, n = kept_runs(len(text), starts, [min(e, len(text)) for e in ends])
                left = b"".join(text[a:z] for a, z in kept)
                rows.append((len(text), removed, n, hashlib.sha256(left).hexdigest() if digest else left))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: [r[i] for r in rows] for i, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept"))}})

    return work


def deduplicated(documents: DataFrame, digest: bool = False, often: int = OFTEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, or their SHA-256 in hex); one row per input row.

    Null texts count as empty; texts under LENGTH bytes stay whole; a very long text is searched in chunks that overlap;
    rows that share a doc_id (null ids share one, the smallest) are documents at the same place, neither before the
    other: they lose nothing to each other, whether their texts differ or are equal, and each loses what it repeats
    itself; an empty table gives no rows; other columns are not used, whatever their names.
    """
    small_batches(documents.sparkSession)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = documents.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("row"), text.alias("data"))
    found = docs.select("key", "row", "data").mapInPandas(_anchor_rows, "anchor bigint, key bigint, row bigint, place bigint, covered bigint, sure boolean")
    order = ("key", "row", "place")
    alike = W.partitionBy("anchor", "covered").orderBy(*order)
    same = W.partitionBy("anchor").orderBy("covered", *order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one sort serves both
    ranked = found.repartition("anchor").withColumns({"first": F.first("key").over(alike), "before": F.lag(F.struct("key", "row", "place")).over(alike)})
    ranked = ranked.withColumns({"low": F.min("covered").over(same), "high": F.max("covered").over(same)})
    earlier = (F.col("key") > F.col("first")) | ((F.col("before.key") == F.col("key")) & (F.col("before.row") == F.col("row")) & (F.col("before.place") < F.col("place")))
    judged = ranked.withColumn("again", F.col("sure") | F.coalesce(earlier, F.lit(False))).withColumn("open", F.sum(F.when(~F.col("again"), 1)).over(same)).where("again or low <> high")
    # one column, so that both readers below share one exchange of it
    waiting = -1 - F.when(F.col("open") < often, F.col("place")).otherwise(F.col("place").bitwiseOR(F.lit(_DEALT)))
    marks = judged.groupBy("key", "row").agg(F.collect_list(F.when(F.col("again"), F.col("place")).otherwise(waiting)).alias("marks"))
    marked = docs.join(marks, ["key", "row"], "left").select("doc_id", "key", "row", "data", "marks")
    contexts = marked.mapInPandas(_context_rows, "anchor bigint, key bigint, row bigint, first bigint, covered binary, until bigint")
    ranges = contexts.repartition("anchor").sortWithinPartitions("anchor", "key", "row", "first").mapInPandas(_repeated_rows, "key bigint, row bigint, start bigint, end bigint")
    spans = ranges.groupBy("key", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept " + ("string" if digest else "binary")
    return marked.join(spans, ["key", "row"], "left").select("doc_id", "data", "marks", "spans").mapInPandas(_kept_rows(digest), shape)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


#: Every window of every text, by its bytes in hex. Exact, and quadratic in nothing, but LENGTH times the input in size.
SQL = f"""
with docs as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
places as (select doc_id, h, unnest(range(0, len(h) // 2)) as i from docs),
windows as (select doc_id, i, substr(h, 2 * i + 1, 2) as b, case when i + {LENGTH} <= len(h) // 2 then substr(h, 2 * i + 1, {2 * LENGTH}) end as w from places),
firsts as (select doc_id, i, b, w is not null and row_number() over (partition by w order by doc_id, i) > 1 as again from windows),
covered as (select doc_id, i, b, coalesce(i - max(case when again then i end) over (partition by doc_id order by i rows unbounded preceding) < {LENGTH}, false) as gone from firsts),
runs as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from covered),
sums as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, string_agg(b, '' order by i) filter (where not gone) as left_hex from runs group by doc_id)
select d.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(left_hex, ''))) as kept_sha256 from docs d left join sums s on d.doc_id = s.doc_id
"""
