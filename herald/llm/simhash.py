"""Operator 2: SimHash near-duplicates, compared over bit planes.

Fingerprints are 64-bit SimHashes of 3-word shingles. Equal ones are one class. Of the different ones, two within
``RADIUS`` bits agree on all bits of at least one of RADIUS + 1 sections, so rows are dealt to buckets by the first
bits of each section in turn (as many bits as keep a bucket at about ``LANES`` rows); when 16-bit sections are too
few for that, sections are made smaller and buckets take the bits of two or three of RADIUS + 2 or RADIUS + 3 of them.
Each way finds every pair within the radius.

In a bucket the 64 bits stand as vertical planes, 64 rows to a machine word. A row's distances to all others grow plane
by plane in carry-save counters (ones, twos, and an overflow that stays set once a distance passes 3); words whose 64
distances have all passed the radius are abandoned. Buckets beyond ``TILE`` rows are cut into hashed tiles, and pairs of
tiles are compared, so no task ever holds more than two tiles. What leaves a tile is a spanning forest of its links, at
most one edge a row, however large its groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.llm.common import small_batches, connected_components, cut, table

RADIUS = 3
SHINGLE = 3
SEED = 42
LANES = 256
TILE = 2048


def fingerprint(text: str | None) -> int:
    """SimHash of a text, 0 to 2**64 - 1; ASCII white space splits words, A to Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *carried: str) -> DataFrame:
    """doc_id, carried columns (bigint, no nulls), fp (the fingerprint as a signed 64-bit number). Null texts count as empty."""
    small_batches(documents.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: b[c] for c in carried}, "fp": np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64)})

    return documents.select("doc_id", *carried, "text").mapInPandas(work, ", ".join(f"{c} bigint" for c in ("doc_id", *carried, "fp")))


def sections(rows: int, lanes: int = LANES) -> list[tuple[tuple[int, int], ...]]:
    """Bucket keys: of each, the (first bit, bits) that it takes; for about ``lanes`` rows a bucket of random bits."""
    want = max(1, math.ceil(math.log2(max(2, rows / lanes))))
    for match in (1, 2, 3):
        parts = RADIUS + match
        edges = [64 * k // parts for k in range(parts + 1)]
        least = min(b - a for a, b in zip(edges, edges[1:]))
        if want <= match * least or match == 3:
            bits = min(least, math.ceil(want / match))
            return [tuple((edges[k], bits) for k in chosen) for chosen in combinations(range(parts), match)]
    raise AssertionError


def linked(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the radius: edges (positions) among left, or between left and right."""
    lanes = left if right is None else right
    n = len(lanes)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = lanes
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")  # 64 x words
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view("<u8").astype(np.uint64)
    size = len(left) + (0 if right is None else n)
    roots = np.arange(size)
    step = max(1, 1 << 15 >> max(0, (words - 1).bit_length()))
    for at in range(0, len(left), step):
        query = left[at : at + step]
        flips = np.where((query[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))
        row = np.repeat(np.arange(len(query)), words)
        word = np.tile(np.arange(words), len(query))
        ones = np.zeros(len(row), np.uint64)
        twos, over = ones.copy(), ~valid[word]
        for first in range(0, 64, 8):
            for p in range(first, first + 8):
                carry = planes[p][word] ^ flips[row, p]
                ones, carry = ones ^ carry, ones & carry
                twos, carry = twos ^ carry, twos & carry
                over |= carry
            live = np.flatnonzero(over != np.uint64(2**64 - 1))
            if not len(live):
                break
            if len(live) < len(row):
                row, word, ones, twos, over = row[live], word[live], ones[live], twos[live], over[live]
        else:
            near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(near)
            a, b = row[k] + at, word[k] * 64 + lane + (0 if right is None else len(left))
            roots = united(roots, a, b)
    moved = np.flatnonzero(roots != np.arange(size))
    return roots[moved], moved


def united(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: every one the smallest position of its group."""
    while True:
        ra, rb = roots[a], roots[b]
        differ = ra != rb
        if not differ.any():
            return roots
        a, b = a[differ], b[differ]
        np.minimum.at(roots, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while not np.array_equal(up := roots[roots], roots):
            roots = up


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of each (bucket, pair of tiles): rows come sorted by those, so one pair of tiles is held at a time."""
    held: list[pd.DataFrame] = []

    def flush() -> Iterator[pd.DataFrame]:
        group = pd.concat(held) if len(held) > 1 else held[0]
        fp, side = group["fp"].to_numpy().view(np.uint64), group["side"].to_numpy()
        if group["low"].iat[0] == group["high"].iat[0]:
            names, (a, b) = fp, linked(fp, None)
        else:
            one, two = fp[side == 0], fp[side == 1]
            names = np.concatenate([one, two])
            a, b = linked(one, two) if len(one) and len(two) else (np.empty(0, int),) * 2
        if len(a):
            yield pd.DataFrame({"a": names[a].view(np.int64), "b": names[b].view(np.int64)})

    for batch in batches:
        if not len(batch):
            continue
        key = batch[["way", "bucket", "low", "high"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(batch)]
        for x, y in zip(cuts, cuts[1:]):
            part = batch.iloc[x:y]
            if held and (held[-1][["way", "bucket", "low", "high"]].iloc[-1].to_numpy() != key[x]).any():
                yield from flush()
                held.clear()
            held.append(part)
    if held:
        yield from flush()


def near(distinct: DataFrame, lanes: int = LANES, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp), enough to join all that link within the radius."""
    ways = sections(distinct.count(), lanes)
    bucket = lambda way: sum(((F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))) * (1 << sum(b for _, b in way[:k])) for k, (at, bits) in enumerate(way)), F.lit(0).cast("bigint"))
    dealt = distinct.select("fp", F.posexplode(F.array(*[bucket(way) for way in ways])).alias("way", "bucket"))
    tiles = dealt.groupBy("way", "bucket").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = dealt.join(tiles, ["way", "bucket"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "fp", "way", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    keys = ["way", "bucket", "low", "high"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_compare, "a bigint, b bigint")


def labelled(prints: DataFrame, least: Column) -> DataFrame:
    """fp, least (that aggregate of its rows), component (a fingerprint), one row for each different fingerprint."""
    classes = cut(prints.groupBy("fp").agg(least.alias("least")))
    joined = connected_components(near(classes.select("fp")))
    return classes.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def components(documents: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, the document itself included.

    Null and wordless texts have fingerprint 0 and link as any others do; rows with a null doc_id are components of
    their own fingerprint whose id is null only if no linked row has one; an empty table gives no rows.
    """
    prints = cut(fingerprints(documents))
    labels = labelled(prints, F.min("doc_id"))
    smallest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labels.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
