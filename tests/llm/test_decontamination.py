"""Operator 13 against a brute-force version, on rows made for it and on the smallest tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from herald.llm import decontamination as op

SEP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(op.UPPER, op.LOWER)


def words(text):
    return [w for w in SEP.split((text or "").translate(LOWER)) if w]


def brute(docs, items, window=op.WINDOW):
    """(n_words, n_hit, ids) of each text."""
    out = []
    for text in docs:
        w, hit, ids, n = words(text), set(), [], 0
        for item, t in items:
            iw = words(t)
            size = min(window, len(iw))
            grams = {tuple(iw[s : s + size]) for s in range(len(iw) - size + 1)} if iw else set()
            at = [s for s in range(len(w) - size + 1) if size and tuple(w[s : s + size]) in grams]
            hit |= {p for s in at for p in range(s, s + size)}
            if at:
                n += 1
                ids += [] if item is None else [str(item)]
        out.append((len(w), len(hit), n, sorted(ids)))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_random_texts(spark):
    """Small vocabularies, so that words repeat, overlap and are equally rare."""
    draw = random.Random(5)
    text = lambda n, k: " ".join(draw.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(k, text(draw.choice([1, 2, 5, 10, 11, 14, 30]), draw.choice([1, 2, 8]))) for k in range(25)] + [(90, None), (91, " .,"), (3, "a b"), (None, "b a h"), (92, "b a h")]
    docs = [(k, text(draw.choice([0, 1, 9, 60, 300]), draw.choice([1, 2, 8]))) for k in range(40)]
    docs += [(100 + k, text(20, 8) + " " + items[k][1] + " " + text(9, 8)) for k in range(25)] + [(None, None), (None, docs[3][1]), (5, docs[3][1]), (5, "A,B")]
    for window in (10, 3):
        got = op.phrases(*tables(spark, docs, items), window).collect()
        want = brute([t for _, t in docs], items, window)
        assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in got) == sorted((d or -1, *w, w[1] > 0) for (d, _), w in zip(docs, want))


def test_smallest_tables(spark, sf_dir):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {r["doc_id"]: r for r in op.op13_decontamination(spark, sf_dir).collect()}
    for (doc, _), (n, hit, held, ids) in zip(docs, brute([t for _, t in docs], items)):
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, held, hashlib.sha256(",".join(ids).encode()).hexdigest())


def test_beyond_the_bounds_of_broadcasts(spark, monkeypatch):
    """The plans that shuffle give the same rows as those that broadcast, copies of one text included."""
    docs = [(k, "x y z the quick brown fox jumps over the lazy dog again and again") for k in range(60)] + [(k, f"the quick brown fox jumps over the lazy dog again {k}") for k in range(60, 80)] + [(99, "the the the")]
    items = [(1, "the quick brown fox jumps over the lazy dog again and"), (2, "the"), (3, "no such words")]
    rows = lambda: sorted((r["doc_id"], r["n_hit"], r["items"]) for r in op.phrases(*tables(spark, docs, items)).collect())
    small = rows()
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(op, "BROADCAST_BYTES", -1)
    assert rows() == small == sorted((d, hit, ids) for (d, _), (_, hit, _, ids) in zip(docs, brute([t for _, t in docs], items)))


def test_long_texts_and_words(spark):
    text = " ".join(f"w{k % 5000}" for k in range(60_000)) + " " + "ü" * 50_000
    docs, items = [(1, text), (2, text[5:])], [(1, " ".join(f"w{k}" for k in range(4990, 5000)) + " w0 w1"), (2, text), (3, "ü" * 50_000), (4, "w7")]
    got = op.phrases(*tables(spark, docs, items)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted((d, n, hit, ids) for (d, _), (n, hit, _, ids) in zip(docs, brute([t for _, t in docs], items)))


def test_empty_tables_and_clashing_names(spark):
    docs, items = tables(spark, [(1, "a b c")], [(1, "b")])
    assert op.phrases(docs.limit(0), items).count() == 0
    assert [r["contaminated"] for r in op.phrases(docs, items.limit(0)).collect()] == [False]
    wide = docs
    for n in ("n_hit", "words", "row", "h1", "found", "hits", "content", "items", "item", "start", "apart", "_i"):
        wide = wide.withColumn(n, F.lit(f"own {n}"))
    wide = wide.withColumn("kinds", F.create_map(F.lit("k"), F.lit("v")))
    got = op.phrases(wide, items)
    assert set(got.columns) == set(wide.columns) | set(op.ADDED)
    row = got.first()
    assert (row["n_hit"], row["items"], row["words"], row["_i"], row["kinds"]) == (1, ["1"], "own words", "own _i", {"k": "v"})
    assert op.near(wide, spark.createDataFrame([(1, "a c")], "item_id long, text string")).first()["_apart"] == 1


def brute_near(docs, items, windows, slack):
    out = set()
    for doc, text in docs:
        w = words(text)
        for ids, start, (a, b) in windows:
            first, second = ([p - at for p, x in enumerate(w) if x == term] for at, term in (a, b))
            apart = min((abs(x - y) for x in first for y in second), default=None)
            if apart is not None and apart <= slack:
                out |= {(doc, i, start, apart) for i in ids}
    return out


@pytest.mark.parametrize("slack", [0, 2, 5])
def test_proximity(spark, slack):
    draw = random.Random(slack)
    text = lambda n: " ".join(draw.choice("abcdefghijkl") for _ in range(n))
    docs, items = [(k, text(40)) for k in range(30)], [(k, text(n)) for k, n in enumerate((1, 2, 3, 4, 12))]
    d, i = tables(spark, docs, items)
    held = op.items_of(i)
    spelled = {r["content"]: (r["ids"], r["words"]) for r in held.collect()}
    rare = op.windows_of(held, op.frequencies(d, held)).where(F.size("probes") == 2).collect()
    windows = [(spelled[r["content"]][0], r["start"], [(p["pos"], spelled[r["content"]][1][p["pos"]]) for p in r["probes"]]) for r in rare]
    got = {(r["doc_id"], r["item"], r["start"], r["apart"]) for r in op.near(d, i, slack).collect()}
    assert got == brute_near(docs, items, windows, slack) and got
