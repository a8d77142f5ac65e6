"""Operators 3, 5, 6 and 9 against plain Python (and SQL) on small tables with awkward rows."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from herald.llm import common, fingerprints, mixing, pii, quality, registry

AWKWARD = [None, "", " \n\t", "a", "one two", "x" * 5000, "w " * 3000, "é😀 ü\x0b\x0cz", "same line\nsame line\nother\n\nsame line", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p"]


def docs(spark, texts=AWKWARD, first=0):
    rows = [(first + 3 * i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")


def empty(spark):
    return docs(spark).limit(0)


def base_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs(spark, first=10**6).select("doc_id", "text"))
    logs = quality.ratios(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert len(logs) == quality.BUCKETS
    judged = quality.rules(table, logs).collect()
    assert len(judged) == 200 + len(AWKWARD)
    for r in judged:
        n, chars, symbols, lines, repeated = base_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        failed = n < 10 or 100 * repeated > 20 * n
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= quality.THRESHOLD)
    assert quality.rules(empty(spark), logs).count() == 0


def test_quality_prefers_the_target(spark):
    good = ["the river runs past the old mill and the quiet town by the sea"] * 20
    bad = ["$$$ buy ### now %%% cheap *** pills $$$ buy ### now %%% cheap *** deal"] * 20
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(3 * i, 1, 0) for i in range(20)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    logs = quality.ratios(table, labels)
    scores = [r["score"] for r in quality.rules(table, logs).orderBy("doc_id").collect()]
    assert min(scores[:20]) > max(scores[20:])
    assert quality.ratios(table, labels.limit(0)) == [0.0] * quality.BUCKETS


def chained_hash(*words):
    from xxhash import xxh64_intdigest

    h = 42
    for w in words:
        h = xxh64_intdigest(w.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def test_quality_score_is_the_definition(spark, sf_dir):
    """Counts, smoothed ratios, mean and verdict in plain Python; and columns of any name stay."""
    import math

    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs(spark, first=10**6).select("doc_id", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in table.collect()}
    of = lambda w: [chained_hash(x) % quality.BUCKETS for x in w] + [chained_hash(*x) % quality.BUCKETS for x in zip(w, w[1:])]
    raw, target = collections.Counter(), collections.Counter()
    for d, w in texts.items():
        raw.update(of(w))
        target.update(of(w) if d in good else [])
    share = lambda counts, b: counts[b] / sum(counts.values())
    ratio = lambda b: math.log((share(target, b) / share(raw, b) + quality.PRIOR) / (1 + quality.PRIOR))
    clashing = table.withColumns({c: F.lit("mine") for c in ("words", "row", "hashes", "lines", "bucket", "SCORE")})
    for r in quality.rules(clashing, quality.ratios(table, labels)).collect():
        f = of(texts[r["doc_id"]])
        want = sum(map(ratio, f)) / len(f) if f else None
        assert (r["score"] is None) if want is None else abs(r["score"] - want) < 2e-6
        if want is not None and abs(want - quality.THRESHOLD) > 1e-5:
            assert r["kept"] == (not r["base_failed"] and want >= quality.THRESHOLD)
        assert (r["words"], r["row"], r["hashes"], r["lines"], r["bucket"]) == ("mine",) * 5


def test_quality_does_not_depend_on_the_size_of_the_table(spark):
    """A table and ten copies of it under new ids: the same verdict on every document."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    copies = lambda df: df.crossJoin(spark.range(10)).withColumn("doc_id", F.col("doc_id") * 10 + F.col("id")).drop("id")
    verdicts = lambda docs, logs: {r["doc_id"]: r["kept"] for r in quality.rules(docs, logs).select("doc_id", "kept").collect()}
    one = quality.ratios(table, labels)
    assert quality.ratios(copies(table), copies(labels)) == one
    kept = verdicts(table.select("doc_id", "text"), one)
    assert len(kept) == 1000
    bad, good = ({r["doc_id"] for r in labels.where(f"quality = {q}").collect()} for q in (0, 1))
    assert sum(kept[d] for d in bad) < 0.15 * len(bad)


def test_quality_keeps_good_documents_that_are_not_in_the_target(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    good = {r["doc_id"] for r in labels.where(held).where("quality = 1").collect()}
    rows = quality.rules(table.select("doc_id", "text"), quality.ratios(table, labels.where(~held))).select("doc_id", "base_failed", "kept").collect()
    judged = [r["kept"] for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert len(judged) > 40 and sum(judged) >= 0.97 * len(judged)


def luhn(s):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def base_pii(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join("%s:%d:%d" % s for s in out)


PII = ["a@b.c_d@e.f @x.y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0000", "+1 (017) 555-7713 +49-30--123456. +12", "😀 é a@b.co " * 3, "a" * 3000 + "@b.c", "1" * 3000, "a@" + "b." * 2000 + "c", "+1" + " " * 3000, "1.2.3." * 200, "a@b a@@b.c a@b. .@-.-"]


def test_pii(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs(spark, AWKWARD + PII, 10**6).select("doc_id", "text"))
    monkeypatch.setattr(pii, "table", lambda *a: table)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = pii.op5_pii(spark, "").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_pii(texts[r["doc_id"]])
        assert ",".join(s for s in r["spans"].split(",") if not s.startswith("iban")) == want
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_ip"] == want.count("ip:")


def test_account_numbers_and_context(spark, monkeypatch):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "GB82WEST12345698765432", "call +49 30 1234567", "+49 30 1234567"]
    found = {r["text"]: r["pii"] for r in pii.find(docs(spark, texts)).collect()}
    monkeypatch.setattr(pii, "table", lambda *a: docs(spark, texts))
    shown = pii.op5_pii(spark, "").where("doc_id = 0").first()
    assert shown["base_sha256"] == hashlib.sha256(b"").hexdigest() and shown["spans"] == "iban:5:32"
    assert [s["kind"] for s in found[texts[0]]] == ["iban"] and not [s for s in found[texts[1]] if s["kind"] == "iban"] and [s["kind"] for s in found[texts[2]]] == ["iban"]
    assert found[texts[3]][0]["score"] > found[texts[4]][0]["score"]
    assert shown["scores"] == "90"
    assert pii.find(empty(spark)).count() == 0


def test_account_numbers_in_running_text(spark):
    """What follows or comes before a number is not taken for a part of it."""
    number, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [f"IBAN {number} Bitte", f"{spaced} BIC COBADEFFXXX", f"{spaced} 25 Euro", f"AB12 3456 7890 1234 {spaced} Danke", f"{number} {number}", f"{spaced} UND GB82 WEST 1234 5698 7654 32 Gut", number + "x", f"{spaced}1"]
    found = {r["text"]: [r["text"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] == "iban"] for r in pii.find(docs(spark, texts)).collect()}
    assert [found[t] for t in texts] == [[number], [spaced], [spaced], [spaced], [number] * 2, [spaced, "GB82 WEST 1234 5698 7654 32"], [], []]


def account(country, digits):
    """A number that mod-97 confirms."""
    for check in range(100):
        turned = digits + country + f"{check:02d}"
        if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
            return f"{country}{check:02d}{digits}"


UNKNOWN = account("ZZ", "12345678901234")
CONTEXT = [("konto " + UNKNOWN, True), (UNKNOWN, False), ("GB82WEST12345698765432", True), ("order GB82WEST12345698765432", False), ("order, bank GB82WEST12345698765432", True), ("serial " + UNKNOWN, False)]


def test_context_decides(spark, monkeypatch):
    """Words near a number that holds add it and take it away; without context points other spans come out."""
    texts = [t for t, _ in CONTEXT]
    kinds = lambda: [[s["kind"] for s in r["pii"]] for r in pii.find(docs(spark, texts)).orderBy("doc_id").collect()]
    assert kinds() == [["iban"] if kept else [] for _, kept in CONTEXT]
    monkeypatch.setattr(pii, "FOR_POINTS", 0)
    monkeypatch.setattr(pii, "AGAINST_POINTS", 0)
    assert kinds() != [["iban"] if kept else [] for _, kept in CONTEXT]


def test_pii_sql_on_planted_texts(spark, monkeypatch):
    import duckdb
    import pandas as pd

    number, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [*[t for t, _ in CONTEXT], f"IBAN {number} Bitte", f"{spaced} BIC COBADEFFXXX", f"{spaced} 25 Euro", f"AB12 3456 7890 1234 {spaced} Danke", f"{number} {number}", f"{spaced} UND GB82 WEST 1234 5698 7654 32 Gut", number + "x"]
    texts += [t for t in PII if len(t) < 1000] + ["call +49 30 1234567, version 1.2.3.4, visa 4111 1111 1111 1111, mail a@b.co", None]
    documents = pd.DataFrame({"doc_id": [3 * i for i in range(len(texts))], "text": texts})  # noqa: F841
    want = duckdb.sql(pii.SQL)
    names = sorted(want.columns)
    rows = want.fetchall()
    monkeypatch.setattr(pii, "table", lambda *a: docs(spark, texts))
    got = {r["doc_id"]: [r[c] for c in names] for r in pii.op5_pii(spark, "").collect()}
    assert got == {r[want.columns.index("doc_id")]: [r[want.columns.index(c)] for c in names] for r in rows}


def test_fingerprints(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs(spark, first=10**6).select("doc_id", "text"))
    monkeypatch.setattr(fingerprints, "table", lambda *a: table)
    texts = [r["text"] or "" for r in table.orderBy("doc_id").collect()]
    for rows_a_range in (10**6, 20):
        monkeypatch.setattr(fingerprints.edited, "__defaults__", (rows_a_range,))
        got = fingerprints.op6_fingerprints(spark, "").orderBy("doc_id").collect()
        assert len(got) == len(texts)
        for i, r in enumerate(got):
            a, b = texts[i], texts[(i + 1) % len(texts)]
            edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert r["near_next"] == 1 if a == b else True
            after = got[(i + 1) % len(got)]["fingerprint"]
            for near, other in (("near_edited", r["edited_fingerprint"]), ("near_next", after)):
                x, y = ({p.split(":")[1] for p in f.split(",") if p} for f in (r["fingerprint"], other))
                assert abs(r[near] - (len(x & y) / len(x | y) if x | y else 1)) < 1e-9
    by_text = collections.defaultdict(set)
    for t, r in zip(texts, got):
        by_text[t].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.edited(empty(spark)).count() == 0 and fingerprints.edited(docs(spark, ["only one"])).first()["edited"] == "onlyonly"


def test_fingerprints_of_rows_that_share_ids(spark):
    """Half the ids null and a fifth of them one: no range holds them all, and each row is followed by the next in (id, hash, text)."""
    from xxhash import xxh64_intdigest

    ids = lambda k: None if k % 2 else 7 if k % 5 == 0 else k
    rows = [(ids(k), f"text {k % 900} of some") for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = lambda t: (h := xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))
    want = collections.Counter((a, t, order[(i + 1) % len(order)][1]) for i, (a, t) in enumerate(order))
    for size in (100, 10**6):
        got, _ = fingerprints.pairs(table, size)
        found = got.where("copy = 0").select("doc_id", "text", "next", "part").collect()
        assert collections.Counter((r["doc_id"], r["text"], r["next"]) for r in found) == want
        parts = collections.Counter(r["part"] for r in found)
        assert max(parts.values()) < 250 if size == 100 else len(parts) == 1
    edges = [fingerprints._ranges(table.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key")), 100)][0]
    assert len(edges) > len(set(edges))


def test_winnowing_is_the_definition(spark):
    import random

    random.seed(5)
    texts = [" ".join(random.choice("abc") for _ in range(n)) for n in (1, 4, 5, 12, 20, 21, 60, 300)]
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - fingerprints.GRAM), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.xxhash64(F.get("w", i + k)) for k in range(fingerprints.GRAM)]), 21))
    # the third way packs no positions: as for texts of more words than they have bits for
    rows = docs(spark, texts).withColumn("w", common.words(F.col("text"))).withColumns({"fp": fingerprints.winnow(F.col("text")), "long": fingerprints.winnow(F.col("text"), places=4)})
    for r in rows.where(F.size("w") >= fingerprints.GRAM).withColumn("g", grams).collect():
        h, want = r["g"], []
        assert r["fp"] == r["long"]
        for s in range(max(1, len(h) - fingerprints.WINDOW + 1)):
            window = h[s : s + fingerprints.WINDOW]
            k = s + max(i for i, x in enumerate(window) if x == min(window))
            want += [k] if not want or want[-1] != k else []
        assert [x["position"] for x in r["fp"]] == want and [x["hash"] for x in r["fp"]] == [h[k] for k in want]


def test_shared_runs_share_a_hash(spark):
    passage = " ".join(f"w{i}" for i in range(fingerprints.GRAM + fingerprints.WINDOW - 1))
    a, b = "start of one " + passage + " and its end", "another " + passage
    got = docs(spark, [a, b]).select(fingerprints.hashes(fingerprints.winnow(F.col("text"))).alias("h")).collect()
    assert set(got[0]["h"]) & set(got[1]["h"])


def test_mixing(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").union(docs(spark, first=10**6).select("doc_id", "text", "source"))
    for block, shard in ((4, 50), (64, mixing.SHARD)):
        rows = mixing.taken(table, block=block, shard=shard).collect()
        assert len(rows) == 200 + len(AWKWARD)
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1
        for s in {r["source"] for r in rows}:
            of = [r for r in rows if r["source"] == s]
            assert of[0]["target"] <= 3 * of[0]["source_size"] + 1e-6
            assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 2 * block
    assert mixing.taken(empty(spark)).count() == 0
    once, again = (sorted(map(tuple, mixing.taken(table.repartition(n)).collect())) for n in (2, 5))
    assert once == again


def test_permutations(spark):
    """Every index once, for block counts of all shapes; another turn is another permutation."""
    counts = [*range(1, 40), 63, 64, 65, 97, 100, 997, 1000, 4096, 5000]
    rows = spark.createDataFrame([(n, k) for n in counts for k in (0, 1)], "blocks long, turn long").withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = collections.defaultdict(dict)
    for r in mixing.permuted(rows, "index", "blocks", "turn").collect():
        found[r["blocks"], r["turn"]][r["index"]] = r["place"]
    assert all(sorted(x.values()) == list(range(n)) for (n, _), x in found.items())
    assert found[1000, 0] != found[1000, 1] and sum(abs(a - b) < 100 for a, b in found[1000, 0].items()) < 350


def test_draws(spark):
    """Counts of shards vary as draws do, and add up to what each source is to have."""
    sources = spark.createDataFrame([(0, 64_000, 64_000.0), (1, 6_400, 12_800.0), (2, 640, 1_920.0)], "rank int, source_size long, target double")
    rows = mixing.shard_counts(sources, shard=100).collect()
    total = collections.Counter()
    for r in sorted(rows, key=lambda r: (r["rank"], r["shard"])):
        assert r["before"] == total[r["rank"]]
        total[r["rank"]] += r["n"]
    assert total == {0: 1000, 1: 200, 2: 30}
    per = collections.Counter()
    for r in rows:
        per[r["shard"]] += r["n"]
    assert all(n == 100 for s, n in per.items() if s < 12) and len({r["n"] for r in rows if r["rank"] == 1}) > 3


def test_level_of_targets(spark):
    """Water filling against its definition: stop what is too much, share again."""
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 0, "e": 3000, None: 7}
    rows = mixing.targets(spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id int, source string, size long")).collect()
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, left = {}, sum(sizes.values()), set(order)
    while left:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= over
    assert {r["source"]: round(r["target"], 4) for r in rows} == {s: round(t, 4) for s, t in target.items()}


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        want = con.sql(sql)
        names = sorted(want.columns)
        place = {c: i for i, c in enumerate(want.columns)}
        got = registry.queries()[name](spark, sf_dir)
        assert sorted(got.columns) == names
        assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr([r[place[c]] for c in names]) for r in want.fetchall())


def test_mixing_of_sources_without_a_draw(spark):
    """Many sources of a block each beside a large one: some are never drawn, and still get what they are owed."""
    rows = [(k, "w " * 5, f"s{k:03d}") for k in range(60)] + [(1000, "v " * 20_000, "large")]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 61 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 64
