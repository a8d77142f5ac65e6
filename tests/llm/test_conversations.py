"""Operator 11 against a brute-force version: every target string, every alignment."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from herald.llm import conversations as op

SPACE = " \t\n\x0b\x0c\r"


def brute(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of (turn, role, text)s in order, by the rules as they stand."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = (text or "").strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [(role or ".")[0] for _, role, _ in turns]

    def aligned(target):
        @functools.cache
        def best(i, j):
            found = [(0, "", ())] if i == len(turns) and j == len(target) else []
            if i < len(turns):
                c, a, o = best(i + 1, j)
                found.append((c + 4, "D" + a, o))
                if j < len(target) and faults[i] not in ("b", "d"):
                    extra = 3 * (faults[i] == "t")
                    c, a, o = best(i + 1, j + 1)
                    if first[i] == target[j]:
                        found.append((c + extra, "K" + a, ((turns[i][1], turns[i][2]), *o)))
                    if target[j] != "s":
                        found.append((c + extra + 3, "R" + a, (({"u": "user", "a": "assistant"}[target[j]], turns[i][2]), *o)))
            if j < len(target) and target[j] != "s":
                c, a, o = best(i, j + 1)
                found.append((c + 3, "I" + a, (({"u": "user", "a": "assistant"}[target[j]], ""), *o)))
            return min(found, default=(10**9, "", ()))

        return best(0, 0)

    targets = [""] + [s + "ua" * k for s in ("", "s") for k in range(1, len(turns) + 2)]
    cost, audit, out = min(aligned(t) for t in targets)
    some = {t for t, *_ in turns if t is not None}
    gaps = max(some) - min(some) + 1 - len(some) if some else 0
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def ordered(rows):
    least = lambda x: (x is not None, x if x is not None else 0)
    word = lambda x: (x is not None, x or "")
    return sorted(rows, key=lambda r: (least(r[0]), word(r[1]), word(r[2])))


def drawn(seed, n):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", None, "s", ""]
    texts = ["Yes.", "No", "Why? ", "", None, " \t", "so!\n", "x y"]
    pick = lambda: (draw.choice([None, *range(6)]), draw.choices(roles, [3, 8, 8, 1, 1, 1, 1])[0], draw.choices(texts + [f"t{draw.random()}."], [2, 2, 2, 1, 1, 1, 1, 1, 20])[0])
    return ordered(pick() for _ in range(n))


@pytest.mark.parametrize("seed", range(300))
def test_one_conversation(seed):
    turns = drawn(seed, seed % 9)
    if not turns:
        return
    found = op.whole(turns)
    assert (*found, op.digest(op.applied(found[-1], ((r, t) for _, r, t in turns)))) == brute(turns)


@pytest.mark.parametrize("seed", range(60))
def test_runs_join_to_the_whole(seed):
    turns = drawn(1000 + seed, 4 + seed % 20)
    roles, must, bad, _ = op.judged(turns)
    draw = random.Random(seed)
    edges = sorted({0, len(turns), *(draw.randrange(len(turns)) for _ in range(3))})
    tables = [op.best_between(roles[a:b], must[a:b], bad[a:b], range(4), range(4)) for a, b in zip(edges, edges[1:])]
    table = functools.reduce(op.joined, tables)
    assert min(v for (p, q), v in table.items() if p == op.NOTHING and q in (op.NOTHING, op.USER)) == op.whole(turns)[-2:]


def rows_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


SHAPE = "conv_id long, turn long, role string, text string"


def test_streams_long_and_short(spark, monkeypatch):
    """Conversations beyond the bound, in runs of a few turns, give what they give in one piece; null ids are one conversation."""
    held = {c: drawn(5000 + (c or 77), n) for c, n in [(None, 40), (1, 3), (2, 60), (3, 25), (4, 1)]}
    df = spark.createDataFrame([(c, *t) for c, turns in held.items() for t in turns], SHAPE).repartition(5)
    want = {c: brute(turns) for c, turns in held.items()}
    assert rows_of(op.repairs(df)) == want
    monkeypatch.setattr(op, "SEGMENT", 7)
    assert rows_of(op.repairs(df, most=10)) == want
    whole, parts = ({(r["conv_id"], r["place"]): (r["edit"], r["role"], r["text"]) for r in op.repaired_turns(df, most=m).collect()} for m in (2000, 10))
    assert whole == parts
    for c, turns in held.items():
        kept = [whole[k] for k in sorted((k for k in whole if k[0] == c), key=lambda k: k[1])]
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest() == want[c][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _ in kept))


def test_one_conversation_holds_most_turns(spark):
    """Of 6000 turns of one conversation the same text many times; runs are many tasks' work."""
    turns = ordered((k, "user" if k % 2 else "assistant", "Same." if k % 3 == 0 else f"t{k}.") for k in range(6000))
    df = spark.createDataFrame([(1, *t) for t in turns] + [(2, 0, "user", "a?"), (2, 1, "assistant", "b.")], SHAPE)
    got = rows_of(op.repairs(df))
    assert got[2][5:7] == (0, "KK") and got[1][2] == 1998
    roles, must, bad, counts = op.judged(turns)
    assert got[1][1:5] == counts and got[1][5] <= op.incumbent(roles, must, bad, op.NOTHING, op.USER)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 and text else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*op.ORDER).collect()]
    left, want = damage(rows), {}
    for conv in {r[0] for r in rows}:
        turns = ordered(r[1:] for r in left if r[0] == conv)
        want[conv] = brute(turns) if turns else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert rows_of(op.op11_conversations(spark, sf_dir)) == want


def test_damage_of_awkward_rows_and_lost_conversations(spark, tmp_path):
    rows = [(None, None, None, None), (None, 3, "user", "x."), *[(k, 0, "user", "a.") for k in range(60)], *[(k, None, "assistant", None) for k in range(60)]]
    df = spark.createDataFrame(rows, SHAPE).withColumn("kind", F.lit("own")).withColumn("copy", F.lit(1)).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    assert sorted(map(repr, (tuple(r) for r in op.damaged(df).collect()))) == sorted(map(repr, damage(rows)))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(op.op11_conversations(spark, str(tmp_path)))
    assert set(got) == {None, *range(60)}
    df.limit(0).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert op.op11_conversations(spark, str(tmp_path / "none")).count() == 0
