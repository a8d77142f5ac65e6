"""Operator 11: conversation structure repair by Wagner-Fischer alignment to an alternating grammar.

The turns that a conversation keeps must have the role initials ``(s?(ua)+)?``: nothing, or pairs of user and assistant
after at most one system turn. Faults and edits (costs):

* blank (no character but white space) and duplicate (role and text seen earlier) turns must be deleted;
* truncated turns (the last character ends no sentence) cost 3 unless they are deleted;
* Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty turn of user or assistant 3.

The cheapest edits win; of those that cost the same, the audit (the edits' initials in order) that comes first in ASCII.

*Alignment.* A target is the alternating string of some length. All lengths end alike, so one Wagner-Fischer table of
suffixes holds them all: ``B[i][k]`` aligns the turns from i on with the last k letters of the string. Ukkonen's band
bounds it: an incumbent repair of cost C (left to right, no deletion but the required ones) rules out every cell whose
remaining turns and letters differ by more than C allows. The lengths of least cost are backtraced, and their audits
compared; a system turn can only be kept, so each is tried as the first one.

*Scale.* Conversations are dealt by id, sorted by Spark, and stream through a task, which holds one at a time. One of
more than ``LONG`` turns is never held: duplicates are found by a grouped minimum, turns are dealt by ranges of their
order, runs of ``SEGMENT`` turns are aligned apart for each pair of states of the grammar (nothing yet, after a system
turn, before a user's, before an assistant's), and the runs' tables are joined as a tree. A run's best audit between two
states is part of the whole's best one: audits of equal cost are no prefixes of each other. What one task holds of a long
conversation is its audit (16 bytes a turn), which is one value of the result; its texts stream past the digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from herald.llm.common import BROADCAST_KEYS, SPACE, cut, small_batches, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = ".!?"
LEGAL = ("su", "ua", "au")
#: Turns of a conversation that one task may hold, and of a run of a longer one.
LONG, SEGMENT = 2000, 256
#: States of the grammar: nothing yet, after a system turn, before a user's turn, before an assistant's turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 50
COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "place bigint, edit string, role string, text string"


def incumbent(roles: str, must: list[bool], bad: list[bool], start: int, end: int) -> int:
    """Cost of a repair that deletes what it must, keeps what fits, reroles the rest, and inserts what lacks at the end."""
    state, cost = start, 0
    for r, m, b in zip(roles, must, bad):
        if m:
            cost += DELETE
        elif r == "s" and state == NOTHING:
            state, cost = SYSTEM, cost + TRUNCATED * b
        else:
            cost += TRUNCATED * b + (r != ("a" if state == ASSISTANT else "u")) * REROLE
            state = USER if state == ASSISTANT else ASSISTANT
    return cost + INSERT * (0 if state == end else 1 if ASSISTANT in (state, end) else 2)


class Suffixes:
    """The banded table of a run of turns against the alternating string that ends with the letter ``last``."""

    def __init__(self, roles: str, must: list[bool], bad: list[bool], last: str, most: int) -> None:
        n = len(roles)
        self.roles, self.must, self.bad, self.last, self.n = roles, must, bad, last, n
        #: Column b of row i stands for k = (n - i) - fewer + b letters.
        self.fewer, self.width = most // DELETE, most // DELETE + most // INSERT + 1
        steps = INSERT * np.arange(self.width, dtype=np.int64)
        rows = np.full((n + 1, self.width + 1), FAR, np.int64)  # one more column, always FAR
        k = np.arange(self.width) - self.fewer
        rows[n, :-1] = np.where(k >= 0, INSERT * k, FAR)
        for i in range(n - 1, -1, -1):
            k += 1
            best = rows[i + 1, 1:] + DELETE
            if not must[i]:
                here = REROLE * (self._letters(k) != roles[i]) + TRUNCATED * bad[i]
                best = np.where(k > 0, np.minimum(best, rows[i + 1, :-1] + here), best)
            best = np.where(k >= 0, best, FAR)
            rows[i, :-1] = np.minimum(np.minimum.accumulate(best - steps) + steps, FAR)
        self.rows = rows

    def _letters(self, k):
        """First of the last k letters."""
        other = "u" if self.last == "a" else "a"
        return np.where(k % 2 == 1, self.last, other)

    def letter(self, k: int) -> str:
        return self.last if k % 2 == 1 else "u" if self.last == "a" else "a"

    def cost(self, i: int, k: int) -> int:
        b = k - (self.n - i) + self.fewer
        return int(self.rows[i, b]) if 0 <= b < self.width else FAR

    def lengths(self, i: int, first: str, least: int) -> Iterator[tuple[int, int]]:
        """(cost, k) of the strings of ``least`` letters or more that begin with a letter; an empty one begins with any."""
        low = self.n - i - self.fewer
        for k in range(max(low, least, 0), low + self.width):
            if k == 0 and first != self.last or k > 0 and self.letter(k) == first:
                yield int(self.rows[i, k - low]), k

    def audit(self, i: int, k: int) -> str:
        """The least audit of the cheapest alignment of the turns from i on with the last k letters."""
        out = []
        while i < self.n or k > 0:
            now = self.cost(i, k)
            if i < self.n and DELETE + self.cost(i + 1, k) == now:
                out.append("D")
                i += 1
            elif k > 0 and INSERT + self.cost(i, k - 1) == now:
                out.append("I")
                k -= 1
            else:
                out.append("K" if self.letter(k) == self.roles[i] else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def best_between(roles: str, must: list[bool], bad: list[bool], starts: Iterable[int], ends: Iterable[int]) -> dict[tuple[int, int], tuple[int, str]]:
    """Cost and audit of the best edits of a run of turns that lead from one state of the grammar to another, where there are any."""
    n, out = len(roles), {}
    firsts = [(p, DELETE * p + TRUNCATED * bad[p]) for p in range(n) if roles[p] == "s" and not must[p]]
    for p in set(starts) & set(ends) & {NOTHING, SYSTEM}:
        out[p, p] = (DELETE * n, "D" * n)
    if NOTHING in starts and SYSTEM in ends and firsts:
        out[NOTHING, SYSTEM] = min((c + DELETE * (n - p - 1), "D" * p + "K" + "D" * (n - p - 1)) for p, c in firsts)
    for end in set(ends) & {USER, ASSISTANT}:
        most = max(incumbent(roles, must, bad, start, end) for start in starts)
        held = Suffixes(roles, must, bad, "a" if end == USER else "u", most)
        for start in starts:
            letter, least = ("a" if start == ASSISTANT else "u"), (1 if start in (NOTHING, SYSTEM) else 0)
            found = [(c, 0, k, "") for c, k in held.lengths(0, letter, least)]
            if start == NOTHING:
                found += [(c + d, p + 1, k, "D" * p + "K") for p, d in firsts for c, k in held.lengths(p + 1, "u", 1)]
            cost = min(f[0] for f in found)
            out[start, end] = (cost, min(before + held.audit(i, k) for c, i, k, before in found if c == cost))
    return out


def joined(a: dict, b: dict) -> dict:
    """The table of two runs from those of each."""
    out: dict = {}
    for (p, q), (c, x) in a.items():
        for (s, r), (d, y) in b.items():
            if s == q:
                new = (c + d, x + y)
                if (p, r) not in out or new < out[p, r]:
                    out[p, r] = new
    return out


def initial(role: str | None) -> str:
    """The role's initial; a dot for a null or empty one."""
    return (role or ".")[0]


def blank(text: str | None) -> bool:
    return not (text or "").strip(SPACE)


def truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1] not in ENDS


def gaps(turns: list[int | None]) -> int:
    some = {t for t in turns if t is not None}
    return max(some) - min(some) + 1 - len(some) if some else 0


def applied(audit: str, turns: Iterable[tuple[str | None, str | None]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves or inserts, as the turns (role, text) stream past."""
    rows, letter = iter(turns), "u"
    for e in audit:
        role, text = (None, "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e != "K":
            role = NAMES[letter]
        yield e, role, text
        letter = "u" if e == "K" and initial(role) == "s" or letter == "a" else "a"


def digest(edits: Iterable[tuple[str, str, str]]) -> str:
    held, between = hashlib.sha256(), b""
    for _, role, text in edits:
        held.update(between)
        held.update(f"{role}:{text}".encode())
        between = b"\n"
    return held.hexdigest()


def judged(turns: list[tuple]) -> tuple[str, list[bool], list[bool], tuple[int, int, int, int]]:
    """Initials, which turns must go, which are truncated, and the counts (blank, duplicate, truncated, illegal) of (turn, role, text)s in order."""
    roles = "".join(initial(role) for _, role, _ in turns)
    empty = [blank(text) for *_, text in turns]
    seen: set = set()
    again = [not e and ((role, text) in seen or seen.add((role, text)) is not None) for (_, role, text), e in zip(turns, empty)]
    must = [e or a for e, a in zip(empty, again)]
    bad = [not m and truncated(text) for (*_, text), m in zip(turns, must)]
    return roles, must, bad, (sum(empty), sum(again), sum(bad), sum(x + y not in LEGAL for x, y in zip(roles, roles[1:])))


def whole(turns: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of one conversation."""
    roles, must, bad, counts = judged(turns)
    cost, audit = min(best_between(roles, must, bad, (NOTHING,), (NOTHING, USER)).values())
    return (gaps([t for t, *_ in turns]), *counts, cost, audit)


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _conversations(rows: Iterable[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, [(turn, role, text)]) of rows sorted by conversation."""
    held: list[tuple] = []
    for row in rows:
        if held and row[0] != held[0][0]:
            yield held[0][0], [r[1:] for r in held]
            held = []
        held.append(row)
    if held:
        yield held[0][0], [r[1:] for r in held]


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, str) else 8 for x in row)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


ORDER = ("conv_id", "turn", "role", "text")


def _shape(rows: DataFrame, ddl: str) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *StructType.fromDDL(ddl).fields])


def _mapped(rows: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """Rows of the given shape that ``work`` makes of a partition's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = _shape(rows, ddl)
    small_batches(rows.sparkSession)
    return rows.mapInArrow(lambda batches: _batches(work(_streamed(batches)), to_arrow_schema(shape)), shape)


def _split(conversations: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The turns of conversations that a task may hold, and those of longer ones (None where there are none)."""
    rows = conversations.select(*ORDER)
    ids = cut(rows.groupBy("conv_id").count().where(F.col("count") > most).select(F.col("conv_id").alias("id")))
    n = ids.count()
    if not n:
        return rows, None
    ids = F.broadcast(ids) if n <= BROADCAST_KEYS else ids
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    return rows.join(ids, same, "left_anti"), rows.join(ids, same, "left_semi")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*ORDER)


def _runs(long: DataFrame) -> DataFrame:
    """The runs of long conversations: conv_id, part, run (their order) and ``made``: counts, edges and table of edits, as JSON."""
    rows = long.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(11), "text"), "at": F.struct(F.col("turn").isNotNull().alias("some"), "turn")})
    keys = ("conv_id", "role", "h1", "h2")
    first = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in keys]).agg(F.min("at").alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]
    known = rows.join(first, same).select(*ORDER, (F.col("at") > F.col("first")).alias("seen"))
    stripped = F.rtrim(F.coalesce("text", F.lit("")), F.lit(SPACE))
    # a text is known to Python by its hash and its last character: whether it is blank, truncated, or that of the turn before
    sent = known.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "turn", "role", "seen", F.right(stripped, F.lit(1)).alias("end"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2"))

    def work(stream: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def closed(key, run: int, held: list[tuple]) -> tuple:
            roles, must, bad = "".join(h[1] for h in held), [h[2] or h[3] for h in held], [h[4] for h in held]
            found = best_between(roles, must, bad, range(4), range(4))
            turns = [h[0] for h in held if h[0] is not None]
            made = {"table": [[p, q, c, a] for (p, q), (c, a) in found.items()], "counts": [sum(h[k] for h in held) for k in (2, 3, 4)], "roles": roles[0] + roles[-1], "illegal": sum(x + y not in LEGAL for x, y in zip(roles, roles[1:])), "turns": [turns[0], turns[-1], len(set(turns))] if turns else None}
            return key, part, run, json.dumps(made)

        held, run, last, key = [], 0, None, None
        for conv, turn, role, seen, end, *hashes in stream:
            if held and (conv != key or len(held) == SEGMENT):
                yield closed(key, run, held)
                held, run = [], run + 1
            now = (conv, turn, role, *hashes)
            empty = not end
            again = not empty and (seen or now == last)
            held.append((turn, initial(role), empty, again, not empty and not again and end not in ENDS))
            key, last = conv, now
        if held:
            yield closed(key, run, held)

    return cut(_mapped(sent, work, "part int, run bigint, made string"))


def _folded(runs: DataFrame) -> DataFrame:
    """The runs of each conversation joined as a tree: conv_id and the counts and audit of ``whole``, as JSON."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        made = [json.loads(x) for x in group.sort_values(["part", "run"])["made"]]
        tables = [{(p, q): (c, a) for p, q, c, a in m.pop("table")} for m in made]
        while len(tables) > 1:
            tables = [joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
        cost, audit = min(tables[0][NOTHING, q] for q in (NOTHING, USER) if (NOTHING, q) in tables[0])
        illegal = sum(m["illegal"] for m in made) + sum(x["roles"][1] + y["roles"][0] not in LEGAL for x, y in zip(made, made[1:]))
        turns = [m["turns"] for m in made if m["turns"]]
        distinct = sum(t[2] for t in turns) - sum(x[1] == y[0] for x, y in zip(turns, turns[1:]))
        blanks, again, bad = (sum(m["counts"][k] for m in made) for k in range(3))
        missing = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "found": [json.dumps([missing, blanks, again, bad, illegal, cost, audit])]})

    return runs.groupBy("conv_id").applyInPandas(fold, _shape(runs, "found string"))


def _with_heads(long: DataFrame) -> DataFrame:
    """The sorted turns of long conversations, each after a row whose ``found`` has its counts and audit."""
    heads = _folded(_runs(long))
    nothing = lambda c: F.lit(None).cast(long.schema[c].dataType).alias(c)
    both = long.select(*ORDER, F.lit(None).cast("string").alias("found")).unionByName(heads.select("conv_id", *[nothing(c) for c in ORDER[1:]], "found"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("found").isNull(), *ORDER[1:])


def _long_streams(stream: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, found, iterator of (role, text)); the iterator has to be used up before the next one."""
    rows = iter(stream)
    head = next(rows, None)
    while head is not None:
        following: list = [None]

        def texts() -> Iterator[tuple]:
            for row in rows:
                if row[4] is not None:
                    following[0] = row
                    return
                yield row[2], row[3]

        turns = texts()
        yield head[0], json.loads(head[4]), turns
        for _ in turns:
            pass
        head = following[0]


def repairs(conversations: DataFrame, most: int = LONG) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    Turns are taken by turn (null first), then by role and text, so equal rows stand together. A null text is blank; a
    null or empty role is illegal beside any other and can only be changed or deleted; turns with a null conv_id are one
    conversation; equal rows are duplicates of the first; a conversation of any length is repaired whole; an empty table
    gives no rows; other columns are not used, whatever their names.
    """
    short, long = _split(conversations, most)

    def work(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in _conversations(stream):
            found = whole(turns)
            yield conv, *found, digest(applied(found[-1], ((role, text) for _, role, text in turns)))

    out = _mapped(_dealt(short), work, COUNTS)
    if long is None:
        return out

    def streamed(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, found, turns in _long_streams(stream):
            yield conv, *found, digest(applied(found[-1], turns))

    return out.unionByName(_mapped(_with_heads(long), streamed, COUNTS))


def repaired_turns(conversations: DataFrame, most: int = LONG) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the turns of each repaired conversation. Awkward rows are as in ``repairs``."""
    short, long = _split(conversations, most)

    def work(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in _conversations(stream):
            for place, turn in enumerate(applied(whole(turns)[-1], ((role, text) for _, role, text in turns))):
                yield conv, place, *turn

    out = _mapped(_dealt(short), work, TURNS)
    if long is None:
        return out

    def streamed(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, found, turns in _long_streams(stream):
            for place, turn in enumerate(applied(found[-1], turns)):
                yield conv, place, *turn

    return out.unionByName(_mapped(_with_heads(long), streamed, TURNS))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the query's damage, by crc32 of ``conv_id:turn`` (null: one space) modulo 20."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(*ORDER, (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conv_id of the table; one none of whose turns is left has zeros, an empty audit and the hash of nothing."""
    conversations = table(spark, sf_dir, "conversations")
    found = repairs(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
