"""Operator 5: personal data (DataFrame functions only).

Regular expressions propose spans; validators confirm them (Luhn for cards, mod-97 for bank account numbers, part and
digit limits for addresses and telephones); words near a span adjust its score: those that speak for the kind add to
it, those that speak against it (an order number, a serial number) take off. The four base kinds are kept whenever their
rule holds, whatever the score says; the method adds bank account numbers (``iban``) whose score reaches ``KEEP``. One
in 97 strings of that form holds by chance, so the check alone does not suffice: it takes the length that its country
prescribes and no word against it, or a word for it.

Positions are code points, from the lengths of what stands between matches. The patterns below find the same matches
as the plain ones in the kinds' rules, but start only where a match can start, so a long run of word characters or
digits costs time in proportion to its length: ``(?:\\G|(?<!c))`` is the end of the last match or the start of a run.

An account number may be followed by a word in capitals, a BIC or a figure, which its pattern cannot tell from its own
groups. So every place where one can start is tried, and the ends at which a group ends: that of the country's length
first, then, for a country not listed, the longest that mod-97 confirms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.llm.common import table

#: Code points on either side of a span in which context words count.
NEAR = 48
KEEP = 75
#: Points of a known country's length, of a word for the kind, and of a word against it.
LENGTH_POINTS, FOR_POINTS, AGAINST_POINTS = 15, 15, -15


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Score (0 to 100) of a match that its validator confirmed, before context.
    score: int
    context: str
    against: str
    base: bool = True


# The kinds, their patterns and the words that speak for and against them.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 80, r"mail|write|contact|correo|courriel|adresse", r"example|git"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 70, r"\bip\b|host|server|address|serv|rechner", r"version|release|section|chapter"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", 70, r"card|visa|credit|payment|tarjeta|carte|karte", r"order|serial|isbn|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 70, r"phone|call|mobile|fax|tel\b|tel[eé]f|appel|anruf", r"order|serial|score"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", 60, r"iban|bank|account|konto|cuenta|compte|bic", r"order|serial|isbn|tracking|part no|model|ref\b|bestell|pedido|commande", base=False),
)


#: Characters of a country's account numbers, without spaces.
LENGTHS = {
    n: countries.split()
    for n, countries in {
        15: "NO", 16: "BE BI", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BF DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """Rest of an account number by 97: the first four characters go last, letters count 10 to 35."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _bare(match: Column) -> Column:
    """Characters of an account number, spaces left out."""
    return F.char_length(F.replace(match, F.lit(" "), F.lit("")))


def _prescribed(match: Column) -> Column:
    country = F.substring(match, 1, 2)
    return F.coalesce(*[F.when(country.isin(names), F.lit(n)) for n, names in LENGTHS.items()])


def _account(run: Column) -> Column:
    """The account number that a run of groups begins with; null if none does."""
    groups = F.split(run, " ")
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")), lambda m: _bare(m).between(15, 34) & ~m.rlike("[a-z]"))
    length = _prescribed(run)
    valid = F.filter(ends, lambda m: _mod97(m) == 1)
    exact = F.filter(valid, lambda m: _bare(m) == length)
    other = F.filter(valid, lambda m: length.isNull() | (m == F.get(ends, F.size(ends) - 1)))
    return F.coalesce(F.get(exact, F.lit(0)), F.get(other, F.size(other) - 1))


def _accounts(placed: Column) -> Column:
    """The spans that are account numbers, none of which begins in the one before it."""
    ends = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.char_length(_account(s["match"]))).alias("end"), _account(s["match"]).alias("match")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.aggregate(F.filter(ends, lambda s: s["match"].isNotNull()), none, lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), acc).otherwise(F.concat(acc, F.array(s))))


def _valid(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind.name == "card":
        return F.char_length(_digits(match)).between(13, 19) & F.call_function("luhn_check", _digits(match))
    if kind.name == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of the matches of a kind that hold, in the order in which they stand."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.name == "iban":  # the match is the first four characters only, so that each start is tried; what follows is looked at
        after = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))
        found = F.zip_with(found, after, lambda head, rest: F.concat(head, rest))
    laid = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), found.alias("match"))  # the last gap has no match
    state = "struct<at:int,spans:array<struct<start:int,end:int,match:string>>>"
    start = lambda acc, x: acc["at"] + F.char_length(x["gap"])

    def step(acc: Column, x: Column) -> Column:
        end = start(acc, x) + (F.lit(4) if kind.name == "iban" else F.char_length(x["match"]))
        span = F.struct(start(acc, x).alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.when(x["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    placed = F.aggregate(laid, F.from_json(F.lit('{"at":0,"spans":[]}'), state), step)["spans"]
    if kind.name == "iban":
        placed = _accounts(placed)

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substr(text, begin + 1, s["start"] - begin), F.substr(text, s["end"] + 1, F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), FOR_POINTS).otherwise(0) + F.when(near.rlike(kind.against), AGAINST_POINTS).otherwise(0)
        if kind.name == "iban":
            score += F.when(_prescribed(s["match"]) == _bare(s["match"]), LENGTH_POINTS).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    return F.filter(F.transform(F.filter(placed, lambda s: _valid(kind, s["match"])), scored), lambda s: F.lit(kind.base) | (s["score"] >= KEEP))


def find(documents: DataFrame) -> DataFrame:
    """The input's columns and ``pii``: array of (kind, start, end, score), by kind as in KINDS, then by start.

    A null or empty text has none; repeated rows are searched alike; a very long text is searched whole; spans of
    different kinds may overlap, those of one kind never do; an empty table gives no rows; an input column ``pii`` is
    replaced, all others stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # a cheap test first: most texts hold no proposal of a kind at all
    hints = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"\+[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}")}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:int>>")
    return documents.withColumn("pii", F.concat(*[F.when(hints[k.name], _spans(text, k)).otherwise(none) for k in KINDS]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in KINDS if k.base]))
    of = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("bigint").alias(f"n_{name}")
    counts = [of(k.name) for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def _found_sql(kind: str, pattern: str) -> str:
    """Rows (doc_id, kind, begin, finish, match) of a pattern, from the lengths of gaps and matches."""
    return f"""select doc_id, '{kind}' as kind, m.b as begin, m.b + length(m.x) as finish, m.x as match from (select doc_id, unnest(list_transform(range(1, len(found) + 1),
      lambda i: {{'b': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0), 'x': found[i]}})) as m
      from (select doc_id, regexp_extract_all(t, '{pattern}') as found, regexp_split_to_array(t, '{pattern}') as gaps from docs))"""


_DIGITS_SQL = "regexp_replace(match, '[^0-9]', '', 'g')"
_LUHN_SQL = f"""list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i: case when (length({_DIGITS_SQL}) - i) % 2 = 0 then cast({_DIGITS_SQL}[i] as int)
  else 2 * cast({_DIGITS_SQL}[i] as int) - case when cast({_DIGITS_SQL}[i] as int) > 4 then 9 else 0 end end)) % 10 = 0"""
_TURNED_SQL = "replace(match, ' ', '')[5:] || replace(match, ' ', '')[1:4]"
_MOD97_SQL = f"""list_reduce(list_prepend(0, list_transform(string_split({_TURNED_SQL}, ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)),
  lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) = 1"""
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(match, '.'), lambda p: length(ltrim(p, '0')) <= 3 and cast('0' || right(p, 3) as int) <= 255))"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS_SQL}) between 13 and 19 and {_LUHN_SQL}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_SQL}) between 9 and 15"),
}
_LENGTH_SQL = "case " + " ".join(f"when {{0}}[1:2] in ({', '.join(map(repr, names))}) then {n}" for n, names in LENGTHS.items()) + " end"
_BARE_SQL = "length(replace({}, ' ', ''))"
#: Account numbers: every place where one can start, every end of a group, and of those that hold the one to take.
_ACCOUNTS_SQL = f"""starts as (select doc_id, t, unnest(list_filter(range(1, length(t) + 1), lambda i: regexp_matches(t[i:i + 4], '^[A-Z]{{2}}[0-9]{{2}}') and not regexp_matches(t[i - 1:i - 1], '[A-Za-z0-9]'))) as i from docs where regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}}')),
groups as (select doc_id, i, t[i:i + 3] || r as run, string_split(t[i:i + 3] || r, ' ') as parts from (select *, regexp_extract(t[i + 4:i + 80], '^(?:\\x20?[A-Z0-9]){{11,30}}[A-Za-z0-9]?') as r from starts) where r <> ''),
finals as (select doc_id, i, {_LENGTH_SQL.format('run')} as prescribed, list_filter(list_transform(range(1, len(parts) + 1), lambda n: array_to_string(parts[1:n], ' ')), lambda m: {_BARE_SQL.format('m')} between 15 and 34 and not regexp_matches(m, '[a-z]')) as ends from groups),
ends as (select doc_id, i, prescribed, n, ends[n] as match, n = len(ends) as longest from finals, unnest(range(1, len(ends) + 1)) as u(n)),
held as (select *, {_BARE_SQL.format('match')} = prescribed as exact from ends where {_MOD97_SQL}),
accounts as (select doc_id, i - 1 as begin, i - 1 + length(match) as finish, match, coalesce(exact, false) as exact from held where exact or prescribed is null or longest
  qualify row_number() over (partition by doc_id, i order by coalesce(exact, false) desc, case when exact then n else -n end) = 1)"""


def _scored_sql(kind: Kind) -> str:
    near = f"lower(t[greatest(begin - {NEAR}, 0) + 1:begin] || ' ' || t[finish + 1:finish + {NEAR}])"
    return f"{kind.score} + case when regexp_matches({near}, '{kind.context}') then {FOR_POINTS} else 0 end + case when regexp_matches({near}, '{kind.against}') then {AGAINST_POINTS} else 0 end"


_LIST_SQL = "coalesce(string_agg(kind || ':' || begin || ':' || finish, ',' order by k, begin){}, '')"
#: The kinds by the plain patterns.
SQL = (
    f"with docs as (select doc_id, coalesce(text, '') as t from documents), {_ACCOUNTS_SQL}, spans as ("
    + " union all ".join(f"select s.doc_id, kind, begin, finish, {_scored_sql(kind)} as score, {k} as k from ({_found_sql(kind.name, _PLAIN[kind.name][0])}) s join docs d on s.doc_id = d.doc_id where {_PLAIN[kind.name][1]}" for k, kind in enumerate(KINDS) if kind.base)
    + f""" union all select * from (select a.doc_id, 'iban' as kind, begin, finish, {_scored_sql(KINDS[-1])} + case when exact then {LENGTH_POINTS} else 0 end as score, 4 as k from accounts a join docs d on a.doc_id = d.doc_id) where score >= {KEEP}),
listed as (select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
  {_LIST_SQL.format(" filter (where k < 4)")} as base, {_LIST_SQL.format("")} as spans, string_agg(score, ',' order by k, begin) as scores from spans group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from docs d left join listed l on d.doc_id = l.doc_id"""
)
