"""Operator 10: BPE encoding and decoding by per-prefix dynamic programming.

The BPE encoding of every prefix of a piece ends in one token. An automaton over the vocabulary gives, at each end,
the tokens that match there; the one that belongs is a token before which the prefix's own last token can stand, that
is, a pair that BPE would leave as it is. That test follows the two tokens' merges backwards from their common edge.
The last tokens are stored per prefix and followed back from the end, so ids are exact and time is linear in the piece.

Spark deals the texts; a worker encodes Arrow batches and keeps what it has encoded for words, up to ``CACHE`` of them.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from herald.llm.common import small_batches, table

#: Words and pieces whose ids a worker keeps; both are emptied when full, so its memory is bounded.
CACHE = 500_000
END = "</w>"
#: Stands for the end of a piece in the automaton; not among the characters that stand for bytes.
STOP = "\x00"
NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """One vocabulary file: text to ids and back."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: name for name, i in [*vocab.items(), *self.special.items()]}
        self.split_special = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = regex.compile(pattern).findall
        new = unknown()
        has_new = regex.compile(f"[{new}]").search
        letters, digits, rest = r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"
        other = pattern.replace(letters, rf"(?:(?![{new}])\p{{L}})+").replace(rest, rf"(?:[^\s\p{{L}}\p{{N}}]|[{new}])+").replace(digits, rf"(?![{new}])\p{{N}}")
        with_new = regex.compile(other).findall
        self.pieces = lambda text: (with_new if not text.isascii() and has_new(text) else plain)(text)
        self.characters = dict(enumerate(byte_characters()))
        # of each token: the merge that makes it, and its two halves; of each pair, its merge
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), rank)
            self.made.setdefault(whole, (rank, left, right))
        self.limit = CACHE
        self.fits_cache: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for name, token in vocab.items():
            if self.own(token):
                key = name[: -len(END)] + STOP if name.endswith(END) else name
                self.automaton.add_word(key, (len(key) - key.endswith(STOP), token, key.endswith(STOP)))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[bytes, str]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def own(self, token: int) -> bool:
        """Whether BPE turns the token's text into this one token: its halves are such tokens, and nothing joins first."""
        if token not in self.made:
            return True
        rank, left, right = self.made[token]
        return self.own(left) and self.own(right) and self.fits(left, right, rank)

    def fits(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge before ``until`` joins what stands on either side of the edge between two tokens.

        Goes back in time from the finished tokens, taking apart the piece at the edge that was made last. A pair of
        pieces side by side is joined if its merge comes before the merges that use up either piece; of equal merges
        the leftmost pair goes first, so an equal merge of the left piece wins and one of the right piece loses.
        """
        left_ends, right_ends = until, until - 1
        while True:
            joined = self.rank.get((left, right), NEVER)
            if joined < left_ends and joined <= right_ends:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if not a and not b:
                return True
            if not b or a and a[0] > b[0]:
                left_ends, left = a[0], a[2]
            else:  # of two pieces made by one merge, the right one came last
                right_ends, right = b[0], b[1]

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits_cache.get((left, right))
        if found is None:
            if len(self.fits_cache) >= 4 * self.limit:
                self.fits_cache.clear()
            found = self.fits_cache[left, right] = self.fits(left, right)
        return found

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece (not empty)."""
        mapped = "".join(map(self.characters.__getitem__, text.encode()))
        n = len(mapped)
        last: list[tuple[int, int] | None] = [None] * (n + 1)  # of each prefix: its last token and where that starts
        final = None
        for end, (length, token, stops) in self.automaton.iter(mapped + STOP):
            stop = end if stops else end + 1
            if stops:
                if final is None and self.follows(last, stop - length, token):
                    final = (token, stop - length)
            elif last[stop] is None and self.follows(last, stop - length, token):
                last[stop] = (token, stop - length)
        ids = []
        while final is not None:
            ids.append(final[0])
            final = last[final[1]] if final[1] else None
        return tuple(reversed(ids))

    def follows(self, last: list, start: int, token: int) -> bool:
        if start == 0:
            return True
        before = last[start]
        return before is not None and self.compatible(before[0], token)

    def word(self, text: str) -> tuple[bytes, str]:
        """Ids (little-endian, 32 bits) and token names of a normalized text without white space."""
        ids: list[int] = []
        for piece in self.pieces(text):
            found = self.known.get(piece)
            if found is None:
                found = self.piece(piece)
                if len(piece) < 64:
                    if len(self.known) >= self.limit:
                        self.known.clear()
                    self.known[piece] = found
            ids += found
        out = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.names.__getitem__, ids))
        if len(text) < 64:
            if len(self.words) >= self.limit:
                self.words.clear()
            self.words[text] = out
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(ids for ids, _ in self._parts(text))

    def decode(self, ids: bytes) -> str:
        """The text that the ids stand for: the tokens' names, with a space between."""
        return " ".join(map(self.names.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))

    def _parts(self, text: str) -> Iterator[tuple[bytes, str]]:
        known = self.words
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield struct.pack("<I", self.special[part]), part
            elif part:
                for w in normalized(part).split(" "):
                    if w:
                        yield known.get(w) or self.word(w)

    def both(self, text: str) -> tuple[bytes, str]:
        """encode(text) and its decode()."""
        parts = [x for x in self._parts(text) if x[0]]
        return b"".join(x[0] for x in parts), " ".join(x[1] for x in parts)


#: What the vocabulary's normalizer takes for white space. Fixed values.
_SPACES = dict.fromkeys([*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], " ")
#: Lower case of letters that the normalizer knows and this Python's tables may not yet. Fixed values.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: A final sigma is not a case of its own.
_CHANGED = _SPACES | _LOWER | {ord("Σ"): "σ"}


def normalized(text: str) -> str:
    """Composed, white space as spaces, lower case letter by letter."""
    if text.isascii():
        return text.translate(_SPACES).lower()
    return unicodedata.normalize("NFC", text).translate(_CHANGED).lower()


#: Ranges with letters and digits that the regex library knows and the vocabulary's splitter does not. Fixed values.
_LATER = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F "
)


def unknown() -> str:
    """A character class of those letters and digits."""
    return "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in _LATER.split())


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(documents: DataFrame, path: str | None = None, ids: bool = True, cache_words: int = CACHE) -> DataFrame:
    """doc_id, ids (array of int), decoded; with ids=False the digests of the query op10.

    A null or empty text has no ids and decodes to an empty text; rows that repeat are encoded alike; other columns are
    not used. A worker keeps up to ``cache_words`` words' ids. The vocabulary's file is read on every executor.
    """
    small_batches(documents.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path or vocabulary())
        e.limit = cache_words
        for batch in batches:
            rows = [e.both(t or "") for t in batch["text"]]
            if ids:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [list(struct.unpack(f"<{len(b) // 4}I", b)) for b, _ in rows], "decoded": [d for _, d in rows]})
            else:
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"], "n_tokens": [len(b) // 4 for b, _ in rows], "ids_sha256": [hashlib.sha256(b).hexdigest() for b, _ in rows],
                    "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in rows],
                })

    shape = "doc_id bigint, ids array<int>, decoded string" if ids else "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInPandas(work, shape)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ids=False)
