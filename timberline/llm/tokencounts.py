"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For byte-pair encodings the ids of a string are those of a shorter prefix plus
one last token: the longest token that ends there and stays apart from the last
token of that prefix. So one pass over a word gives the count of each of its
prefixes, count[i] = count[i - length of the last token] + 1. Two tokens stay
apart if undoing their merges, the latest first, never meets a pair at their
border that would have merged earlier.

The tokenizer breaks before each run of white space, so a text's counts are
those of its units (white space, then a word), added up; a unit's counts hold
for all texts. The counts of a text are kept as steps from one code point to the
next, two bytes each. They need not rise: a longer prefix may have fewer tokens.
Truncation and budget questions are answered from them, without the text.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import boxed, table, unboxed
from timberline.llm.tokens import KNOWN_LETTERS, SPACE, SPACED_PARTS, byte_letters

# The contractions of more than one letter.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
SPACES = "".join(c for c in map(chr, range(0x3001)) if regex.match(f"[{SPACE}]", c))

CACHE_UNITS = 500_000
CACHE_PARTS = 300_000
CACHE_LENGTH = 64
SEEN_PAIRS = 500_000
CHUNK_CHARS = 1_000_000


def _packed(steps: Iterable[int]) -> bytes:
    """As little-endian 16-bit integers; an OverflowError beyond."""
    steps = array("h", steps)
    if sys.byteorder != "little":
        steps.byteswap()
    return steps.tobytes()


class PrefixCounter:
    """Counts for a byte-level BPE file of the tokenizers library, with its default treatment of special strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if (model.get("type") != "BPE" or not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex")
                or pre.get("add_prefix_space") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = byte_letters()
        number = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        size = max(number.values()) + 1
        self.rank, self.left, self.right, self.pairs = [-1] * size, [-1] * size, [-1] * size, {}
        self.ids = {t: i for t, i in number.items() if len(t) == 1}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in half) for half in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = number[a + b]
            if self.rank[whole] >= 0:
                raise ValueError(f"{path}: two merges make one token")
            self.left[whole], self.right[whole] = number[a], number[b]
            self.pairs[number[a] << 32 | number[b]] = self.rank[whole] = rank
            if a in self.ids and b in self.ids and self.apart(number[a], number[b], rank):  # its bytes do become this token
                self.ids[a + b] = whole
        self.tails = {t[k:]: -1 for t in self.ids for k in range(len(t))} | self.ids  # ends of tokens; the id of one that is a token
        # A walk along a string is in a state: the longest of its ends that begins a token. Each has the tokens that end there, longest
        # first (length, id, and whether it stays apart from the tokens met before it), the states after one more byte, and the end itself.
        self.states: dict[bytes, tuple | None] = {t[:k]: None for t in self.ids for k in range(1, len(t) + 1)}
        self.states[b""] = [], {}, b""
        self.seen: dict[int, dict[int, bool]] = {}
        self.moves = self.met = 0
        self.path: tuple = b"", [self.states[b""]], [0], [0]
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.parts: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def apart(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Tokens ``a`` and ``b`` side by side stay two tokens (up to the merge ``limit``)."""
        rank, left, right, pairs = self.rank, self.left, self.right, self.pairs
        while True:
            met = pairs.get(a << 32 | b)
            if met is not None and met < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, right[a]
            elif rb >= 0:
                limit, b = rb + 1, left[b]  # on equal ranks the left pair merges first
            else:
                return True

    def _move(self, state: tuple, byte: int) -> tuple:
        """The state after one more byte."""
        end = state[2] + bytes([byte])
        while end not in self.states:
            end = end[1:]
        if not end:
            raise ValueError(f"no token for byte {byte}")
        to = self.states[end]
        if to is None:
            found, s = [], len(end) - 1
            while s >= 0 and (t := self.tails.get(end[s:])) is not None:
                if t >= 0:
                    found.append((len(end) - s, t, self.seen.setdefault(t, {})))
                s -= 1
            to = self.states[end] = found[::-1], {}, end
        self.moves += 1
        if self.moves > SEEN_PAIRS:
            self.moves = 1
            for known in filter(None, self.states.values()):
                known[1].clear()
        state[1][byte] = to
        return to

    def _meet(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart, to be remembered."""
        self.met += 1
        if self.met > SEEN_PAIRS:
            self.met = 1
            for known in self.seen.values():
                known.clear()
        fits = self.seen[b][a] = self.apart(a, b)
        return fits

    def word(self, raw: bytes) -> list[int]:
        """Counts of the prefixes of 0, 1, ... bytes of a string that the tokenizer does not break.

        What it shares with the beginning of the string before it is not walked again.
        """
        before, at, last, count = self.path
        k = 0
        for a, b in zip(raw, before):
            if a != b:
                break
            k += 1
        del at[k + 1:], last[k + 1:], count[k + 1:]
        self.path = raw[:k], at, last, count
        state, i = at[k], k
        for byte in raw[k:]:
            i += 1
            state = state[1].get(byte) or self._move(state, byte)
            for n, t, apart in state[0]:
                if n == i:  # all of it is a token
                    break
                fits = apart.get(last[i - n])
                if fits is None:
                    fits = self._meet(last[i - n], t)
                if fits:
                    break
            at.append(state)
            last.append(t)
            count.append(count[i - n] + 1)
        self.path = (raw, at, last, count) if i <= CACHE_LENGTH else (b"", [self.states[b""]], [0], [0])
        return count[:]

    def _word(self, part: str) -> bytes:
        """Steps of one of the tokenizer's parts."""
        steps = self.parts.get(part)
        if steps is not None:
            return steps
        raw = part.encode()
        count = self.word(raw)
        if len(raw) > len(part):
            count = [c for c, b in zip(count, raw + b"a") if b & 0xC0 != 0x80]
        if part in LONG_CONTRACTIONS:  # a contraction cut short is a mark and a letter
            count[2] = count[1] + self.word(raw[1:2])[-1]
        steps = _packed(map(sub, count[1:], count))
        if len(part) <= CACHE_LENGTH:
            if len(self.parts) > CACHE_PARTS:
                self.parts.clear()
            self.parts[part] = steps
        return steps

    def _runs(self, unit: str, lead: int) -> list[str]:
        """The tokenizer's parts of the word of a unit, with the last white space before it."""
        if unit.isascii() or max(unit) <= KNOWN_LETTERS:
            return SPACED_PARTS.findall(unit, lead)
        return [unit[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(unit) if b > lead]

    def unit(self, unit: str) -> bytes:
        """Steps of a unit from one code point to the next, little-endian 16-bit."""
        if unit[0] not in SPACES or unit[1:2] not in SPACES:
            return b"".join(map(self._word, self._runs(unit, 0)))
        m = len(unit) - len(unit.lstrip(SPACES))
        lead = self._word(unit[:m])
        if m == len(unit):
            return lead
        # the white space is one part until the word begins; then its last character goes to the word, or stays a part of its own
        before, own = (np.frombuffer(x, "<i2").tolist() for x in (lead, b"".join(map(self._word, self._runs(unit, m - 1)))))
        return _packed([*before, own[0] + own[1] - before[-1], *own[2:]])

    def _known(self, units: Iterable[str]) -> dict[str, bytes]:
        """Steps of all units, other ones may be among them; two generations of units are remembered.

        New ones are taken in their order, so that each shares as much as it can with the one before it.
        """
        if len(self.young) > CACHE_UNITS:
            self.young, self.old = {}, self.young
        young, long = self.young, {}
        units = set(units)
        for u in sorted(units.difference(young)):
            (young if len(u) <= CACHE_LENGTH else long)[u] = self.old.get(u) or self.unit(u)
        return {u: young[u] for u in units.difference(long)} | long if long else young

    def _special_steps(self, text: str) -> bytes:
        """Steps of a text with special strings: each is one token once it is complete, and ordinary text before."""
        out, at = [], 0
        for m in self.special.finditer(text):
            part = self._plain(text[at:m.end() - 1])
            counts = np.cumsum(np.frombuffer(part, "<i2"), dtype=np.int64)
            before = int(counts[m.start() - at - 1]) if m.start() > at else 0
            out += [part, np.array([before + 1 - (int(counts[-1]) if len(counts) else 0)]).astype("<i2").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        units = UNIT.findall(text)
        return b"".join(map(self._known(units).__getitem__, units))

    def steps(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """Steps of each text; NULL is empty."""
        i = 0
        while i < len(texts):
            part, chars = [], 0
            while i < len(texts) and (not part or chars < CHUNK_CHARS):
                part.append(texts[i] or "")
                chars += len(part[-1])
                i += 1
            rare = [self.special is not None and self.special.search(t) is not None for t in part]
            lists = [[] if r else UNIT.findall(t) for t, r in zip(part, rare)]
            known = self._known(chain.from_iterable(lists))
            for t, r, units in zip(part, rare, lists):
                yield self._special_steps(t) if r else b"".join(map(known.__getitem__, units))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix whose count is at most ``budget``; ``counts[i]`` is that of ``i + 1`` code points."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) and budget >= 0 else 0


# --- tables --------------------------------------------------------------

def _table(path: str, budgets: Sequence[int], stored: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            size, chars, tokens, within, steps = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, raw in zip(texts, of.steps(texts)):
                counts = np.cumsum(np.frombuffer(raw, "<i2"), dtype=np.int64)
                size.append(len((text or "").encode()))
                chars.append(len(counts))
                tokens.append(int(counts[-1]) if len(counts) else 0)
                within.append([longest_within(counts, b) for b in budgets])
                if stored:
                    steps.append(raw)
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in (size, chars, tokens)), pa.array(within, pa.list_(pa.int64()))]
            names = ["row", "n_bytes", "n_chars", "n_tokens", "within"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(steps, pa.binary())] if stored else []), names + (["steps"] if stored else []))
    return run


def prefix_table(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), text: str = "text", budgets: Sequence[int] = (),
                 stored: bool = True) -> DataFrame:
    """Columns ``keep`` of every row with ``n_bytes, n_chars, n_tokens, within, steps`` of its whole text.

    ``steps`` holds the token count of every prefix (see ``tokens_of``, ``prefix_within``); ``within`` lists, for each of
    ``budgets``, the code points of the longest prefix of at most that many tokens. NULL and empty texts have no prefix.
    Rows are independent of each other, repeated ones too; kept columns with a name of the result are replaced. Without
    ``stored`` the steps are left out. Special strings inside texts are one token, as the library has it by default.
    """
    kept = boxed(docs.select(*[F.col(f"`{c}`") for c in keep]).limit(0)).schema["row"].dataType
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    more = ["n_bytes", "n_chars", "n_tokens", "within", *(["steps"] if stored else [])]
    ddl = f"row {kept.simpleString()}, n_bytes long, n_chars long, n_tokens long, within array<long>" + (", steps binary" if stored else "")
    return unboxed(rows.mapInArrow(_table(tokenizer, budgets, stored), ddl), list(keep), *more)


def tokens_of(steps: Column, chars: Column) -> Column:
    """Token count of the first ``chars`` code points, from stored steps; longer prefixes count as the whole text."""
    @F.pandas_udf("long")
    def count(steps: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(s, "<i2")[:max(0, int(n))].sum(dtype=np.int64)) if s is not None and n == n and n is not None else None
                          for s, n in zip(steps, chars)], dtype="Int64")
    return count(steps, chars)


def prefix_within(steps: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from stored steps."""
    @F.pandas_udf("long")
    def longest(steps: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([longest_within(np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64), int(b)) if s is not None and b == b and b is not None else None
                          for s, b in zip(steps, budget)], dtype="Int64")
    return longest(steps, budget)


def truncated(docs: DataFrame, tokenizer: str, budget: int, text: str = "text") -> DataFrame:
    """``docs`` with every text cut to its longest prefix of at most ``budget`` tokens; NULL stays NULL."""
    cut = prefix_table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text")),
                       tokenizer, ["doc"], "text", [budget], stored=False)
    short = F.substring(F.col(f"doc.`{text}`"), F.lit(1), F.col("within")[0].cast("int"))
    return cut.select(*[(short if c == text else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


LIMIT = 512


def op11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all ``documents``, and how much of each fits into 512 tokens."""
    import public_tokenizers
    found = prefix_table(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budgets=[LIMIT], stored=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.col("within")[0].alias("chars_in_limit"))
