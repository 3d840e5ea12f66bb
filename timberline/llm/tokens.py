"""Token ids of texts by a tokenizer file, encoded unit by unit with a bounded cache."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

# The white space of the tokenizers' pattern class \s.
SPACE = "\t-\r \x85\xa0  -     　"
# A run of white space gives its last character to the word that follows it.
SPACED_UNIT = re.compile(f"[{SPACE}]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])")
# White space that no text is cut at, and a blank or line break that such a cut would take out of a longer run.
OTHER_SPACE = re.compile(f"[{SPACE}]".replace(" ", "", 1).replace("\t-\r", "\t\x0b-\r"))
RAGGED = re.compile(f"[{SPACE}][ \n](?:[{SPACE}]|\\Z)")
# The split of the word-level vocabularies.
BARE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BARE_UNIT = re.compile(f"[^{SPACE}]+")

# Classes of code points up to here do not depend on the Unicode version, and each is its own composed form.
KNOWN_LETTERS = "\u024f"
_LETTERS, _DIGITS = ("".join(re.escape(chr(i)) for i in range(ord(KNOWN_LETTERS) + 1) if unicodedata.category(chr(i))[0] == kind) for kind in "LN")
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
# The parts that the two known pre-tokenizers make of a unit.
SPACED_PARTS = re.compile(f"{_CONTRACTED}| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{SPACE}{_LETTERS}{_DIGITS}]+|[{SPACE}]+")
BARE_PARTS = re.compile(f"{_CONTRACTED}|[{_LETTERS}]+|[{_DIGITS}]|[^{SPACE}{_LETTERS}{_DIGITS}]+")

CACHE_UNITS = 500_000
CACHE_PARTS = 300_000
CACHE_LENGTH = 32
CHUNK_CHARS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


BYTE_LETTERS = {b: c for c, b in byte_letters().items()}


def _little(ids: array) -> bytes:
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


class Encoder:
    """Encodes whole texts; equal to the library's encoding of each text.

    Where the tokenizer always breaks before a word's white space, a text is
    encoded as the sequence of its words, and each distinct word once while the
    cache holds it: two generations of words are remembered. A new word of known
    letters is split into the pre-tokenizer's parts here and the library's model
    encodes those; any other word goes through the whole library.
    Words that take their white space along are found by cutting the text before
    blanks and line breaks, and the cache knows them by what is left: ``a`` for
    `` a``, ``\\na`` for itself, any other word with a blank before it.
    Other tokenizers get the whole text.
    Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.model = self.lib.model
        self.vocabulary = self.lib.get_vocab_size()
        with open(path) as f:
            spec = json.load(f)
        self.unit = self._unit(spec.get("normalizer"), spec.get("pre_tokenizer") or {})
        self.lower = self.unit is BARE_UNIT
        self.split = BARE_PARTS if self.lower else SPACED_PARTS
        self.parts: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _unit(normalizer: dict | None, pre: dict) -> re.Pattern | None:
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return SPACED_UNIT
        steps = pre.get("pretokenizers") or []
        kinds = [n["type"] for n in (normalizer or {}).get("normalizers", [])]
        split = steps[0] if steps and steps[0]["type"] == "Split" else None
        if (split and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") == BARE_PATTERN
                and kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps[1:]] == ["ByteLevel"]
                and not any(s.get("use_regex") or s.get("add_prefix_space") for s in steps[1:])):
            return BARE_UNIT
        return None

    def _encode(self, units: list[str]) -> list[bytes]:
        return [_little(array("I", e.ids)) for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]

    def _part_ids(self, part: str, keep: bool = True) -> bytes:
        if part[0] == " " and part[1:2] not in ("", " ", "\n") and self.unit is SPACED_UNIT:  # it may be a word of its own
            ids = self.cache.get(part[1:]) or self.older.get(part[1:])
            if ids:
                return ids
        if part.isascii() and part.isprintable():
            letters = part.replace(" ", BYTE_LETTERS[32])
        else:
            letters = part.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = _little(array("I", [t.id for t in self.model.tokenize(letters)]))
        if keep and len(part) <= CACHE_LENGTH:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            self.parts[part] = ids
        return ids

    def _unit_ids(self, unit: str) -> bytes:
        word = unit.lower() if self.lower else unit
        if not word.isascii() and max(word) > KNOWN_LETTERS:
            return self._encode([unit])[0]
        known = self.parts
        parts = self.split.findall(word)
        if len(parts) == 1:  # the cache of words keeps it
            return known.get(word) or self._part_ids(word, word != unit or len(unit) > CACHE_LENGTH)
        return b"".join([known.get(p) or self._part_ids(p) for p in parts])

    def _missing(self, key: str) -> bytes:
        """Ids of a unit, by its key, that the cache did not have when its text was looked up."""
        ids = self.cache.get(key)
        if ids is None:
            ids = self.older.get(key)
            if ids is None:
                ids = self._unit_ids(key if self.unit is not SPACED_UNIT or key[0] == "\n" else key[1:] if key[0] == " " else " " + key)
            if len(key) <= CACHE_LENGTH:
                self.cache[key] = ids
        return ids

    def _odd(self, key: str) -> bytes:
        """Ids of a piece that may hold several units or no word."""
        if key not in ("", "\n") and not OTHER_SPACE.search(key):
            return self._missing(key)
        piece = key if key[:1] == "\n" else key[1:] if key[:1] == " " else " " + key
        return b"".join([self._unit_ids(u) for u in self.unit.findall(piece)])

    def _spaced(self, text: str) -> list[bytes]:
        """Ids of a text whose words take the white space before them along; keys that are no single word are never cached."""
        keys = text.replace("\n", " \n").split(" ")
        if keys[0]:
            keys[0] = " " + keys[0]
        else:
            del keys[0]
        found = list(map(self.cache.get, keys))
        if None not in found:
            return found
        new = [k for k, b in zip(keys, found) if b is None]
        missing = self._missing
        if "" in new or "\n" in new or OTHER_SPACE.search("".join(new)):
            missing = self._odd
            if RAGGED.search(text):
                keys = [u[1:] if u[0] == " " and len(u) > 1 and u[1] not in " \n" else u if u[0] == "\n" else " " + u for u in self.unit.findall(text)]
                found = list(map(self.cache.get, keys))
        return [missing(k) if b is None else b for k, b in zip(keys, found)]

    def encode(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; NULL is empty."""
        if self.unit is None:
            i = 0
            while i < len(texts):
                part, chars = [], 0
                while i < len(texts) and (not part or chars < CHUNK_CHARS):
                    part.append(texts[i] or "")
                    chars += len(part[-1])
                    i += 1
                yield from self._encode(part)
            return
        spaced = self.unit is SPACED_UNIT
        for text in texts:
            if spaced:
                found = self._spaced(text or "")
            else:
                units = self.unit.findall(text or "")
                found = list(map(self.cache.get, units))
                if None in found:
                    missing = self._missing
                    found = [missing(u) if b is None else b for u, b in zip(units, found)]
            if len(self.cache) > CACHE_UNITS:
                self.cache, self.older = {}, self.cache
            yield b"".join(found)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
