"""Byte-pair encoding of whole texts with the tokenizers library, word by word through a bounded cache.

A text is cut where a character that is not white space is followed by ASCII white space.  No token of either
pre-tokenizer reaches over such a place, so the ids of a text are those of its units, one after another.  Texts with
other white space than ASCII's next to which this does not hold are encoded in one piece.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache

CACHE_UNITS = 1_000_000  #: units whose ids a Python worker keeps; beyond that the cache starts anew

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_letters() -> list[str]:
    """Byte-level alphabets name the printable bytes by themselves and the others by the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = CACHE_UNITS):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.whole.model, _byte_letters()
        # A tokenizer that drops white space has no use for it in its units.
        self.keeps_space = bool(self.whole.encode(" ", add_special_tokens=False).ids)
        self.lower = self.whole.encode("A", add_special_tokens=False).ids == self.whole.encode("a", add_special_tokens=False).ids
        self.units = re.compile("[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+").findall
        self.simple = re.compile(f"( ?[{_LETTERS}]+)([.,]?)" if self.keeps_space else f"([{_LETTERS}]+)([.,]?)").fullmatch
        self.ends = {x: self.packed(self.whole.encode(x, add_special_tokens=False).ids) for x in ".,"} | {"": b""}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def of_word(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        core = unit[1:] if self.keeps_space and unit[:1] == " " else unit
        if core.isascii() and core.isalpha():  # the commonest case: these letters stand for themselves
            word = core.lower() if self.lower else core
            out = self.of_word(word if core is unit else self.letters[32] + word)
        elif m := self.simple(unit):
            word, end = m.groups()
            word = word.lower() if self.lower else word
            out = self.of_word("".join([self.letters[b] for b in word.encode()])) + self.ends[end]
        else:
            out = self.packed(self.whole.encode(unit, add_special_tokens=False).ids)
        if len(unit) <= 64:
            self[unit] = out
        return out

    def cut(self, text: str) -> list[str]:
        """The units of a text that has no white space but ASCII's.  Not every place need be cut, so plain splits do for most texts."""
        if not self.keeps_space:
            return text.split()
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\0", "\t", "\r", "\f", "\v")):
            return self.units(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not text.isascii() and _OTHER_SPACE.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, self.cut(text)))

    def count(self, text: str | None) -> int:
        """How many ids `encode` gives."""
        return len(self.encode(text)) // 4


@lru_cache(maxsize=4)
def encoder(tokenizer: str, limit: int = CACHE_UNITS) -> Encoder:
    """tokenizer: a path, or the bare name of a file of public_tokenizers, which each executor then looks up itself."""
    if os.sep not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return Encoder(tokenizer, limit)


def forget() -> None:
    """Frees what a Python worker still holds of encoding, at the start of a task that encodes nothing: workers are used again."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
