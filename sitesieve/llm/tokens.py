"""Token ids of whole texts with a cache of words.

Both tokenizers split a text into pieces that never reach over the boundary between a visible character and the
space behind it, so the ids of a text are those of its space-separated words one after the other. Each word is
encoded by the tokenizers library once and then looked up; a word that is one piece goes straight to the library's
model. The cache has a fixed number of entries of bounded length. A text that itself holds the string of a special
token goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np

#: Words that a worker remembers at most, in each of two generations; some 200 bytes each. The larger number is for
#: jobs that have the executors for themselves.
CACHE_WORDS, CACHE_WORDS_ALONE = 150_000, 800_000
#: Characters of a word that is remembered.
LONGEST = 48
#: A letter never is in one piece with a mark or digit behind it, nor a mark with white space and a letter behind that. An
#: apostrophe may be.
_PARTS = re.compile(r"([^\W\d_]+)([!-&(-@\[-`{-~]+)(?:\n([^\W\d_]+)([!-&(-@\[-`{-~]+)?)?")
#: Words below this character that are only letters are one piece of either tokenizer.
_SIMPLE = "԰"
_ENCODERS: dict = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it is visible, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b if b in seen else 256 + hidden.index(b)) for b in range(256)]


class _Whole(Exception):
    """A word can't be taken on its own: the text has to be encoded as a whole."""


class _Words(dict):
    """Ids of words by word, each behind ``gap``; missing ones are encoded and, up to ``limit``, remembered."""

    def __init__(self, model, gap: str, limit: int, lowers: bool, parts: _Words | None = None):
        super().__init__()
        self.model, self.gap, self.limit, self.lowers, self.old = model, gap, limit, lowers, {}
        self.parts = self if parts is None else parts  # for what follows a mark
        self.letters = dict(enumerate(_byte_letters()))
        self.first = self.letters[32] if gap else ""
        self.piece = model.model.tokenize

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def library(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, word: str) -> bytes:
        if len(word) <= LONGEST:
            if word.isascii():
                if word.isalpha() and (not self.lowers or word.islower()):
                    return array("I", [t.id for t in self.piece(self.first + word)]).tobytes()
            elif word.isalpha() and max(word) < _SIMPLE and (not self.lowers or word.islower() and unicodedata.is_normalized("NFC", word)):
                return array("I", [t.id for t in self.piece(self.first + word.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if m := _PARTS.fullmatch(word):
                stem, marks, rest, more = m.groups()
                if stem.lower().isalpha() and (more is None or rest.lower().isalpha()):
                    parts = self.parts
                    found = self[stem] + parts[marks]
                    if rest is not None:
                        found += (b"" if self.lowers else parts["\n"]) + parts[rest] + (b"" if more is None else parts[more])
                    return found
        if self.gap and (not word or word[0].isspace() or word[-1].isspace()):
            raise _Whole  # next to more white space, with which it may be one piece
        return self.library(self.gap + word)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library has them with add_special_tokens=False."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.drops_space = "Lowercase" in str(self.model.normalizer)
        # a word behind no space: the first one of a text, or one behind a mark
        self.begins = _Words(self.model, "", limit if self.drops_space else max(1, limit // 8), self.drops_space)
        self.words = self.begins if self.drops_space else _Words(self.model, " ", limit, False, self.begins)

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text; none for null."""
        if not text:
            return b""
        plain = text.lower() if self.drops_space else text
        if any(s in plain for s in self.special):
            return self.words.library(text)
        try:
            if self.drops_space:
                # The model composes first and then lower-cases character by character; a sigma at a word's end is where that
                # differs from lower(), and words of lower-cased marks would be composed again.
                if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", plain)):
                    plain = text
                return b"".join(map(self.words.__getitem__, plain.split(" ")))
            first, *words = text.split(" ")
            if not first or first[-1].isspace():
                return self.words.library(text)
            return b"".join([self.begins[first], *map(self.words.__getitem__, words)])
        except _Whole:
            return self.words.library(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return list(map(self.encode, texts))


def encoder(path: str, limit: int = CACHE_WORDS) -> Encoder:
    """One encoder for each file in a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, limit)
    return _ENCODERS[path]
