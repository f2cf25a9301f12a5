"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library, word by word.

Both public tokenizers cut a text into words before they merge, and a cut always falls before a
single blank between two other characters. So the ids of a text are the ids of its words in
sequence, and a word met before need not be encoded again. Texts with other white space take cuts
at fewer places, or none; the ids are those of the library in every case (tested against it).
"""

from __future__ import annotations

import json
import re
import string
import struct
from functools import cache

from tokenizers import Tokenizer

ID_BYTES = 4
ENTRY_BYTES = 170  # of a remembered word besides its letters and ids: two objects and a place in the table
LONGEST_KEPT = 256
_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: white space other than blank and line feed
_ODD = tuple(chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) if c != 10)
_BEFORE_WORD = re.compile(r" (?=\S)")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``remembered`` bounds the bytes of the words kept between texts; it changes the speed only.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, remembered: int = 1 << 26):
        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._model = self._library.model
        self._letters = _byte_letters()
        self._remembered = remembered
        self._ends: dict[str, bytes] = {}
        self._line = self._whole("\n")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [])
        self.vocabulary = self._library.get_vocab_size()
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer"):
            self._blank, self.encode = self._letters[32], self._with_blanks
        elif [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and not steps[1].get("add_prefix_space"):
            self._blank, self.encode = "", self._without_blanks
        else:
            self.encode = self._whole
        self._words: dict[str, bytes] = _Words(self._word)

    def _whole(self, text: str) -> bytes:
        return _packed(self._library.encode(text, add_special_tokens=False).ids)

    def _with_blanks(self, text: str) -> bytes:
        """A blank before a word belongs to the word."""
        if any(pair in text for pair in _PAIRS) or any(c in text for c in _ODD):
            first, *rest = _BEFORE_WORD.split(text)
            return b"".join([self._whole(first), *(self._whole(" " + word) for word in rest)])
        # a key either starts with a line feed or stands for a word after a blank
        ids = b"".join(map(self._words.__getitem__, ("\n" + text.replace("\n", " \n")).split(" ")))
        self._forget()
        return ids[ID_BYTES:]

    def _without_blanks(self, text: str) -> bytes:
        ids = b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))
        self._forget()
        return ids

    def _forget(self) -> None:
        if self._words.size > self._remembered:
            self._words.clear()
            self._words.size = 0
            self._ends.clear()

    def _word(self, key: str) -> bytes:
        """A run of letters is one word, and so is a run of points at its end."""
        if self._blank and key[:1] == "\n":
            line, word, blank = self._line, key[1:], ""
        else:
            line, word, blank = b"", key, self._blank
        bare = word.rstrip(string.punctuation)
        if not bare.isalpha():
            return self._whole(" " + key if blank else key)
        end = self._end(word[len(bare) :]) if len(bare) < len(word) else b""
        if not self._blank:
            bare = bare.lower()
        if not bare.isascii():
            if ord(max(bare)) > 255:
                return self._whole(" " + key if blank else key)
            bare = "".join(map(self._letters.__getitem__, bare.encode()))
        return line + _packed([token.id for token in self._model.tokenize(blank + bare)]) + end

    def _end(self, points: str) -> bytes:
        if len(points) > 4:
            return self._whole(points)
        if points not in self._ends:
            self._ends[points] = self._whole(points)
            self._words.size += ENTRY_BYTES
        return self._ends[points]


class _Words(dict):
    """Ids by word; ``size`` is about the bytes that all take. Long words are not kept."""

    def __init__(self, of):
        super().__init__()
        self._of = of
        self.size = 0

    def __missing__(self, key: str) -> bytes:
        ids = self._of(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = ids
            self.size += ENTRY_BYTES + len(key) + len(ids)
        return ids


@cache
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process."""
    return TextEncoder(path)
