"""Token ids of text fragments, found once each and remembered within a bound.

A fragment is a piece of text whose ids do not depend on what stands around it. Plain ones
(Latin letters and ASCII marks, no control strings) are cut into the pre-tokens of the
vocabulary and looked up or merged one by one; whatever else is left to the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import regex

KEEP_FRAGMENTS = 48 << 20  # bytes of a worker's memory for fragments that it remembers
KEEP_PIECES = 80 << 20  # and for pre-tokens
LONGEST = 64  # pieces of more bytes or characters are not remembered
_COST = 200  # bytes that a remembered piece takes besides its own and its ids
_CODERS: dict[str, "Coder"] = {}


def letter_bytes() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(spare)}


#: Characters that normal forms and white space rules leave alone; a blank may come first.
_SIMPLE = regex.compile(r" ?[\x21-\x3b\x3d-\x7e\xa1-\xac\xae-įı-ɏ]+")


#: Texts of such characters and ASCII blanks only, and what they are cut into once in lower case.
_SIMPLE_TEXT = re.compile(r"[ \t\n\x0b\f\r\x21-\x3b\x3d-\x7e\xa1-\xac\xae-įı-ɏ]*")
_LETTERS, _DIGITS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
_LOWER_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")


class Remembered(dict):
    """piece -> what ``find`` gives for it, within a bound of bytes.

    The older half is given up when the newer one is full; what is met again moves over.
    """

    def __init__(self, find: Callable, limit: int):
        self.find, self.limit, self.older, self.held = find, limit, {}, 0

    def __missing__(self, piece):
        found = self.older.get(piece)
        if found is None:
            found = self.find(piece)
        if len(piece) <= LONGEST:
            self.held += _COST + len(piece) + len(found)
            if self.held > self.limit // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = found
        return found


class Coder:
    """``fragments`` and ``pieces`` (lower-cased pre-tokens): ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.fragments, self.pieces = Remembered(self.encode, KEEP_FRAGMENTS), Remembered(self.merge, KEEP_PIECES)
        self.written = {b: c for c, b in letter_bytes().items()}
        self.lower = self.tokenizer.normalizer is not None  # the file's normal form includes lower case
        # the pre-token patterns of the two kinds of vocabulary files (fixed values)
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.lower else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
        )

    def encode(self, fragment: bytes) -> bytes:
        text = fragment.decode("utf-8")
        if _SIMPLE.fullmatch(text):
            return b"".join([self.merge(p) for p in self.pattern.findall(text.lower() if self.lower else text)])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def merge(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.written)
        return np.array([t.id for t in self.model.tokenize(written)], dtype="<i4").tobytes()

    def text_ids(self, text: bytes) -> bytes:
        """Ids of a whole text by a vocabulary that lower-cases and drops white space."""
        whole = text.decode("utf-8")
        if _SIMPLE_TEXT.fullmatch(whole):
            return b"".join(map(self.pieces.__getitem__, _LOWER_PIECES.findall(whole.lower())))
        return b"".join(map(self.fragments.__getitem__, text.split()))


def coder(path: str) -> Coder:
    """One per worker and file."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]
