"""Encoding text by its pre-tokens: each worker process keeps the ids of pieces it has met.

``public_tokenizers.PATTERN`` cuts a text into pieces and the vocabulary's
merges never cross them, so the ids of a text are its pieces' ids in turn. A
process keeps at most ``KEEP`` pieces and starts over beyond that.

A vocabulary file's added tokens (``<|endoftext|>``) are cut out first, as the
library does: each is a piece of its own, and what lies between is split alone.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

KEEP = 700_000
LONG_PIECE = 256                     # longer pieces are encoded and not kept


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file: as given if it is a path, else looked up in the installed package."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


#: public_tokenizers.PATTERN in the terms of Python's own engine, which is faster; the two
#: differ on the characters that ``_unlike`` finds.
#: Letters come first, as most pieces are words: no other alternative can match where they do.
_REST = r"| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r" ?[^\W\d_]+" + _REST)
#: The same for texts whose letters are spelled out, which is faster again.
_ASCII = re.compile(r" ?[A-Za-z]+" + _REST)
LATIN_END = 0x250
_LATIN = re.compile(" ?[" + "".join(chr(c) for c in range(LATIN_END) if chr(c).isalpha()) + "]+" + _REST)
_BEYOND = re.compile(f"[^\0-{chr(LATIN_END - 1)}]")


def _unlike(engine) -> re.Pattern:
    """Matches a character that is a letter, number or white space for one engine only, or is above U+FFFF."""
    odd: set[str] = set()
    for start in range(0, 0x110000, 0x1000):                      # some characters at a time
        if start not in range(0xD800, 0xE000):
            some = "".join(map(chr, range(start, min(start + 0x1000, 0xD800) if start < 0xD800 else start + 0x1000)))
            for there, here in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
                odd |= set(engine.findall(there, some)) ^ set(re.findall(here, some))
    return re.compile("[" + "".join(re.escape(c) for c in sorted(odd) if c < "\U00010000") + "\ud800-\udfff\U00010000-\U0010ffff]")


class Splitter:
    """Cuts a text into the pieces of ``public_tokenizers.PATTERN``."""

    def __init__(self):
        import public_tokenizers
        import regex
        self.exact = regex.compile(public_tokenizers.PATTERN)
        self.unlike = _unlike(regex)

    def findall(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text)
        if self.unlike.search(text):
            return self.exact.findall(text)
        return (_PLAIN if _BEYOND.search(text) else _LATIN).findall(text)


_SPLITTER: list[Splitter] = []


def splitter() -> Splitter:
    """This process's splitter."""
    if not _SPLITTER:
        _SPLITTER.append(Splitter())
    return _SPLITTER[0]


class AddedTokens:
    """Cuts out a vocabulary's added tokens, the longest where several begin, and splits the rest."""

    def __init__(self, added: Iterable[str], split: Splitter):
        self.added, self.split = sorted(added, key=len, reverse=True), split
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")

    def findall(self, text: str) -> list[str]:
        if not any(a in text for a in self.added):
            return self.split.findall(text)
        out = []
        for j, part in enumerate(self.cut.split(text)):          # every other part is an added token
            out += [part] if j % 2 else self.split.findall(part)
        return out


class PieceCache(dict):
    """piece -> value, which ``encode`` gives where the piece is new."""

    def __init__(self, encode: Callable[[str], object], keep: int = KEEP, added: Iterable[str] = ()):
        super().__init__()
        self.encode, self.keep = encode, keep
        self.split = AddedTokens(added, splitter()) if added else splitter()

    def __missing__(self, piece: str):
        value = self.encode(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.keep:
                self.clear()
            self[piece] = value
        return value

    def each(self, pieces: list[str]) -> list:
        """The pieces' values, in turn."""
        return list(map(self.__getitem__, pieces))


def library_tokenizer(path: str):
    """The tokenizers library's encoder, as the file has it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def added_tokens(t) -> dict[str, int]:
    """Added token -> id. Those that take blanks around them or want whole words can't be cut out as strings."""
    every = t.get_added_tokens_decoder()
    for a in every.values():
        if a.lstrip or a.rstrip or a.single_word:
            raise ValueError(f"added token {a.content!r} isn't matched as a plain string")
    return {a.content: i for i, a in every.items()}


_MADE: dict = {}


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it, where it isn't the byte's own."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def library_ids(name: str) -> PieceCache:
    """Cache of piece -> ids as little-endian uint32 bytes, from the tokenizers library.

    A piece goes to the library's model, past its splitting of texts; pieces with
    characters from U+0250 on, which Unicode versions may class unlike, take the whole way."""
    key = ("ids", name)
    if key not in _MADE:
        t = library_tokenizer(vocabulary(name))
        model, letters, added = t.model, byte_letters(), added_tokens(t)
        blank = letters[ord(" ")]

        def encode(piece: str) -> bytes:
            if piece in added:
                ids = [added[piece]]
            elif piece.isascii() and piece.isprintable():
                ids = [x.id for x in model.tokenize(piece.replace(" ", blank))]
            elif max(piece) < "\u0250":
                ids = [x.id for x in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
            else:
                ids = t.encode(piece, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        _MADE[key] = PieceCache(encode, added=added)
    return _MADE[key]


def library_spans(name: str) -> PieceCache:
    """Cache of piece -> (character starts, character ends) of its tokens as little-endian int32 bytes."""
    key = ("spans", name)
    if key not in _MADE:
        t = library_tokenizer(vocabulary(name))

        def encode(piece):
            o = np.array(t.encode(piece, add_special_tokens=False).offsets, dtype="<i4").reshape(-1, 2)
            return o[:, 0].tobytes(), o[:, 1].tobytes()
        _MADE[key] = PieceCache(encode, added=added_tokens(t))
    return _MADE[key]
