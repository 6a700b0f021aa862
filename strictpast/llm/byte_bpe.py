"""Byte-level BPE over cached pre-tokens, with the library's own merge model.

A pre-token never starts inside a word that follows a single space: wherever a space is
followed by something that is not white space, the published split pattern starts a new
pre-token at that space. Texts are therefore cut at single spaces by ``str.split`` and each
distinct chunk is split by the pattern and merged once per cache life.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Entries that a worker keeps of each of its two caches; a full cache starts anew.
CACHE = 500_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 stands for itself; the other bytes take code points from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Irregular(Exception):
    """A chunk that the cut at single spaces does not delimit."""


class Bounded(dict):
    """A memo of ``make(key)`` with at most ``limit`` entries."""

    def __init__(self, make: Callable, limit: int = CACHE):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """A tokenizer file whose texts are encoded through pre-token caches.

    ``piece`` maps one pre-token to the value kept for it, ``join`` combines the values of
    consecutive pre-tokens; counting and encoding differ only in these two.
    """

    def __init__(self, path: str, piece: Callable[[list[int]], object], join: Callable):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = byte_alphabet()
        self.piece, self.join = piece, join
        self.pieces = Bounded(self._merge)
        self.chunks = Bounded(self._chunk)

    def ids(self, pre_token: str) -> list[int]:
        """Merge one pre-token with the library's model."""
        if pre_token.isascii() and pre_token[1:].isalpha() and pre_token[0] == " ":
            shown = "Ġ" + pre_token[1:]
        else:
            shown = "".join([self.letters[b] for b in pre_token.encode()])
        return [t.id for t in self.model.tokenize(shown)]

    def _merge(self, pre_token: str):
        return self.piece(self.ids(pre_token))

    def _chunk(self, chunk: str):
        if not chunk or chunk[0].isspace():
            raise Irregular
        pieces = self.pieces
        if chunk.isalpha():
            return pieces[" " + chunk]
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return self.join([pieces[" " + chunk[:-1]], pieces[chunk[-1]]])
        return self.join([pieces[p] for p in self.split(" " + chunk)])

    def __call__(self, text: str):
        """The joined values of a text's tokens, as the library encodes it."""
        if any(s in text for s in self.specials):
            return self.piece(self.library.encode(text, add_special_tokens=False).ids)
        first, _, rest = text.partition(" ")
        try:
            if not first or first[-1].isspace() or not rest:
                raise Irregular
            head = [self.pieces[p] for p in self.split(first)]
            return self.join([*head, *map(self.chunks.__getitem__, rest.split(" "))])
        except Irregular:
            return self.join([self.pieces[p] for p in self.split(text)])
