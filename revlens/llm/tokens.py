"""Token ids by public tokenizer files, with caches that live as long as the Python worker."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

#: Cached pieces, at most; a full cache is emptied.
CACHE = 600_000

# Fixed: the splitting rule of the word BPE, for chunks of printable ASCII and Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE uses for each byte: itself, or one past U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= CACHE:
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of a word-end BPE whose tokens never cross white space, chunk by chunk between ASCII blanks.

    Most chunks come from the cache. A new plain chunk is split and lower-cased here and its
    pieces looked up or merged by the tokenizer's model; any other chunk goes through the
    tokenizer as a whole. The result equals ``Tokenizer.encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        letters = byte_letters()
        self.letters = lambda s: "".join([letters[b] for b in s.encode()])
        self.chunks = _Cache(self._chunk)
        self.pieces = _Cache(self._piece)

    def _piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self.model.tokenize(piece if piece.isascii() else self.letters(piece))])

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if _PLAIN(text) and "<|" not in text:
            return b"".join([self.pieces[p] for p in _PIECES(text.lower())])
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned numbers of ``dtype``."""
        get = self.chunks
        return b"".join([get[c] for c in (text or "").encode("utf-8", "replace").split()])


@lru_cache(maxsize=4)
def word_encoder(path: str = WORD_BPE) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def plain_tokenizer(path: str = BYTE_BPE) -> Tokenizer:
    """A tokenizer for which the strings of its special tokens are ordinary text."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t
