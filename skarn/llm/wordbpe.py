"""Ids of whole texts by a public word-level BPE file of the tokenizers library.

The file's rules drop white space and never merge across it, so a text's ids are those of its chunks between ASCII
white space. Chunks are encoded once per worker and kept in two generations of bounded size. A chunk of plain letters
goes straight to the library's BPE model; one with other characters of the Latin blocks is cut by the file's own
pattern first; all else (combining marks, other scripts, control strings) goes through the library's whole pipeline.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import regex

from skarn.llm.common import kept

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: The tokenizer file's split pattern (fixed value).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that normal form C leaves alone and that lower-case alike in all Unicode versions.
_PLAIN = re.compile("[!-~¡-įı-ſ]+")
_LONG_KEY = 64
#: A generation has at most so many chunks, the most that a dict holds before it doubles to 20 MB, and so many bytes of chunks and ids.
KEPT = 349_525
KEPT_BYTES = 16 << 20


def resolve(tokenizer: str) -> str:
    """A path as it is; a bare name is one of the public files, found where the code runs."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer: str, kept: int = KEPT, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(resolve(tokenizer))
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.kept, self.kept_bytes, self.held, self.old = kept, kept_bytes, 0, {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._encode(chunk)
        if len(chunk) <= _LONG_KEY:
            self.held += len(chunk) + len(ids)
            if len(self) >= self.kept or self.held > self.kept_bytes:
                self.old = {}  # goes before the copy is made
                self.old = dict(self)
                self.clear()
                self.held = len(chunk) + len(ids)
            self[chunk] = ids
        return ids

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._ids([t.id for t in self.model.tokenize(piece)])

    def _encode(self, chunk: bytes) -> bytes:
        if b"<|" not in chunk:
            low = chunk.lower()
            if low != chunk:
                return self[low]
            if chunk.isalpha():
                return self._piece(chunk.decode())
            text = chunk.decode()
            if _PLAIN.fullmatch(text):
                low = text.lower()
                if low != text:
                    return self[low.encode()]
                if chunk[-1:] in b",." and text[:-1].isalpha():
                    return self[chunk[:-1]] + self[chunk[-1:]]
                pieces = [text] if text.isalpha() else _SPLIT.findall(text)
                return b"".join(self._piece(p.encode().decode("latin-1").translate(self.letters)) for p in pieces)
        return self._ids(self.whole.encode(chunk.decode(), add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""

    def document(self, text: str | None) -> bytes:
        """The text's ids and the end id."""
        return self.encode(text) + END_ID.to_bytes(4, "little")


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> WordEncoder:
    return WordEncoder(tokenizer)


kept(encoder.cache_clear)
