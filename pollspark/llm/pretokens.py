"""Texts cut into whitespace-led chunks, so that repeated chunks are encoded once.

Every match of the tokenizers' split pattern holds whitespace only at its start, or holds nothing else.
A whitespace run that follows another character therefore always starts a match, and the pattern's only
look-ahead (whitespace not followed by a word) never reaches past such a cut. Matching each chunk by
itself gives exactly the matches of the whole text, and a chunk that recurs needs no second match.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

# The characters of Unicode's White_Space property (fixed values).
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


class ChunkEncoder:
    """Texts to token ids by a memory of chunks.

    ``encode_chunks`` maps a list of distinct chunks to little-endian 32-bit ids, one ``bytes`` each.
    ``limit`` bounds the chunks that stay in memory between batches; at the limit the memory starts anew,
    which costs time and changes no result.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], Iterable[bytes]], limit: int = 500_000):
        self.encode_chunks = encode_chunks
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        cut = [CHUNK.findall(t) for t in texts]
        new = [c for c in set().union(*cut) if c not in known]
        if new:
            known.update(zip(new, self.encode_chunks(new)))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


class ByWords:
    """Encodes chunks by their pattern matches, with a bounded memory of matches."""

    def __init__(self, pattern: str, encode_words: Callable[[list[str]], Iterable[bytes]], limit: int = 500_000):
        self.findall = regex.compile(pattern).findall
        self.encode_words = encode_words
        self.limit = limit
        self.words: dict[str, bytes] = {}

    def __call__(self, chunks: list[str]) -> list[bytes]:
        if len(self.words) > self.limit:
            self.words = {}
        words = self.words
        matched = [self.findall(c) for c in chunks]
        missing = list({w for ws in matched for w in ws if w not in words})
        if missing:
            words.update(zip(missing, self.encode_words(missing)))
        return [words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws]) for ws in matched]
