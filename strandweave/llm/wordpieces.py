"""Byte-level BPE of whole texts with the ids of the tokenizers library.

The vocabulary file is opened by the tokenizers library. Texts that hold one of its special
strings are encoded by it as they are. All others go through tiktoken's merge loop on ranks
read from the same file, with the same public pattern, which gives the same ids several times
faster (the tests compare both). The pattern's look-ahead only matters next to a second white
space character, so texts without such a place use it without the look-ahead.
"""

from __future__ import annotations

import os
import re
from array import array

#: fixed value: the public pattern of this family of byte-level vocabularies
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
_DOUBLE = re.compile(r"\s\s")
_OPEN: dict[str, "PieceEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The public byte-to-letter table of byte-level BPE: visible Latin-1 stays, the rest follows 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    """``encode(texts)`` gives for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        byte_of = {letter: b for b, letter in byte_letters().items()}
        ranks = {
            bytes(byte_of[x] for x in token): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
        }

        def merges(pattern: str):
            return tiktoken.Encoding("r", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        self.plain = merges(_WORDS + r"|\s+").encode_ordinary
        self.exact = merges(_WORDS + r"|\s+(?!\S)|\s+").encode_ordinary

    def encode_text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif _DOUBLE.search(text):
            ids = self.exact(text)
        else:
            ids = self.plain(text)
        return array("I", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_text(t) for t in texts]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a vocabulary file, opened once per process."""
    if path not in _OPEN:
        _OPEN[path] = PieceEncoder(path)
    return _OPEN[path]


def encode_slices(coder: PieceEncoder, texts: list[str | None], chars: int = 4_000_000):
    """Encode a batch in slices of about ``chars`` characters, so memory follows the slice."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < chars):
            size += len(texts[end] or "")
            end += 1
        yield at, coder.encode(texts[at:end])
        at = end
