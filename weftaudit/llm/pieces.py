"""Token ids through the tokenizers library, each distinct piece of a word once.

Most of the library's time goes into normalising and splitting. For texts of plain Latin
letters, digits, signs and ASCII white space (no combining marks, control characters or
special tokens) these steps are simple: the text is lower-cased if the tokenizer does so and
split by its word pattern, and only the BPE model of the library runs, once for each distinct
piece that a worker meets. All other texts take the library's whole path.
"""

from __future__ import annotations

import os
import re

import regex

# The letters and digits among the characters of plain texts (and what these are in lower case).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯⱥⱦ"
DIGITS = "0-9²³¹¼-¾"
# The word patterns of the two public tokenizers, for plain texts.
WORD_END_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"
BYTE_LEVEL_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"

_PLAIN = re.compile(r"[ \n\t\r\x21-\x7e\xa1-ɏ]*")
#: Before a lone space between two other characters every pattern starts anew.
_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f\u200b\ufeff])(?= [^\s\x1c-\x1f\u200b\ufeff])")
#: Pieces of a generation, unless told otherwise; the one before it is kept too, so pieces in use are not learned again.
CACHE_PIECES = 100_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Pieces:
    """Splits plain texts into pieces and keeps what ``digest`` makes of each piece's ids."""

    def __init__(self, path: str, pattern: str, lower: bool, digest, cache: int = 0) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.split = re.compile(pattern).findall
        self.lower = lower
        self.digest = digest
        self.cache = cache or CACHE_PIECES
        self.table = dict(enumerate(byte_alphabet()))
        self.known: dict = {}
        self.before: dict = {}
        self.vocabulary = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def library(self, text: str) -> list[int]:
        """The library's whole path."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list:
        """The digests of the text's pieces in order; a part that is not plain gives one digest of all its ids."""
        if "<|" in text or not _PLAIN.fullmatch(text):
            parts = _CUT.split(text)
            if len(parts) == 1:
                return [self.digest(self.library(text))]
            return [d for part in parts for d in self(part)]
        pieces = self.split(text.lower() if self.lower else text)
        found = list(map(self.known.get, pieces))
        for i, digest in enumerate(found):
            if digest is None:
                found[i] = self._learn(pieces[i])
        return found

    def _learn(self, piece: str):
        digest = self.known.get(piece) or self.before.get(piece)
        if digest is None:
            mapped = piece.encode().decode("latin-1").translate(self.table)
            digest = self.digest([t.id for t in self.model.tokenize(mapped)])
        if len(self.known) >= self.cache:
            self.before, self.known = self.known, {}
        self.known[piece] = digest
        return digest
