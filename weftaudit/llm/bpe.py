"""BPE encoding by content-defined chunks that documents share.

A rolling hash over code points cuts a text where its low bits are zero, so equal passages
are cut alike wherever they stand. A chunk that a Python worker has met is not encoded
again. A cut can split a word; the join of two chunks, from the last white space before the
cut to the first one after it, is therefore encoded anew, and checked against the encoding of
a wider window until both agree.

Ids and decoded texts are exactly those of the ``tokenizers`` library for vocabularies whose
words end at white space (the normaliser and the word pattern never look across it). No
shuffle takes place: chunks are reused inside a worker, whose cache has a bound in bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftaudit.llm.common import RollingHash, code_points, small_slices
from weftaudit.llm.pieces import WORD_END_PATTERN, Pieces

#: Mean chunk length in code points is 2 ** CHUNK_BITS; the rolling hash sees WINDOW of them.
CHUNK_BITS = 11
WINDOW = 24
CACHE_BYTES = 16 << 20
_SPACE = re.compile(r"[\x20\x09-\x0d]")
_WORDS = re.compile(r"[^\x20\x09-\x0d]+")
Encoded = tuple[int, bytes, bytes]  # tokens, decimal ids and decoded tokens, each joined by a space


class ChunkEncoder:
    """Encodes texts chunk by chunk with a tokenizer file of the tokenizers library."""

    def __init__(self, path: str, chunk_bits: int = CHUNK_BITS, cache_bytes: int = CACHE_BYTES) -> None:
        self.pieces = Pieces(path, WORD_END_PATTERN, True, self._digest)
        self.rolling = RollingHash(WINDOW)
        self.mask = np.uint64((1 << chunk_bits) - 1)
        self.cache_bytes, self.used = cache_bytes, 0
        self.chunks: dict[str, tuple[Encoded, str, str]] = {}
        self.reused = self.encoded = 0

    def cuts(self, text: str) -> list[int]:
        """Ends of the chunks, in code points; the last is the end of the text."""
        hashes = self.rolling(code_points(text))
        ends = (np.flatnonzero((hashes & self.mask) == 0) + WINDOW).tolist()
        if not ends or ends[-1] != len(text):
            ends.append(len(text))
        return ends

    def _digest(self, ids: list[int]) -> Encoded:
        vocabulary = self.pieces.vocabulary
        return len(ids), " ".join(map(str, ids)).encode(), " ".join([vocabulary[i] for i in ids]).encode()

    def _encode(self, text: str) -> Encoded:
        """Whole words, as the tokenizer encodes them."""
        return _joined(self.pieces(text))

    def _chunk(self, chunk: str, front: int, back: int) -> tuple[Encoded, str, str] | None:
        """Tokens of the words between the first and the last white space, with the first and the last of these words.

        None if there is no such word; the chunk then belongs to a join.
        """
        known = self.chunks.get(chunk)
        if known is not None:
            self.reused += 1
            return known
        core = chunk[front:back]
        first = _WORDS.search(core)
        if first is None:
            return None
        self.encoded += 1
        rest = core.rstrip(" \t\n\r\x0b\x0c")
        known = (self._encode(core), first[0], rest[_last_space(rest) + 1 :])
        self.used += 4 * len(chunk) + len(known[0][1]) + len(known[0][2])
        if self.used > self.cache_bytes:
            self.chunks.clear()
            self.used = 0
        self.chunks[chunk] = known
        return known

    def _join(self, left: str, text: str, right: str) -> Encoded:
        """Tokens of the text between two chunks' whole words, of which the neighbouring ones are given.

        The text is encoded alone, then within a window that has a whole word on each side. If
        both agree the join is right as it is; else the window's own tokens between those of
        the two words are taken.
        """
        if not _WORDS.search(text):
            return 0, b"", b""
        window = f"{left} {text} {right}"
        whole, head, tail = self._encode(window), self._encode(left), self._encode(right)
        inner = self._encode(text)
        if _joined([head, inner, tail]) == whole:
            return inner
        ids = [int(i) for i in whole[1].split()]
        return self._digest(ids[head[0] : len(ids) - tail[0]])

    def __call__(self, text: str | None) -> Encoded:
        text = text or ""
        parts: list[Encoded] = []
        start, pending, left = 0, "", ""
        for end in self.cuts(text):
            chunk = text[start:end]
            start = end
            space = _SPACE.search(chunk)
            back = _last_space(chunk)
            known = self._chunk(chunk, space.start(), back) if space else None
            if known is None:
                pending += chunk
                continue
            core, first, last = known
            parts += [self._join(left, pending + chunk[: space.start()], first), core]
            pending, left = chunk[back:], last
        parts.append(self._join(left, pending, ""))
        return _joined(parts)


def _last_space(text: str) -> int:
    return max(map(text.rfind, " \n\t\r\x0b\x0c"))


def _joined(parts: list[Encoded]) -> Encoded:
    """Concatenation; parts without tokens leave no gap."""
    counts, ids, tokens = zip(*parts) if parts else ((), (), ())
    if 0 in counts:
        ids, tokens = filter(None, ids), filter(None, tokens)
    return sum(counts), b" ".join(ids), b" ".join(tokens)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, with_ids: also ids and decoded.

    A null text counts as empty (no tokens, both digests of the empty string). Special tokens
    written in a text become their ids, as the library's default has it. Only ``doc_id`` and
    ``text`` are read, so extra columns cannot clash; repeated rows give repeated results and
    an empty table an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small_slices(batches):
            found = [encode(t) for t in batch["text"].to_pylist()]
            arrays = [
                batch["doc_id"],
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([hashlib.sha256(ids).hexdigest() for _, ids, _ in found], pa.string()),
                pa.array([hashlib.sha256(text).hexdigest() for _, _, text in found], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array([[int(i) for i in ids.split()] for _, ids, _ in found], pa.list_(pa.int32())), pa.array([text.decode() for _, _, text in found], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, schema)
