"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, units after numbers and names (capitalised words inside a
sentence) turn into typed placeholders, all else is the lower-cased word without the signs
at its ends. Windows of template words are hash-joined with those of the benchmark. Where a
run of windows lines up with an item, the slots are checked: the same value in the item must
stand for the same value in the document, so a re-parameterised question is caught and a
chance fit of placeholders is not.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import mix, small_slices, without_ids

WINDOW = 5
#: An item is found if this share of its windows is, or a run of so many words in a row.
LEAST_SHARE = 0.8
LEAST_RUN = 13
#: A window needs so many words that are no placeholders.
LEAST_LITERAL = 3
#: Characters of benchmark text that are searched in one pass over the documents.
BLOCK_CHARS = 32 << 20

_EDGES = " \t\"'`.,;:!?()[]{}<>*#$%&|~_^=+/\\…“”„«»‘’–—"
_NUMBER = regex.compile(r"[+-]?\p{N}+(?:[.,:/]\p{N}+)*(?:st|nd|rd|th|%)?")
_JOINED = regex.compile(r"([+-]?\p{N}+(?:[.,]\p{N}+)*)(\p{L}{1,4})")
# Units of measure.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg t lb lbs oz gram grams pound pounds ton "
    "tons ml cl l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degrees kmh mph hz khz mhz ghz kb mb gb tb w kw v a n j pa".split()
)
WORD, NUMBER, UNIT, NAME, JOINED = range(5)
_SLOT = [0, *(xxhash.xxh64_intdigest(f"slot {k}") for k in range(1, 5))]


#: Places of a table that tells hashes apart from those of a block by their last bits.
MARKS = 1 << 21


class Canon:
    """Words of a text as arrays: value hash, template hash, and whether the word is a slot."""

    MOST = 300_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.values = np.zeros(1 << 12, dtype=np.uint64)
        self.kinds = np.zeros(1 << 12, dtype=np.int8)
        self.capital = np.zeros(1 << 12, dtype=bool)
        self.ends = np.zeros(1 << 12, dtype=bool)
        self.empty = np.zeros(1 << 12, dtype=bool)

    def _learn(self, raw: str) -> int:
        at = self.known[raw] = len(self.known)
        if at >= len(self.values):
            for name in ("values", "kinds", "capital", "ends", "empty"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        word = raw.strip(_EDGES)
        low = word.lower()
        self.values[at] = xxhash.xxh64_intdigest(low)
        self.kinds[at] = NUMBER if _NUMBER.fullmatch(low) else UNIT if low in UNITS else WORD
        joined = _JOINED.fullmatch(low)
        if joined and joined[2] in UNITS:
            self.kinds[at] = JOINED
        self.capital[at] = word[:1].isupper() and len(word) > 1 and not word.isupper()
        self.ends[at] = raw.endswith((".", "!", "?", ":", "…")) or not word
        self.empty[at] = not word
        return at

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, templates, slots). Words of signs only are left out."""
        return self.many([text])[1:]

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for several texts, one after the other, and before it the number of the text of each word."""
        if len(self.known) > self.MOST:
            self._reset()
        known, raw, sizes = self.known, [], []
        for text in texts:
            words = (text or "").split()
            raw += words
            sizes.append(len(words))
        ids = np.fromiter([known[w] if w in known else self._learn(w) for w in raw], dtype=np.int64, count=len(raw))
        of = np.repeat(np.arange(len(texts)), sizes)
        start = np.ones(len(ids), dtype=bool)
        start[1:] = of[1:] != of[:-1]
        first = start.copy()
        first[1:] |= self.ends[ids[:-1]]
        kept = ~self.empty[ids]
        ids, first, of = ids[kept], first[kept], of[kept]
        kinds, values = self.kinds[ids].astype(np.int64), self.values[ids]
        after = np.zeros(len(ids), dtype=bool)
        after[1:] = (kinds[:-1] == NUMBER) & (of[1:] == of[:-1])
        kinds[(kinds == UNIT) & ~after] = WORD
        kinds[(kinds == WORD) & self.capital[ids] & ~first] = NAME
        slots = kinds != WORD
        return of, values, np.where(slots, np.array(_SLOT, dtype=np.uint64)[kinds], values), slots


def windows(templates: np.ndarray, slots: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each window of template words, and whether it has enough literal words."""
    n = len(templates) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    hashes = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        hashes = mix(hashes * np.uint64(0x100000001B3) + templates[j : j + n])
    literal = np.convolve(~slots, np.ones(size, dtype=np.int64), "valid")
    return hashes, literal >= LEAST_LITERAL


@dataclass
class Block:
    """Windows of some items, sorted by hash: which item and where; with the items' values and slots.

    Each word stream is indexed twice: as templates and as plain words (its lower-cased
    words with no slots), so that texts in another case still meet.
    """

    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    items: list[tuple[int, np.ndarray, np.ndarray, int]]
    marks: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Block:
        canon, items, parts = Canon(), [], []
        for item_id, text in rows:
            values, templates, slots = canon(text)
            number = len(items)
            items.append((item_id, values, slots, max(0, len(values) - WINDOW + 1)))
            for words, marks in ((templates, slots), (values, np.zeros_like(slots))):
                hashes, usable = windows(words, marks)
                at = np.flatnonzero(usable)
                parts.append((hashes[at], np.full(len(at), number), at))
        hashes, item, at = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        entries = np.unique(np.rec.fromarrays([hashes, item, at], names="h,i,a")) if len(hashes) else np.rec.fromarrays([hashes, item, at], names="h,i,a")
        return Block(np.array(entries["h"]), np.array(entries["i"]), np.array(entries["a"]), items)

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash is one of the block's; most of those that are not are told by their last bits."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool)
        if self.marks is None:
            self.marks = np.zeros(MARKS, dtype=bool)
            self.marks[(self.hashes % np.uint64(MARKS)).astype(np.int64)] = True
        found = self.marks[(hashes % np.uint64(MARKS)).astype(np.int64)]
        some = np.flatnonzero(found)
        low = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        found[some] = self.hashes[low] == hashes[some]
        return found

    def search_many(self, canon: Canon, texts: list[str | None]) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """(number of the text, find) of several texts; only those that hold a window of the block are looked at one by one."""
        of, values, templates, slots = canon.many(texts)
        if len(of) < WINDOW:
            return
        inside = of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :]
        some: set[int] = set()
        for words, marks in ((templates, slots), (values, np.zeros_like(slots))):
            hashes, usable = windows(words, marks)
            some.update(np.unique(of[: len(hashes)][usable & inside & self.held(hashes)]).tolist())
        for number in sorted(some):
            a, b = np.searchsorted(of, [number, number + 1])
            for find in self.search(values[a:b], templates[a:b], slots[a:b]):
                yield number, find

    def search(self, values: np.ndarray, templates: np.ndarray, slots: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, windows found, windows of the item, words of the longest run) of each item found in a document."""
        hits = []
        for words, marks in ((templates, slots), (values, np.zeros_like(slots))):
            hashes, usable = windows(words, marks)
            low = np.searchsorted(self.hashes, hashes)
            here = np.flatnonzero(usable & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes)) if len(self.hashes) else np.empty(0, np.int64)
            if len(here):
                high = np.searchsorted(self.hashes, hashes[here], side="right")
                count = high - low[here]
                entry = np.repeat(low[here] - np.cumsum(count) + count, count) + np.arange(count.sum())
                hits.append((self.item[entry], self.at[entry], np.repeat(here, count)))
        if not hits:
            return []
        item, at, place = (np.concatenate(c) for c in zip(*hits))
        found = []
        order = np.lexsort((at, place - at, item))
        item, at, place = item[order], at[order], place[order]
        for first, last in _groups(item):
            item_id, own, own_slots, total = self.items[item[first]]
            good: set[int] = set()
            longest = 0
            shift = place[first:last] - at[first:last]
            for a, b in _groups(shift):
                starts = np.unique(at[first + a : first + b])
                starts = _consistent(starts, own, own_slots, values, int(shift[a]))
                if len(starts):
                    good.update(starts.tolist())
                    cut = np.flatnonzero(np.diff(starts) != 1) + 1
                    longest = max(longest, int(np.diff(np.concatenate([[0], cut, [len(starts)]])).max()) + WINDOW - 1)
            if good and (len(good) >= LEAST_SHARE * total or longest >= LEAST_RUN):
                found.append((item_id, len(good), total, longest))
        return found


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(keys)]]).tolist())


def _consistent(starts: np.ndarray, own: np.ndarray, own_slots: np.ndarray, values: np.ndarray, shift: int) -> np.ndarray:
    """Starts of the windows on one alignment whose slots map each value of the item to one value of the document."""
    words = np.unique((starts[:, None] + np.arange(WINDOW)).ravel())
    seen: defaultdict[int, set[int]] = defaultdict(set)
    for w in words[own_slots[words]].tolist():
        seen[int(own[w])].add(int(values[w + shift]))
    wrong = {v for v, others in seen.items() if len(others) > 1}
    if not wrong:
        return starts
    bad = np.array([s and int(v) in wrong for s, v in zip(own_slots, own)])
    return starts[~bad[starts[:, None] + np.arange(WINDOW)].any(axis=1)]


def _searched(block: Block):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in small_slices(batches):
            ids = batch["doc_id"].to_pylist()
            out = [(ids[i], *f) for i, f in block.search_many(canon, batch["text"].to_pylist())]
            columns = list(zip(*out)) if out else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_found", "n_windows", "longest_run"])

    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_found, n_windows, longest_run) for each benchmark item that a document holds.

    An item is found if 80 % of its five-word windows are, or 13 of its words in a row. The
    benchmark is the query set: it is read in blocks of at most about ``block_chars``
    characters (one for any usual benchmark), each of which is broadcast and joined inside
    one pass over the documents, so memory has a bound and no document is shuffled. Items of
    fewer than five words have no window and are not searched; null texts and ids of items
    are skipped, null document texts hold nothing. Repeated rows are reported once.
    """
    items = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = int(total // block_chars) + 1
    found = None
    for number in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number) if blocks > 1 else items
        block = Block.of(sorted((r["item_id"], r["text"]) for r in rows.collect()))
        source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
        part = source.mapInArrow(_searched(block), "doc_id long, item_id long, n_found long, n_windows long, longest_run long")
        found = part if found is None else found.unionByName(part)
    keys = ["doc_id", "item_id"]
    return found.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n_found", "n_windows", "longest_run")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without an id stay, as none can be named."""
    return without_ids(docs, contaminated(docs, benchmark))
