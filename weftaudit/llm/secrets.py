"""Secret scans: fixed patterns, and guess costs of values that stand where a credential does.

The guess cost of a value is the smallest log10 of guesses over its segmentations into words
(plain, with signs for letters, reversed), dates, repeats, sequences, keyboard walks, copies
of what stands before, and brute-force spans: the sum over the segments and log10 of the
orders in which they may stand, found by dynamic programming over place and number of
segments. Words are ranked by the documents that hold them; a few frequent passwords come
first. A value in a credential context that costs enough is a span of its own, also where
the fixed patterns see nothing, such as values with signs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import small_slices

KINDS = ("assign", "access", "hex", "value")
#: log10 of the guesses from which a value counts as a secret, and its least length.
LEAST_COST = 8.0
LEAST_CHARS = 8


def _either_case(word: str) -> str:
    """Letters in either ASCII case; other characters as they are."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
# Names after which a credential stands.
_CONTEXT_NAMES = (
    "password passwd passphrase passcode passwort contrasena pwd secret token api_?key api-key apikey access_?key access-key private_?key "
    "private-key auth_?key client_?secret credential credentials authorization bearer mot_de_passe"
).split()
_CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:" + "|".join(map(_either_case, _CONTEXT_NAMES)) + r""")["']?\x20*(?:=>|:=|[:=])\x20*(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"',;<>]+))"""
)
# Frequent passwords and placeholders, most frequent first.
COMMON = (
    "password admin welcome qwerty letmein monkey dragon master login abc iloveyou sunshine princess football baseball shadow superman batman "
    "trustno hello freedom whatever secret test guest root user changeme default example sample placeholder your insert here none null true "
    "false undefined token key api value string pass word demo temp temporary private public access server database local host name mail "
    "company office home love summer winter spring autumn monday friday january october computer internet system service account client "
    "production development staging config setting redacted hidden masked required optional"
).split()
_LEET = str.maketrans("0134578@$!", "oieastbasi")
# Rows of the keyboard, each a little to the right of the one above.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl;", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
#: Steps between neighbouring keys: along a row, down to the right or the left, and back.
_STEPS = frozenset(((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)))
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
#: log10 of guesses: what a repeat, sequence or walk costs beside the length, a turn of a walk, dates and years, and forms of words.
SEQUENCE, WALK, TURN, DATE, YEAR = 1.3, 1.6, 0.5, 4.6, 2.1
LEET, REVERSED, CASED, COPY, SEPARATOR = 0.6, 0.5, 0.3, 0.5, 0.5
#: Signs of which one may stand before a word at no more than their cost.
SEPARATORS = frozenset(" -_./")
#: Least length of a repeat, sequence or walk; of those in a longer one, starts so many places back are tried beside its first.
LEAST_RUN, STARTS = 3, 32
#: Longest block that a copy repeats (whole values may repeat blocks of any length).
BLOCK = 32
#: Learned words: letters, documents that hold them at least, and how many of the most frequent are kept (the bound of what is broadcast).
LEAST_DOCS, MOST_WORDS = 10, 20_000
_WORD = re.compile(r"(?<![^\s\"'(\[])[a-z]{4,20}(?![^\s\"')\].,;:!?])")
COUNTER = 200_000


@dataclass
class Words:
    """log10 of the rank of each known word: the frequent passwords, then learned ones, most frequent first."""

    learned: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rank: dict[str, float] = {}
        for words in (COMMON, self.learned):
            for i, word in enumerate(words):
                self.rank[word] = min(self.rank.get(word, math.inf), math.log10(i + 2))
        self.longest = max(map(len, self.rank))

    def cost(self, low: str, plain: str, cased: bool) -> float:
        """The cheapest reading as one word of a lower-case part and of its form with letters for signs; infinite if there is none."""
        get = self.rank.get
        best = min(get(low, math.inf), get(low[::-1], math.inf) + REVERSED)
        if plain != low:
            best = min(best, get(plain, math.inf) + LEET, get(plain[::-1], math.inf) + LEET + REVERSED)
        return best + CASED * cased


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array(counter.values(), pa.int64())], names=["word", "n"])

    for batch in small_slices(batches):
        for text in batch["text"].to_pylist():
            counter.update(set(_WORD.findall(_CONTEXT.sub(" = ", text or "").lower())))
        if len(counter) > COUNTER:
            yield out()
            counter.clear()
    yield out()


def learn_words(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST_WORDS) -> Words:
    """Words of at least ``least_docs`` rows of ``docs``, the ``most`` most frequent, ties in order of the word.

    Rows are counted over the whole table; values in credential contexts are no words. Only
    the kept words reach the driver.
    """
    counts = docs.select("text").mapInArrow(_counted_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= least_docs).orderBy(F.desc("n"), "word").limit(most).collect()
    return Words([r["word"] for r in rows])


def _alphabet(value: str) -> float:
    """log10 of the size of the alphabet that brute force has to try."""
    sizes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for test, n in sizes if any(map(test, value)))
    if any(not c.isalnum() for c in value):
        size += 33
    if any(ord(c) > 127 for c in value):
        size += 100
    return math.log10(max(size, 10))


class _Runs:
    """Lengths of the repeat, the sequence, the walk and the copies that end at the current character, fed one by one."""

    def __init__(self, value: str, low: str) -> None:
        self.value, self.low, self.at = value, low, 0
        self.repeat = self.sequence = self.walk = self.straight = 1
        self.delta = 0
        self.step: tuple[int, int] | None = None
        self.turns: list[int] = []  # places of the keys at which the walk turns
        self.copies = [0] * (BLOCK + 1)

    def feed(self) -> None:
        i, value, low = self.at, self.value, self.low
        self.at += 1
        if not i:
            return
        self.repeat = self.repeat + 1 if value[i] == value[i - 1] else 1
        delta = ord(value[i]) - ord(value[i - 1])
        self.sequence = self.sequence + 1 if delta == self.delta and delta in (1, -1) else 2 if delta in (1, -1) else 1
        self.delta = delta
        a, b = _PLACE.get(low[i - 1]), _PLACE.get(low[i])
        step = (b[0] - a[0], b[1] - a[1]) if a and b else None
        if step in _STEPS:
            if self.walk > 1 and step != self.step:
                self.turns.append(i - 1)
            self.walk += 1
        else:
            self.walk = 1
            self.turns.clear()
        self.step = step
        for p in range(2, min(BLOCK, i) + 1):
            self.copies[p] = self.copies[p] + 1 if value[i] == value[i - p] else 0

    def starts(self) -> Iterator[int]:
        """First places of all that may go on after the current character."""
        yield from (self.at - n for n in (self.repeat, self.sequence, self.walk))
        yield from (self.at - n for n in self.copies if n)

    def ending(self, brute: float) -> Iterator[tuple[int, float]]:
        """(start, cost) of the patterns that end at the current character."""
        for longest, base in ((self.repeat, brute), (self.sequence, SEQUENCE), (self.walk, WALK)):
            for length in {*range(LEAST_RUN, min(longest, STARTS) + 1), longest}:
                if length >= LEAST_RUN:
                    start = self.at - length
                    turns = sum(t > start for t in self.turns) if base == WALK else 0
                    yield start, base + math.log10(length) + TURN * turns
        tried = 0  # the cost depends on the length only: each is tried once
        for block, longest in enumerate(self.copies):
            if block >= 2 and longest >= block:
                for length in {*range(max(block, tried + 1), min(longest, STARTS) + 1), longest}:
                    yield self.at - length, COPY + math.log10(length)
                tried = max(tried, min(longest, STARTS))


def _fewest(states: dict[int, float]) -> dict[int, float]:
    """Costs by number of segments, without those that fewer segments reach as cheaply."""
    kept, least = {}, math.inf
    for count in sorted(states):
        if states[count] < least:
            kept[count] = least = states[count]
    return kept


def guess_cost(value: str, words: Words | None = None, limit: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation; from ``limit`` on the limit itself, as soon as that is sure.

    A segmentation costs the sum of its segments and log10 of the factorial of their number;
    neighbouring brute-force characters are one segment. Without a limit nothing dearer than
    brute force is followed.
    """
    words = words or _PLAIN_WORDS
    n, low = len(value), value.lower()
    if len(low) != n:  # letters whose lower case is longer
        low = value
    plain = low.translate(_LEET)
    brute = _alphabet(value)
    most = min(limit, n * brute)
    orders = [0.0]
    dates: dict[int, list[int]] = {}
    for match in (m for i in range(n) if value[i] in "0123" for m in [_DATE.match(value, i)] if m):
        dates.setdefault(match.end(), []).append(match.start())
        if match.end() - match.start() > 4 and value[match.start() : match.start() + 2] in ("19", "20"):  # its year alone
            dates.setdefault(match.start() + 4, []).append(match.start())
    # by place: cheapest cost by number of segments, for ends inside brute force and for others
    forced: list[dict[int, float]] = [{}]
    ended: list[dict[int, float]] = [{0: 0.0}]
    runs, live = _Runs(value, low), 0
    for i in range(1, n + 1):
        runs.feed()
        inside = {count: cost + brute for count, cost in forced[i - 1].items()}
        for count, cost in ended[i - 1].items():
            inside[count + 1] = min(inside.get(count + 1, math.inf), cost + brute)
        found = [*runs.ending(brute), *((start, DATE if i - start > 4 else YEAR) for start in dates.get(i, ()))]
        for start in range(max(0, i - words.longest), i - 2):
            joined = start > 0 and value[start - 1] in SEPARATORS and (forced[start - 1] or ended[start - 1])
            if forced[start] or ended[start] or joined:
                cost = words.cost(low[start:i], plain[start:i], low[start:i] != value[start:i])
                if cost < math.inf:
                    found.append((start, cost))
                    if joined:
                        found.append((start - 1, cost + SEPARATOR))
        after: dict[int, float] = {}
        for start, extra in found:
            for states in (forced[start], ended[start]):
                for count, cost in states.items():
                    after[count + 1] = min(after.get(count + 1, math.inf), cost + extra)
        for states, kept in ((inside, forced), (after, ended)):
            while states and len(orders) <= max(states):
                orders.append(orders[-1] + math.log10(len(orders)))
            kept.append({c: x for c, x in _fewest(states).items() if x + orders[c] <= most + 1e-9})
        if forced[i] or ended[i]:
            live = i
        elif i - live > max(words.longest + 1, 10, STARTS) and not any(forced[j] or ended[j] for j in runs.starts()):
            return most  # no cheaper path goes on from here
    return min([most, *(x + orders[c] for states in (forced[n], ended[n]) for c, x in states.items())])


def _period(value: str) -> str:
    """The shortest block that the value repeats, itself if there is none."""
    at = (value + value).find(value, 1)
    return value[:at]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


_PLAIN_WORDS = Words()


def value_spans(text: str, base: list[tuple[int, str, int]], words: Words | None = None, least_cost: float = LEAST_COST) -> list[tuple[int, str, int]]:
    """Values of any length in credential contexts whose guess cost is at least ``least_cost`` and that no base span holds."""
    found = []
    for match in _CONTEXT.finditer(text):
        group = next(i for i in (1, 2, 3) if match[i] is not None)
        value = match[group] if group < 3 else match[group].rstrip(".)]}!?")
        start = match.start(group)
        if len(value) < LEAST_CHARS:
            continue
        if any(a <= start and start + len(value) <= b for a, _, b in base):
            continue
        block = _period(value)
        if guess_cost(block, words, least_cost) + (math.log10(len(value) / len(block)) if len(block) < len(value) else 0.0) >= least_cost:
            found.append((start, "value", start + len(value)))
    return found


def scan(text: str | None, words: Words | None = None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans, in order of start and kind; positions are code points."""
    text = text or ""
    base = base_spans(text)
    return base, sorted([*base, *value_spans(text, base, words)], key=lambda s: (s[0], KINDS.index(s[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame, words: Words | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_value, base_sha256, spans for each row.

    Words are learned from all rows unless given. Null and empty texts have no spans (the
    digest of the empty string). Whole texts of any length are scanned; only doc_id and text
    are read; repeated rows are scanned apart.
    """
    known = docs.sparkSession.sparkContext.broadcast(learn_words(docs) if words is None else words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            found = [scan(t, known.value) for t in batch["text"].to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(every) for _, every in found], pa.string())
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *counts, digests, spans], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_value long, base_sha256 string, spans string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, schema)
