"""Source divergence audit by in-mapper stripes.

A partition folds whole documents into stripes: term -> (document frequency, counts by
source). A full table is spilled, that is given out as partial stripes, and a new one is
begun. A shuffle by (lang, term) brings partial stripes together in key order, where they
are merged as they stream by. Merged stripes of terms in enough documents are stored; from
them come the totals, and then each stripe gives its part of all divergences directly.

Copies, hot sources and hot terms meet inside the partitions first: what a term sends to
its key is one stripe per partition and spill, however often it occurs.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftaudit.llm.common import slices
from weftaudit.sources.shared import materialised

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Entries (lang, source, term) that a task holds before it spills.
SPILL = 500_000
#: Bytes of texts that are split into words at a time.
BLOCK = 2 << 20
#: Stripes that are given out or worked on together.
ROWS = 2048
#: Sources whose differences a task holds as one square.
TILE = 256
#: Group rows (lang, source, total) that every task may get.
MOST_GROUPS = 100_000

STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_STRIPE = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
)

#: Byte by byte: A-Z in lower case, a-z and all bytes of other characters than ASCII kept, the rest a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 texts, one after the other, and the number of the text of each; ASCII other than letters separates."""
    joined = np.frombuffer(b" ".join(texts).translate(_WORDS), dtype=np.uint8)
    letter = joined != 32
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(edge == -1) - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(joined[letter])])
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return words, np.searchsorted(begin, starts, side="right") - 1


def entries(texts: list[bytes], groups: np.ndarray) -> pa.Table:
    """(group, term, docs, count) of texts: in how many texts of the group a term is, and how often."""
    words, text = tokens(texts)
    coded = words.dictionary_encode()
    v = max(1, len(coded.dictionary))
    pair, times = np.unique(text * v + coded.indices.to_numpy(), return_counts=True)
    of, term = np.divmod(pair, v)
    cell, at = np.unique(groups[of] * v + term, return_inverse=True)
    count = np.zeros(len(cell), dtype=np.int64)
    np.add.at(count, at, times)
    group, term = np.divmod(cell, v)
    return pa.table({"group": group, "term": coded.dictionary.take(pa.array(term)), "docs": np.bincount(at, minlength=len(cell)), "count": count})


def _blocks(text: bytes, size: int) -> Iterator[bytes]:
    """A long text cut at separators into blocks of ``size`` bytes or, where a word is longer, of more."""
    separator = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
    at = 0
    while at < len(text):
        cut = separator.search(text, at + size)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


class Stripes:
    """The hash table of one task: term -> (document frequency, count) for each lang and source.

    Documents are counted some megabytes at a time; their entries are folded into those that
    are there already by a hash aggregate.
    """

    def __init__(self, spill: int, block: int) -> None:
        self.limit, self.block = spill, block
        self._clear()

    def _clear(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.tables: list[pa.Table] = []
        self.waiting: list[tuple[int, bytes]] = []
        self.bytes = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        if len(text) > self.block:  # counted block by block, as one document
            parts = pa.concat_tables([entries([part], np.array([group])) for part in _blocks(text, self.block)])
            whole = _summed(parts)
            self.tables.append(whole.set_column(2, "docs", pa.array(np.ones(whole.num_rows, dtype=np.int64))))
            return
        self.waiting.append((group, text))
        self.bytes += len(text)
        if self.bytes >= self.block:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.tables.append(entries([t for _, t in self.waiting], np.array([g for g, _ in self.waiting], dtype=np.int64)))
            self.waiting, self.bytes = [], 0

    def full(self) -> bool:
        """Whether the table, folded together, holds more entries than half of the limit."""
        if sum(t.num_rows for t in self.tables) < self.limit:
            return False
        self.tables = [_summed(pa.concat_tables(self.tables))]
        return 2 * self.tables[0].num_rows > self.limit

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes, one for each lang and term; the table is empty afterwards."""
        self._count()
        if self.tables:
            table = _summed(pa.concat_tables(self.tables)).combine_chunks()
            names = list(self.groups)
            langs = sorted({lang for lang, _ in names})
            lang_of = np.array([langs.index(lang) for lang, _ in names])
            coded = table["term"].chunk(0).dictionary_encode() if table.num_rows else pa.array([], pa.binary()).dictionary_encode()
            v, group = max(1, len(coded.dictionary)), table["group"].to_numpy()
            key = lang_of[group] * v + coded.indices.to_numpy() if table.num_rows else np.zeros(0, dtype=np.int64)
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            if len(key):
                lang, term = np.divmod(key, v)
                yield from _stripe_batches(
                    pa.array(langs, pa.string()).take(pa.array(lang)),
                    coded.dictionary.take(pa.array(term)).cast(pa.string()),
                    pa.array(np.add.reduceat(table["docs"].to_numpy()[order], first)),
                    np.append(first, len(order)).astype(np.int32),
                    pa.array([s for _, s in names], pa.string()).take(pa.array(group[order])),
                    pa.array(table["count"].to_numpy()[order]),
                )
        self._clear()


def _summed(table: pa.Table) -> pa.Table:
    done = table.group_by(["group", "term"], use_threads=False).aggregate([("docs", "sum"), ("count", "sum")])
    return done.select(["group", "term", "docs_sum", "count_sum"]).rename_columns(["group", "term", "docs", "count"])


def _stripe_batches(lang: pa.Array, term: pa.Array, df: pa.Array, ends: np.ndarray, sources: pa.Array, counts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Stripes from columns; stripe i has the sources and counts from ``ends[i]`` to ``ends[i + 1]``."""
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c) for c in (sources, counts)]
    whole = pa.RecordBatch.from_arrays([lang, term, df, *lists], schema=_STRIPE)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _fold(spill: int, block: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes(spill, block)
        for batch in slices(batches):
            texts = batch["text"].cast(pa.binary())
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts):
                stripes.add(lang, source, text.as_py())
            if stripes.full():
                yield from stripes.spill()
        yield from stripes.spill()

    return fold


def merged(rows: pa.RecordBatch) -> pa.RecordBatch:
    """One stripe for each key of a batch that is sorted by key."""
    n = rows.num_rows
    new = np.ones(n, dtype=bool)
    differs = [pc.not_equal(rows[c].slice(1), rows[c].slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in ("lang", "term")]
    new[1:] = differs[0] | differs[1]
    first = np.flatnonzero(new)
    if len(first) == n:
        return rows
    sizes = rows["sources"].value_lengths().to_numpy()
    names = rows["sources"].flatten().dictionary_encode()
    code = np.repeat(np.cumsum(new) - 1, sizes) * len(names.dictionary) + names.indices.to_numpy()
    cell, at = np.unique(code, return_inverse=True)
    counts = np.zeros(len(cell), dtype=np.int64)
    np.add.at(counts, at, rows["counts"].flatten().to_numpy())
    key, source = np.divmod(cell, max(1, len(names.dictionary)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(first)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), c) for c in (names.dictionary.take(pa.array(source)), pa.array(counts))]
    df = pa.array(np.add.reduceat(rows["df"].to_numpy(), first))
    return pa.RecordBatch.from_arrays([rows["lang"].take(pa.array(first)), rows["term"].take(pa.array(first)), df, *lists], schema=_STRIPE)


def _merge(min_docs: int):
    """Partial stripes in the order of their keys become one stripe for each key; rare terms go.

    Batches are merged whole; the last key of a batch, one stripe by then, is put before the next batch.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                rows = batch if last is None else pa.concat_batches([last, batch.cast(_STRIPE)])
                done = merged(rows)
                last = done.slice(done.num_rows - 1)
                yield _frequent(done.slice(0, done.num_rows - 1), min_docs)
        if last is not None:
            yield _frequent(last, min_docs)

    return merge


def _frequent(rows: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    return rows.filter(pc.greater_equal(rows["df"], min_docs))


def stripes(docs: DataFrame, min_docs: int = MIN_DOCS, spill: int = SPILL, block: int = BLOCK) -> DataFrame:
    """Merged stripes (lang, term, df, sources, counts) of the terms in ``min_docs`` documents or more of their lang.

    ``docs`` has lang, source and text; nulls count as ''. Every row is a document.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = read.mapInArrow(_fold(spill, block), STRIPE)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = partial.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return keyed.mapInArrow(_merge(min_docs), STRIPE)


def likelihood(count: int, total: int, n_terms: int) -> int:
    """The smoothed share of a term in whole numbers of 1 / SCALE; Python's integers are exact at any size."""
    return 1 + SCALE * (count + SMOOTHING) // (total + SMOOTHING * n_terms)


class Groups:
    """Totals of each lang and of its sources, in tiles of sources; small, and sent to every task."""

    def __init__(self, rows: list, n_terms: dict[str, int]) -> None:
        self.terms = n_terms
        self.sources: dict[str, list[str]] = {}
        self.totals: dict[str, np.ndarray] = {}
        for lang in sorted({r["lang"] for r in rows}):
            own = sorted((r["source"], r["total"]) for r in rows if r["lang"] == lang)
            self.sources[lang] = [s for s, _ in own]
            self.totals[lang] = np.array([t for _, t in own], dtype=np.int64)
        self.place = {lang: {s: i for i, s in enumerate(own)} for lang, own in self.sources.items()}
        self.sums = {lang: sum(map(int, own)) for lang, own in self.totals.items()}
        #: What each source gives a term that it does not hold.
        self.rest = {
            lang: np.array([likelihood(0, int(t), n_terms[lang]) for t in own], dtype=np.int64)
            for lang, own in self.totals.items()
            if n_terms.get(lang)
        }


PAIR = "lang string, a int, b int, value long"
TERM = "lang string, source string, item string, value long"


def _square(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over rows of |p[:, i] - q[:, j]| for all i and j."""
    return np.stack([np.abs(q - p[:, i : i + 1]).sum(axis=0) for i in range(p.shape[1])]) if p.shape[1] else np.zeros((0, q.shape[1]), np.int64)


def _pair_sums(groups: Groups, tile: int):
    """Stripes of (lang, tile numbers x <= y) become that pair of tiles' sums of |p - q|."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                by: dict[tuple[str, int, int], list[int]] = {}
                for i, key in enumerate(zip(rows["lang"].to_pylist(), rows["x"].to_pylist(), rows["y"].to_pylist())):
                    by.setdefault(key, []).append(i)
                sources, counts = rows["sources"].to_pylist(), rows["counts"].to_pylist()
                for (lang, x, y), some in by.items():
                    place, totals, v = groups.place[lang], groups.totals[lang], groups.terms[lang]
                    p = np.repeat(groups.rest[lang][None, :], len(some), axis=0)
                    for row, i in enumerate(some):
                        for source, count in zip(sources[i], counts[i]):
                            p[row, place[source]] = likelihood(count, int(totals[place[source]]), v)
                    one = _square(p[:, x * tile : (x + 1) * tile], p[:, y * tile : (y + 1) * tile])
                    old = held.get((lang, x, y))
                    held[lang, x, y] = one if old is None else old + one
                    if len(held) > 16:
                        yield from _squares(held, tile)
        yield from _squares(held, tile)

    return sums


def _squares(held: dict[tuple[str, int, int], np.ndarray], tile: int) -> Iterator[pa.RecordBatch]:
    for (lang, x, y), one in held.items():
        a, b = (i.ravel() for i in np.indices(one.shape))
        wanted = (a + x * tile) < (b + y * tile)
        columns = [(a + x * tile)[wanted], (b + y * tile)[wanted], one.ravel()[wanted]]
        n = int(wanted.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
            names=["lang", "a", "b", "value"],
        )
    held.clear()


class _Last:
    """A term and its value in a heap whose smallest entry is the last in rank: small value, then large term."""

    __slots__ = ("value", "term")

    def __init__(self, value: int, term: str) -> None:
        self.value, self.term = value, term

    def __lt__(self, other: _Last) -> bool:
        return self.value < other.value or (self.value == other.value and self.term.encode() > other.term.encode())


def _top_terms(groups: Groups, top: int):
    """The first ``top`` terms by p - q > 0 of each (lang, source) among a task's stripes."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[str, str], list[_Last]] = {}
        for batch in slices(batches):
            for lang, term, sources, counts in zip(*(batch[c].to_pylist() for c in ("lang", "term", "sources", "counts"))):
                v, totals, place = groups.terms[lang], groups.totals[lang], groups.place[lang]
                q = likelihood(sum(counts), groups.sums[lang], v)
                for source, count in zip(sources, counts):
                    value = likelihood(count, int(totals[place[source]]), v) - q
                    if value <= 0 or count <= 0:
                        continue
                    heap = heaps.setdefault((lang, source), [])
                    if len(heap) < top:
                        heapq.heappush(heap, _Last(value, term))
                    elif value >= heap[0].value:
                        heapq.heappushpop(heap, _Last(value, term))
        for (lang, source), heap in heaps.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(heap), pa.string()), pa.array([source] * len(heap), pa.string()),
                    pa.array([h.term for h in heap], pa.string()), pa.array([h.value for h in heap], pa.int64()),
                ],
                names=["lang", "source", "item", "value"],
            )

    return terms


def divergences(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, spill: int = SPILL, block: int = BLOCK, tile: int = TILE, most_groups: int = MOST_GROUPS
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Part ``pair``: the summed absolute difference of term likelihoods to each other source
    of the lang (0 if the lang keeps no term). Part ``term``: the first ``top`` kept terms of
    the group that are likelier in it than in its whole lang, by the difference. Likelihoods
    are whole numbers of 1 / SCALE with additive smoothing over the kept terms of the lang;
    ranks go by value downwards and item upwards in UTF-8.

    Null text, lang and source count as ''. Empty texts make a group without terms, which
    is compared like any other. Rows that repeat count each. Texts of any length are read in
    blocks. An empty table gives no rows. Columns other than lang, source and text are not
    read, so their names do not matter. The result has one row per ordered pair of sources of
    a lang, so the list of groups has to be small; up to ``most_groups`` of them are sent to
    all tasks, and more are an error, not a cut.
    """
    spark = docs.sparkSession
    read = docs.select("lang", "source", "text")
    merged = materialised(stripes(read, min_docs, spill, block))
    n_terms = {r["lang"]: r["n"] for r in merged.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counts = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    totals = counts.groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.counts").alias("total"))
    named = read.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    rows = named.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))).take(most_groups + 1)
    if len(rows) > most_groups:
        raise ValueError(f"more than {most_groups} groups of lang and source; the pairs of their sources are the result")
    groups = Groups(rows, n_terms)

    tiles = spark.createDataFrame(
        [(lang, x, y) for lang, own in groups.sources.items() if n_terms.get(lang) for x in range(-(-len(own) // tile)) for y in range(x, -(-len(own) // tile))],
        "lang string, x int, y int",
    )
    spread = merged.join(F.broadcast(tiles), "lang").select("lang", "x", "y", "sources", "counts")
    sums = spread.mapInArrow(_pair_sums(groups, tile), PAIR).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    index = spark.createDataFrame([(lang, i, s) for lang, own in groups.sources.items() for i, s in enumerate(own)], "lang string, at int, source string")
    left = index.select("lang", F.col("at").alias("a"), F.col("source").alias("one"))
    right = index.select("lang", F.col("at").alias("b"), F.col("source").alias("two"))
    pairs = left.join(right, (left["lang"] == right["lang"]) & (left["a"] < right["b"])).drop(right["lang"])
    known = pairs.join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    both = known.select("lang", F.inline(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))), "value")
    terms = merged.mapInArrow(_top_terms(groups, top), TERM)

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rows = both.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
