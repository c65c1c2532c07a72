"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy.

Counts of all training tokens are summed by Spark; they give the unigram base and, inside
the classes, the start of the model. p(word | history) = p(class | state) p(word | class,
state) for the most frequent words; all others share one class, inside which a word has its
add-one share. The recurrent weights are learned by truncated backpropagation over all tokens of all
training documents, in tasks of about the same number of tokens whose weights are averaged
in a tree; each round learns from its own half of the segments.
Scoring carries the state across windows, so a document's log-likelihood covers all of it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftaudit.llm.common import doc_crc
from weftaudit.sources.shared import materialised

END = "\n"  # no word can hold it
HELD_OUT_MODULUS, HELD_OUT_REST = 7, 2
#: Words with their own output weights, and their classes.
VOCABULARY, CLASSES = 2048, 32
#: Words whose counts every task knows; counts of the others come by a join.
DICTIONARY = 1 << 18
HIDDEN, STEPS, SEGMENT = 16, 32, 128
#: Rounds, each over its own part of the segments; tokens of a trainer in a round, about; segments side by side in a step.
ROUNDS, TRAINER_TOKENS, LANES = 2, 1_000_000, 128
#: Trainers whose weights one task averages; so many or fewer are averaged by the driver.
FAN = 32
#: Rows, and bytes of Arrow data, that are worked on at a time.
GROUP, GROUP_BYTES = 2048, 8 << 20
#: Tokens of a window of scoring, about, and its steps at least: arrays that stay in a core's cache.
WINDOW, WINDOW_STEPS = 8192, 4
#: Distinct words that a task counts before it hands them on, about.
COUNTER = 500_000


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows and bytes (a longer text is a group by itself)."""
    for batch in batches:
        size = max(1, min(GROUP, batch.num_rows * GROUP_BYTES // max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, size):
            yield batch.slice(first, size)


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The same words of all texts, one text after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    words = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not filled.all():  # a text without words is one empty word
        sizes[np.repeat(np.arange(len(sizes)), sizes)[~filled]] = 0
        words = words.filter(pa.array(filled))
    return words, sizes


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    ends = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for group in groups(batches):
        found = split_words(group["text"])[0].value_counts()
        held.append(pa.table({"word": found.field("values").cast(pa.string()), "n": found.field("counts")}))
        ends += group.num_rows
        if sum(map(len, held)) > COUNTER:
            held = [merged()]
            if len(held[0]) > COUNTER // 2:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "n"])


def training_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training documents, the end among the words."""
    train = docs.filter(doc_crc() % HELD_OUT_MODULUS != HELD_OUT_REST).select("text")
    return train.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The frequent words by descending count, their counts, and the totals of the training tokens."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.ids = {w: i for i, w in enumerate(self.words)}
        self.neural = min(VOCABULARY, len(self.words))
        self.size = -(-max(1, self.neural) // CLASSES)  # words in a class
        self.classes = -(-self.neural // self.size)
        self.other = self.classes * self.size  # the id of all other words, a class of its own after these
        self.logs = np.log10(self.counts + 1.0)
        own = float((self.counts[: self.neural] + 1.0).sum())
        self.others = self.total + self.distinct + 1.0 - own  # sum of n + 1 of the other words, and one unknown word

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the dictionary, -1 for words beyond it."""
        return np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def neural_ids(self, ids: np.ndarray) -> np.ndarray:
        """The ids that the network reads and predicts: all words without weights of their own are one."""
        return np.where((ids < 0) | (ids >= self.neural), self.other, ids)

    def places(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Places in the dictionary of all tokens of some texts, ends included, and where each text begins.

        Each distinct word is looked up once. Also returned: the distinct words, and for each
        token the number of its word among them, -1 for an end.
        """
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        found = self.ids_of(distinct.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(sizes + 1) - 1
        codes = np.full(len(words) + len(sizes), -1, dtype=np.int64)
        inside = np.ones(len(codes), dtype=bool)
        inside[ends] = False
        codes[inside] = coded.indices.to_numpy()
        return np.append(found, self.ids.get(END.encode(), -1))[codes], ends - sizes, distinct, codes

    @staticmethod
    def of(counts: DataFrame) -> Lexicon:
        totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).toArrow()
        words = [w.encode() for w in top["word"].to_pylist()]
        n = top["n"].to_numpy().astype(np.float64)
        return Lexicon(words, n, totals["n"] or 0, totals["v"] or 0)


@dataclass
class Network:
    """Gate inputs of each word, recurrent weights, class weights and word weights."""

    inputs: np.ndarray  # (words + 1, 3 H), the last row for all other words
    inner: np.ndarray  # (H, 3 H)
    classes: np.ndarray  # (H + 1, C + 1), the last row is the bias
    words: np.ndarray  # (C, H + 1, size)

    @staticmethod
    def start(lexicon: Lexicon, seed: int = 5) -> Network:
        """Small random weights; the biases make the untrained model equal to the unigram base."""
        rng = np.random.default_rng(seed)
        c, size = lexicon.classes, lexicon.size
        share = np.zeros(c * size)
        share[: lexicon.neural] = lexicon.counts[: lexicon.neural] + 1.0
        share = share.reshape(c, size)
        classes = np.concatenate([np.zeros((HIDDEN, c + 1)), [np.log(np.append(share.sum(1), max(lexicon.others, 1e-9)))]])
        words = np.zeros((c, HIDDEN + 1, size))
        words[:, :HIDDEN] = rng.normal(0, 0.02, (c, HIDDEN, size))
        words[:, HIDDEN] = np.where(share > 0, np.log(np.maximum(share, 1e-9)), -1e9)
        inputs = rng.normal(0, 0.3, (lexicon.other + 1, 3 * HIDDEN))
        inner = rng.normal(0, 0.3 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
        return Network(*(x.astype(np.float32) for x in (inputs, inner, classes, words)))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.inner, self.classes, self.words]

    def dump(self) -> bytes:
        return b"".join(p.tobytes() for p in self.parts())

    def load(self, raw: bytes | np.ndarray) -> Network:
        flat, at, parts = np.frombuffer(raw, dtype=np.float32) if isinstance(raw, bytes) else raw, 0, []
        for p in self.parts():
            parts.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return Network(*parts)

    def run(self, ids: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """States before each of the (T, B) ids, the state after them, and what the backward pass needs (if kept).

        The gates are held as (3, B, H) at each step, so that each of them is one run of memory.
        """
        steps, lanes = ids.shape
        gates = np.ascontiguousarray(self.inputs.take(ids, axis=0).reshape(steps, lanes, 3, HIDDEN).transpose(0, 2, 1, 3))
        inners = np.empty((steps if keep else 1, lanes, 3 * HIDDEN), dtype=gates.dtype)
        states = np.empty((steps, lanes, HIDDEN), dtype=gates.dtype)
        held = np.empty((lanes, HIDDEN), dtype=gates.dtype)
        for t in range(steps):
            states[t] = state
            inner = np.matmul(states[t], self.inner, out=inners[t if keep else 0]).reshape(lanes, 3, HIDDEN).transpose(1, 0, 2)
            zr, new = gates[t, :2], gates[t, 2]
            zr += inner[:2]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new += np.multiply(zr[1], inner[2], out=held)
            np.tanh(new, out=new)
            state = states[t] - new
            state *= zr[0]
            state += new
        return states, state, (gates, inners)

    def log_probs(self, states: np.ndarray, targets: np.ndarray, slopes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of p(target | state), targets as class-wise ids; with ``slopes`` also the gradient by state.

        ``slopes`` are arrays like ``classes`` and ``words``, to which the gradients of minus
        the sum of the logs are added.
        """
        count, size = len(self.words), self.words.shape[2]
        kind = np.minimum(targets // size, count)
        raw = states @ self.classes[:-1]
        raw += self.classes[-1]
        raw -= raw.max(1, keepdims=True)
        rows = np.arange(len(targets))
        logs = raw[rows, kind]
        np.exp(raw, out=raw)
        sums = raw.sum(1)
        logs -= np.log(sums)
        back = None
        if slopes is not None:
            raw /= sums[:, None]
            raw[rows, kind] -= 1.0
            slopes[0][:-1] += states.T @ raw
            slopes[0][-1] += raw.sum(0)
            back = raw @ self.classes[:-1].T
        order = np.argsort(kind.astype(np.int16), kind="stable")  # a radix sort
        edges = np.searchsorted(kind[order], np.arange(count + 1)).tolist()
        order = order[: edges[count]]
        held, at = states.take(order, axis=0), targets[order] % size
        inside = np.empty(len(order), dtype=raw.dtype)
        behind = np.empty_like(held) if slopes is not None else None
        for c in range(count):
            a, b = edges[c], edges[c + 1]
            if a == b:
                continue
            raw = held[a:b] @ self.words[c, :-1]
            raw += self.words[c, -1]
            raw -= raw.max(1, keepdims=True)
            own = (rows[: b - a], at[a:b])
            picked = raw[own]
            np.exp(raw, out=raw)
            sums = raw.sum(1)
            np.subtract(picked, np.log(sums), out=inside[a:b])
            if slopes is not None:
                raw /= sums[:, None]
                raw[own] -= 1.0
                slopes[1][c, :-1] += held[a:b].T @ raw
                slopes[1][c, -1] += raw.sum(0)
                np.matmul(raw, self.words[c, :-1].T, out=behind[a:b])
        logs[order] += inside
        if slopes is not None:
            back[order] += behind
        return logs, back

    def step(self, ids: np.ndarray, alive: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], float]:
        """One truncated window: the state after it, the gradients of its parts, and the mean log-likelihood."""
        states, after, (gates, inners) = self.run(ids, state, keep=True)
        flat = alive.ravel()
        grads = [np.zeros_like(p) for p in self.parts()]
        logs, back = self.log_probs(states.reshape(-1, HIDDEN)[flat], ids.ravel()[flat], (grads[2], grads[3]))
        by_state = np.zeros((len(flat), HIDDEN), dtype=states.dtype)
        by_state[flat] = back
        by_state = by_state.reshape(states.shape)
        z, r, new = gates[:, 0], gates[:, 1], gates[:, 2]
        by_new = (1 - z) * (1 - new * new)
        by_gates = np.concatenate([(states - new) * z * (1 - z), by_new * inners[:, :, 2 * HIDDEN :] * r * (1 - r), by_new * r], 2)
        slopes = np.empty((*ids.shape, 3 * HIDDEN), dtype=states.dtype)  # of the products with ``inner``
        carried = np.zeros_like(state)
        carries = np.empty_like(states)
        back = self.inner.T.copy()
        for t in range(len(ids) - 1, -1, -1):
            carries[t] = carried
            np.multiply(by_gates[t].reshape(-1, 3, HIDDEN), carried[:, None, :], out=slopes[t].reshape(-1, 3, HIDDEN))
            carried = carried * z[t] + slopes[t] @ back + by_state[t]
        grads[1] += states.reshape(-1, HIDDEN).T @ slopes.reshape(-1, 3 * HIDDEN)
        slopes[:, :, 2 * HIDDEN :] = carries * by_new  # now of the gates
        order = np.argsort(ids.ravel().astype(np.int16), kind="stable")
        words = ids.ravel()[order]
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        grads[0][words[starts]] = np.add.reduceat(slopes.reshape(-1, 3 * HIDDEN).take(order, axis=0), starts, axis=0)
        scale = np.float32(1.0 / max(1, int(flat.sum())))
        for grad in grads:
            grad *= scale
        return after, grads, float(logs.mean()) if len(logs) else 0.0

    def train(self, segments: Iterable[np.ndarray], rate: float = 0.15, lanes: int = LANES) -> int:
        """AdaGrad over the segments as they come, ``lanes`` at a time, in place; the number of their tokens.

        Inside a segment the state goes on from window to window, gradients do not.
        """
        seen, spare = [np.full_like(p, 1e-6) for p in self.parts()], [np.empty_like(p) for p in self.parts()]
        other = len(self.inputs) - 1
        tokens = 0
        segments = iter(segments)
        while chosen := [s for s, _ in zip(segments, range(lanes))]:
            length = max(map(len, chosen))
            ids = np.full((length, len(chosen)), other, dtype=np.int64)
            alive = np.zeros(ids.shape, dtype=bool)
            for lane, segment in enumerate(chosen):
                ids[: len(segment), lane] = segment
                alive[: len(segment), lane] = True
                tokens += len(segment)
            state = np.zeros((len(chosen), HIDDEN), dtype=np.float32)
            for at in range(0, length, STEPS):
                state, grads, _ = self.step(ids[at : at + STEPS], alive[at : at + STEPS], state)
                for part, grad, sums, held in zip(self.parts(), grads, seen, spare):
                    np.minimum(grad, 1.0, out=grad)
                    np.maximum(grad, -1.0, out=grad)
                    sums += np.multiply(grad, grad, out=held)
                    grad *= np.float32(rate)
                    grad /= np.sqrt(sums, out=held)
                    part -= grad
        return tokens


def _segments(lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lexicon = lexicon.value
        row = 0
        for group in groups(batches):
            ids, starts, *_ = known.places(*split_words(group["text"]))
            flat = known.neural_ids(ids).astype("<i2")
            sizes = np.diff(np.append(starts, len(flat)))
            pieces = -(-sizes // SEGMENT)  # segments cover all ids of a document
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            edges = np.append(np.repeat(starts, pieces) + number * SEGMENT, len(flat))
            lowered = pc.ascii_lower(group["text"].fill_null("")).cast(pa.binary()).to_numpy(zero_copy_only=False)
            places = []
            for doc_id, raw, count in zip(group["doc_id"].to_pylist(), lowered, pieces.tolist()):
                row += 1
                # copies go to different trainers, and so do rows without an id
                place = zlib.crc32(f"{f'row {row}' if doc_id is None else doc_id}".encode(), zlib.crc32(raw))
                places += [zlib.crc32(n.to_bytes(8, "little"), place) for n in range(count)]
            held = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), held, pa.array(np.diff(edges))], names=["place", "ids", "n"])

    return rows


def _learned(shared, start, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weights after a trainer's segments, which stream by; one row with their tokens, none without segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.start(shared.value).load(start.value)
        tokens = own.train((np.frombuffer(s, "<i2").astype(np.int64) for b in batches for s in b["ids"].to_pylist()), rate)
        if tokens:
            trainer = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([trainer], pa.int64()), pa.array([tokens], pa.int64()), pa.array([own.dump()], pa.binary())], names=["trainer", "n", "weights"])

    return rows


def mean_weights(rows: Iterable[tuple[int, bytes]]) -> tuple[int, np.ndarray | None]:
    """The number of all tokens, and the mean of the weights by number of tokens, one row in memory at a time."""
    total, sums = 0, None
    for n, raw in rows:
        part = np.frombuffer(raw, np.float32) * np.float64(n)
        sums = part if sums is None else sums + part
        total += n
    return total, None if sums is None else (sums / total).astype(np.float32)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mean = mean_weights((r["n"], r["weights"]) for b in batches for r in b.to_pylist())
    if total:
        group = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([total], pa.int64()), pa.array([mean.tobytes()], pa.binary())], names=["trainer", "n", "weights"])


def average_in_tree(learned: DataFrame, trainers: int, fan: int = FAN) -> np.ndarray | None:
    """The mean of the weights of (trainer, n, weights): groups of ``fan`` in a task each, until so many are left for the driver."""
    learned = materialised(learned)
    while trainers > fan:
        trainers = -(-trainers // fan)
        dealt = learned.repartitionById(trainers, F.floor(F.col("trainer") / fan).cast("int")).sortWithinPartitions("trainer")
        learned = materialised(dealt.mapInArrow(_averaged, learned.schema))
    return mean_weights((r["n"], bytes(r["weights"])) for r in learned.orderBy("trainer").collect())[1]


def train_network(docs: DataFrame, lexicon: Lexicon, shared) -> Network:
    """Weights learned from every token of every training document, once.

    Documents are cut into segments, which hashes of id, text and place deal to rounds and
    trainers. The number of trainers grows with the tokens, so that each streams about
    ``TRAINER_TOKENS`` in a round whatever the input; each starts from the common weights,
    and the round's result is their mean by number of tokens, formed in a tree. What reaches
    the driver is at most ``FAN`` weight vectors. Equal segments are learned from as often as
    they occur.
    """
    network = Network.start(lexicon)
    if not lexicon.neural:
        return network
    spark = docs.sparkSession
    train = docs.filter(doc_crc() % HELD_OUT_MODULUS != HELD_OUT_REST).select("doc_id", "text")
    segments = materialised(train.mapInArrow(_segments(shared), "place long, ids binary, n long"))
    trainers = max(1, round(lexicon.total / ROUNDS / TRAINER_TOKENS))
    for number in range(ROUNDS):
        own = segments.filter(F.pmod("place", F.lit(ROUNDS)) == number)
        trainer = F.pmod(F.floor(F.col("place") / ROUNDS), F.lit(trainers)).cast("int")
        dealt = own.repartitionById(trainers, trainer).sortWithinPartitions("place", "ids").select("ids")
        start = spark.sparkContext.broadcast(network.dump())
        learned = dealt.mapInArrow(_learned(shared, start, 0.15 / (1 + number)), "trainer long, n long, weights binary")
        mean = average_in_tree(learned, trainers)
        if mean is not None:
            network = network.load(mean)
    return network


def score_group(network: Network, lexicon: Lexicon, docs: list[np.ndarray]) -> np.ndarray:
    """Log10-likelihood of each document's ids (all its tokens)."""
    if not docs:
        return np.zeros(0)
    return score_flat(network, lexicon, np.concatenate(docs), np.array([len(d) for d in docs]))


def score_flat(network: Network, lexicon: Lexicon, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for documents one after the other, states carried from window to window.

    The fewer documents are left, the more steps a window has.
    """
    totals = np.zeros(len(sizes))
    if not lexicon.neural or not len(sizes):
        return totals
    lanes = np.argsort(-sizes, kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[lanes], sizes[lanes]
    state, at = np.zeros((len(sizes), HIDDEN), dtype=np.float32), 0
    while at < lengths[0]:
        n = int(np.searchsorted(-lengths, -at))  # documents that are longer
        steps = np.arange(at, min(at + max(WINDOW_STEPS, WINDOW // n), lengths[0]))[:, None]
        alive = np.flatnonzero(steps < lengths[None, :n])
        ids = flat[np.minimum(starts[None, :n] + steps, len(flat) - 1)]
        states, state, _ = network.run(ids, state[:n])
        logs, _ = network.log_probs(states.reshape(-1, HIDDEN).take(alive, axis=0), ids.ravel()[alive])
        totals[lanes[:n]] += np.bincount(alive % n, weights=logs, minlength=n)
        at += len(steps)
    return totals / math.log(10)


def _scored(shared, weights):
    names = ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base", "neural"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        network = Network.start(lexicon).load(weights.value)
        share = math.log10(lexicon.others) if lexicon.others > 0 else 0.0
        held = np.append(lexicon.logs, 0.0)  # the last one for words beyond the dictionary
        row = TaskContext.get().partitionId() << 40
        for group in groups(batches):
            words, sizes = split_words(group["text"])
            ids, starts, distinct, codes = lexicon.places(words, sizes)
            own = (ids >= 0) & (ids < lexicon.neural)
            logs = held[ids]
            base = np.add.reduceat(logs, starts)
            inside = np.add.reduceat(np.where(own, 0.0, logs - share), starts)
            known = np.add.reduceat((ids >= 0).astype(np.int64), starts)
            numbers = np.arange(row, row + len(sizes))
            row += len(sizes)
            likely = inside + score_flat(network, lexicon, lexicon.neural_ids(ids), sizes + 1)
            marks = [f"{END}{r}" for r in numbers.tolist()]
            columns = [numbers, group["doc_id"], marks, np.zeros(len(sizes)), sizes + 1, known, base, likely]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            at = np.flatnonzero(ids < 0)
            pairs, times = np.unique((np.searchsorted(starts, at, side="right") - 1) * (len(distinct) + 1) + codes[at] + 1, return_counts=True)
            doc, code = np.divmod(pairs, len(distinct) + 1)
            rare = pa.concat_arrays([pa.array([END], distinct.type), distinct]).take(pa.array(code)).cast(pa.string())
            columns = [numbers[doc], group["doc_id"].take(pa.array(doc)), rare, times] + [np.zeros(len(doc))] * 4
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return rows


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of all tokens, the end included. Every word has the
    count that it has in all training documents: the most frequent ones are known to the
    tasks, the others are joined by word, each document's rare words once with their number
    (hot words are among the known, so the join has none). A null or empty text is its end
    alone; a null id counts as the empty text in the split. Without training documents both
    scores are 0. Only doc_id and text are read; repeated rows are scored apart.
    """
    spark = docs.sparkSession
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    counts = materialised(training_counts(source))
    lexicon = Lexicon.of(counts)
    shared = spark.sparkContext.broadcast(lexicon)
    weights = spark.sparkContext.broadcast(train_network(source, lexicon, shared).dump())
    schema = "row long, doc_id long, word string, times long, n_tokens long, n_known long, base double, neural double"
    rows = source.mapInArrow(_scored(shared, weights), schema)
    joined = rows.join(counts.hint("merge"), "word", "left")
    rare = F.when(F.col("n").isNotNull(), F.col("times") * F.log10(F.col("n") + 1.0)).otherwise(0.0)
    sums = joined.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare).alias("base"),
        F.sum(F.col("neural") + rare).alias("neural"),
    )
    size = math.log10(lexicon.total + lexicon.distinct + 1.0)
    return sums.select(
        "doc_id",
        (doc_crc() % HELD_OUT_MODULUS == HELD_OUT_REST).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        F.col("neural").alias("score"),
    )
