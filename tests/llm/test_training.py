"""The language model's training: all tokens are learned from, by plain loops' gradients, averaged in a tree."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from weftaudit.llm import lm


def _lexicon(n=30):
    return lm.Lexicon([b"w%d" % i for i in range(n)], np.arange(n, 0, -1.0), 600, n + 5)


def _plain_log_likelihood(network, ids):
    """Natural log-likelihood of one sequence, word by word, without arrays over time or classes."""
    hidden, size = lm.HIDDEN, network.words.shape[2]
    state, total = np.zeros(hidden), 0.0
    for word in ids:
        kind = min(word // size, len(network.words))
        scores = state @ network.classes[:-1] + network.classes[-1]
        total += scores[kind] - math.log(sum(math.exp(s) for s in scores))
        if kind < len(network.words):
            scores = state @ network.words[kind, :-1] + network.words[kind, -1]
            total += scores[word % size] - math.log(sum(math.exp(s) for s in scores))
        gates, inner = network.inputs[word], state @ network.inner
        z = 1 / (1 + np.exp(-(gates[:hidden] + inner[:hidden])))
        r = 1 / (1 + np.exp(-(gates[hidden : 2 * hidden] + inner[hidden : 2 * hidden])))
        new = np.tanh(gates[2 * hidden :] + r * inner[2 * hidden :])
        state = (1 - z) * new + z * state
    return total


def test_scores_match_a_plain_loop():
    lexicon, rng = _lexicon(), np.random.default_rng(3)
    network = lm.Network.start(lexicon)
    network.train([rng.integers(0, lexicon.other + 1, rng.integers(1, 90)) for _ in range(60)], lanes=7)
    docs = [rng.integers(0, 30, n) for n in (1, 31, 32, 33, 100, 257, 2)] + [np.full(40, lexicon.other)]
    want = [_plain_log_likelihood(network, d) / math.log(10) for d in docs]
    assert np.allclose(lm.score_group(network, lexicon, docs), want, rtol=1e-4, atol=1e-3)
    assert lm.score_group(network, lexicon, []).tolist() == []


def test_segments_cover_all_tokens(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choices([*words, "rare"], k=n)) for n in (0, 1, 127, 128, 129, 5000)] + [None]
    lexicon = _lexicon()
    shared = spark.sparkContext.broadcast(lexicon)
    rows = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").mapInArrow(lm._segments(shared), "place long, ids binary, n long").collect()
    found = np.concatenate([np.frombuffer(r["ids"], "<i2") for r in rows])
    want = np.concatenate([lexicon.neural_ids(lexicon.ids_of([*lm.words_of(t), lm.END.encode()])) for t in texts])
    assert sorted(found.tolist()) == sorted(want.tolist()) and len(want) == 5385 + 7
    assert max(r["n"] for r in rows) <= lm.SEGMENT and sum(r["n"] for r in rows) == len(want)


def test_trainers_stream_what_comes():
    lexicon, rng = _lexicon(), np.random.default_rng(2)
    segments = [rng.integers(0, 30, 20) for _ in range(40)]
    a, b = lm.Network.start(lexicon), lm.Network.start(lexicon)
    assert a.train(segments) == b.train(iter(segments)) == 800
    assert a.dump() == b.dump() and lm.Network.start(lexicon).train([]) == 0


def test_weights_averaged_in_a_tree_are_the_mean(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 9)), rng.normal(0, 1, 6).astype(np.float32)) for i in range(23) if i % 5]
    frame = spark.createDataFrame([(i, n, bytearray(w.tobytes())) for i, n, w in rows], "trainer long, n long, weights binary")
    want = sum(n * w for _, n, w in rows) / sum(n for _, n, _ in rows)
    for fan in (2, 3, 64):
        assert np.allclose(lm.average_in_tree(frame, 23, fan), want, atol=1e-5)
    assert lm.average_in_tree(frame.filter("n < 0"), 23, 2) is None


def test_learning_beats_the_counts_on_held_out_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    row = lm.score_documents(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert row["s"] > 0.98 * row["b"]  # log-likelihoods, below zero; 0.971 of the base here, 0.948 and 0.934 with ten and a hundred times the text


def test_counts_of_words_beyond_the_dictionary_are_joined(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices([f"w{j}" for j in range(60)], k=rnd.randint(0, 40)))) for i in range(40)] + [(90, None), (91, "unseen é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "DICTIONARY", 9)
    few = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    for d, r in whole.items():
        assert (few[d]["n_tokens"], few[d]["n_known"], few[d]["train_tokens"]) == (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert math.isclose(few[d]["base_score"], r["base_score"], rel_tol=1e-9, abs_tol=1e-9)


ODD = ["", None, " \n\t", "a", " A\x0b\x0cb\r\n a ", "É\x85é\xa0É x\x1cy\u2003z ", "a\x00b \x1f", "\x1c", "a" * 300, "one two " * 700]


def test_words_of_whole_batches_are_those_of_each_text():
    for texts in (ODD, ODD[1:2], ODD[:3], [], ODD[3:]):
        words, sizes = lm.split_words(pa.array(texts, pa.string()))
        want = [lm.words_of(t) for t in texts]
        assert words.cast(pa.binary()).to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
        words, sizes = lm.split_words(pa.array(["x y", *texts], pa.string())[1:])
        assert words.cast(pa.binary()).to_pylist() == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]


def test_counts_do_not_depend_on_what_a_task_holds(monkeypatch):
    rnd = random.Random(9)
    texts = ODD + [" ".join(rnd.choices([f"W{j}" for j in range(200)], k=rnd.randint(0, 60))) for _ in range(300)]
    want = Counter(w.decode() for t in texts for w in lm.words_of(t)) + Counter({lm.END: len(texts)})
    batches = [pa.record_batch({"text": pa.array(texts[a : a + 90], pa.string())}) for a in range(0, len(texts), 90)]
    for counter, group in ((500_000, 2048), (50, 7), (1, 1)):
        monkeypatch.setattr(lm, "COUNTER", counter)
        monkeypatch.setattr(lm, "GROUP", group)
        got = Counter()
        for batch in lm._counts(iter(batches)):
            for r in batch.to_pylist():
                got[r["word"]] += r["n"]
        assert got == want
    assert list(lm._counts(iter([]))) == []


class _Held:
    def __init__(self, value):
        self.value = value


def test_tasks_look_up_distinct_words_and_long_texts_have_wide_windows(monkeypatch):
    lexicon = _lexicon()
    looked, windows = [], []
    ids_of, log_probs = lm.Lexicon.ids_of, lm.Network.log_probs
    monkeypatch.setattr(lm.Lexicon, "ids_of", lambda self, words: looked.append(len(words)) or ids_of(self, words))
    monkeypatch.setattr(lm.Network, "log_probs", lambda self, *a: windows.append(1) or log_probs(self, *a))
    text = "w1 W2 unseen " * 5000
    batch = pa.record_batch({"doc_id": pa.array([4, None]), "text": pa.array([text, "w3"])})
    rows = [r for b in lm._segments(_Held(lexicon))(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows) == 15001 + 2 and sum(looked) == 4
    network = lm.Network.start(lexicon)
    docs = [np.tile([1, 2, lexicon.other], 5000), np.array([3])]
    likely = lm.score_group(network, lexicon, docs)
    assert len(windows) <= 5  # 469 windows of 32 steps before
    assert np.allclose(likely, [_plain_log_likelihood(network, d) / math.log(10) for d in docs], rtol=1e-4)
