"""The training-data operators against plain versions, and their defined results for odd inputs."""

from __future__ import annotations

import json
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from weftaudit.llm import bpe, common, decontaminate, extract, lines, lm, quality, secrets, simhash, tokenfile, winnow  # noqa: E402
from weftaudit.llm.common import RollingHash, code_points  # noqa: E402
from weftaudit.llm.queries import tokenizer_file  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, h1 long, score double, part int, keep string, n_chars long"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, None, 1, 0.5, 3, "k", None if t is None else len(t)) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("tion", "ver", "ñu", "eau", "ing", "Sch") for b in ("el", "an", "or", "é", "ts", "um", "ig")]
    base = [" ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randint(3, 160))) for _ in range(50)]
    shared = ["A passage that many documents hold, word for word.", "short one", "   The Same LINE with blanks around it \t"]
    rows = [(i, t + "\n" + shared[i % 3] + ("\n" + shared[2].upper().strip() if i % 5 == 0 else "")) for i, t in enumerate(base)]
    rows += [(60 + i, base[i % 7]) for i in range(14)]  # exact copies
    rows += [(80 + i, base[40] + f" w{i}") for i in range(12)]  # near copies
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "x" * 5000), (104, "日本語 テキスト é ́ <|endoftext|> 🙂\x1cz"), (105, "tion " * 3000)]
    rnd.shuffle(rows)
    return rows


def result(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_line_dedup_matches_plain_version(spark, texts):
    want = brute.line_dedup(texts)
    for batches, fanout in ((1, 2), (4, 2), (7, 3)):
        got = result(lines.dedup_lines(frame(spark, texts), batches=batches, fanout=fanout, buckets=3))
        assert {d: tuple(r["line_dedup"]) for d, r in got.items()} == want
    assert got[60]["keep"] == "k" and got[60]["h1"] == 1


def test_line_dedup_of_odd_tables(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    line = "one line that is long enough to count"
    rows = [(None, line), (None, line), (5, line), (5, line), (2, None)]
    got = sorted((r["doc_id"] or -1, tuple(r["line_dedup"])) for r in lines.dedup_lines(frame(spark, rows), batches=2).collect())
    assert got == [(-1, (1, 1, "")), (-1, (1, 1, "")), (2, (1, 0, "")), (5, (1, 0, line)), (5, (1, 0, line))]


def test_settled_keys_stay_out_of_later_runs(spark):
    runs = lines.Runs(spark, 3, 10, 2)
    batch = spark.createDataFrame([(1, 1, 9), (1, 1, 8), (1, 1, 7), (2, 2, 9)], "h1 long, h2 long, doc_id long")
    runs.add(batch)
    runs.add(spark.createDataFrame([(1, 1, 5), (2, 2, 4), (3, 3, 3)], "h1 long, h2 long, doc_id long"))
    second = sorted(tuple(r) for r in spark.table(runs.levels[0][1]).collect())
    assert [r[0] for r in second] == [2, 3]
    assert sorted((r["h1"], r["n_docs"], r["keep"]) for r in runs.close().collect()) == [(1, 3, 9), (2, 2, 9), (3, 1, 3)]


def test_simhash_components_match_all_pairs(spark, texts):
    want = brute.components([(d, t) for d, t in texts])
    for bucket in (simhash.BUCKET, 2):  # 2: every bucket is refined, down to the last level
        got = result(simhash.simhash_components(frame(spark, texts), bucket=bucket))
        assert {d: (r["fp"] % (1 << 64), r["component_id"]) for d, r in got.items()} == want
    kept = result(simhash.keep_one(frame(spark, texts)))
    assert set(kept) == {c for _, c in want.values()} and kept[0]["keep"] == "k"


def test_simhash_of_nulls_and_repeats(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, None), (7, "")]
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.simhash_components(frame(spark, rows)).collect())
    assert got == [(-1, 3), (-1, 7), (3, 3), (3, 3), (7, 7)]
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_one(frame(spark, rows)).collect()) == [-1, -1, 3, 7]
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_rows_that_share_an_id_are_kept_by_their_own_component(spark):
    same, own = "a b c d e f g", "quite another text with other words in it"
    rows = [(1, same), (3, same), (3, own), (5, own + " x9"), (5, own + " x9"), (None, same), (7, "zz yy xx ww vv"), (7, "Aa yy xx ww vv uu")]
    docs = spark.createDataFrame([(d, t, "k", 1, t) for d, t in rows], "doc_id long, text string, __doc string, fp long, component_id string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).filter("doc_id is not null").collect()}
    got = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    want = [(-1, same), (1, same), (3, own), (7, "Aa yy xx ww vv uu"), (7, "zz yy xx ww vv")] + ([(5, own + " x9")] if found[5] == 5 else [])
    assert got == sorted(want)


def test_names_that_operators_used_inside(spark):
    docs = spark.createDataFrame([(1, "short", "a", "b", 0.1), (2, "short", "c", "d", 0.2)], "doc_id long, text string, __drops string, __doc string, __score double")
    assert {tuple(r)[:5] for r in lines.dedup_lines(docs).collect()} == {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} == {(1, "short", "a", "b", 0.1)}


def test_without_ids_either_way(spark, monkeypatch):
    docs, ids = frame(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, None)]), spark.createDataFrame([(2,), (2,), (None,), (9,)], "doc_id long")
    for most in (10, 1):
        monkeypatch.setattr(common, "BROADCAST_IDS", most)
        assert sorted((r["doc_id"] or -1) for r in common.without_ids(docs, ids).collect()) == [-1, 1, 4]


def test_covering_masks_miss_no_pair():
    rnd = random.Random(2)
    free = list(range(64))
    for level in range(3):
        masks = simhash.covering_masks(free)
        assert len(masks) == 31
        for _ in range(400):
            differing = sum(1 << b for b in rnd.sample(free, rnd.randint(1, 4)))
            assert any(not differing & m for m in masks)
        free = sorted(b for b in free if not masks[0] >> b & 1)
    assert len(free) <= 8 + 8


def test_spanning_edges_connect_a_chain():
    chain = np.array([(1 << i) - 1 for i in range(0, 64, 3)], dtype=np.uint64)
    a, b = simhash.spanning_edges(chain, 4)
    assert len(a) == len(chain) - 1 and all(int(x ^ y).bit_count() <= 4 for x, y in zip(a, b))


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (900, 899)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[500 + i] == 500 for i in range(60)) and got[900] == got[899] == 899
    assert 7 not in got


def test_winnowing_against_plain_windows():
    rnd = random.Random(3)
    rolling = RollingHash(5)
    winnow_ = winnow.Winnower(5, 7)

    def rolled(gram):
        return int((rolling if len(gram) == 5 else RollingHash(len(gram)))(code_points(gram))[0]) >> 32

    for n in (0, 1, 4, 5, 6, 11, 12, 60, 300):
        text = "".join(rnd.choice("abé🙂 ") for _ in range(n))
        hashes, places = winnow_(text)
        assert list(zip(hashes.tolist(), places.tolist())) == brute.winnow(text, rolled, 5, 7)
    common = "".join(rnd.choice("abcdefgh") for _ in range(11))  # k + window - 1
    for _ in range(30):
        a, b = ("".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        assert set(winnow_(a + common)[0]) & set(winnow_(common + b)[0])


def test_rolling_hashes_do_not_depend_on_blocks(monkeypatch):
    points = code_points("".join(random.Random(9).choice("abcé🙂") for _ in range(500)))
    whole = RollingHash(7)(points)
    monkeypatch.setattr(RollingHash, "BLOCK", 40)
    assert len(whole) == 494 and (RollingHash(7)(points) == whole).all()


def test_comparison_with_the_next_document(spark, texts):
    texts = [*texts, (None, "no id")]
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = dict(zip([d for d, _ in order], [order[(i + 1) % len(order)][1] or "" for i in range(len(order))]))
    plain = winnow.Winnower()
    for parts in (1, 6):
        got = result(winnow.compare_with_next(frame(spark, texts), parts=parts))
        assert set(got) == {d for d, _ in texts}
        for doc_id, text in texts:
            text, row = text or "", got[doc_id]
            changed = winnow.edited(text, following[doc_id])
            assert row["edited_sha256"] == brute.sha(changed) and row["n_chars"] == len(text)
            assert row["fingerprint"] == winnow.written(*plain(text))
            assert row["near_next"] == winnow.likeness(plain(text)[0], plain(following[doc_id])[0])
    assert winnow.compare_with_next(frame(spark, [])).count() == 0
    assert winnow.compare_with_next(frame(spark, [(1, "alone here")])).first()["near_next"] == 1.0


@pytest.mark.parametrize("chunk_bits", [2, 4, 11])
def test_bpe_equals_the_library(texts, chunk_bits):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), bpe.ChunkEncoder(path, chunk_bits=chunk_bits)
    rnd = random.Random(chunk_bits)
    odd = ["".join(rnd.choice(["a", "The", " ", "\n", "\x0b", "\x1c", "\xa0", "'s", "é", "́", "Σ", "12", "<|endoftext|>", "日"]) for _ in range(90)) for _ in range(60)]
    for text in [*(t for _, t in texts), *odd]:
        ids = brute.library_ids(tokenizer, text)
        assert encode(text) == (len(ids), " ".join(map(str, ids)).encode(), tokenizer.decode(ids, skip_special_tokens=False).encode())
    before = encode.encoded
    for _, text in texts:
        encode(text)
    assert encode.encoded == before and encode.reused


def test_bpe_rows(spark, texts):
    got = result(bpe.encode_documents(frame(spark, texts), tokenizer_file("word_bpe_49k.json"), with_ids=True))
    assert got[100]["n_tokens"] == 0 and got[100]["ids_sha256"] == brute.sha("") and len(got[105]["ids"]) == got[105]["n_tokens"]
    assert bpe.encode_documents(frame(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_token_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    files, keys = tokenfile.write_tokens(frame(spark, texts), path, shards=5, bucket_keys=16)
    got = result(files.read(keys, with_ids=True))
    assert {d: (r["start"], r["n_tokens"], r["ids_crc32"]) for d, r in got.items()} == brute.token_rows(tokenizer, texts)
    assert got[104]["ids"] == [*brute.library_ids(tokenizer, dict(texts)[104]), 2]
    absent = spark.createDataFrame([(d, 0) for d in range(5000, 5200)], "doc_id long, ordinal long")
    assert files.lookup(absent).count() == 0


def test_token_files_of_nulls_and_repeats(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    files, keys = tokenfile.write_tokens(frame(spark, [(None, None), (4, "b c"), (4, "a"), (None, "z"), (1, "")]), path, shards=2)
    rows = sorted((r["start"], r["doc_id"], r["ordinal"]) for r in files.read(keys).collect())
    assert [(d, o) for _, d, o in rows] == [(None, 0), (None, 1), (1, 0), (4, 0), (4, 1)]
    files, keys = tokenfile.write_tokens(frame(spark, []), path)
    assert files.read(keys).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = tokenfile.key_hashes(np.arange(n, dtype=np.int64) * 3 - 7, np.zeros(n, dtype=np.int64))
    found = tokenfile.PerfectHash.load(tokenfile.PerfectHash.build(keys).dump())(keys)
    assert sorted(found.tolist()) == list(range(n))


def test_language_model(spark, texts):
    rows = [*texts, *[(200 + i, t) for i, (_, t) in enumerate(texts[:40])]]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want, got = brute.unigram(rows, held), result(lm.score_documents(frame(spark, rows)))
    for d, (n, known, total, base) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(d))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert lm.score_documents(frame(spark, [])).count() == 0
    assert len(lm.score_documents(frame(spark, [(None, None), (None, None)])).collect()) == 2


def test_untrained_network_is_the_unigram_model_and_windows_do_not_matter():
    counts = np.array([50.0, 20, 9, 4, 3, 1])
    lexicon = lm.Lexicon([b"\n", b"a", b"b", b"c", b"d", b"e"], counts, 90, 9)
    network = lm.Network.start(lexicon)
    network.words[:, :-1] = 0
    docs = [np.array([1, 2, 6, 0] * 30), np.array([0]), np.array([5, 0])]
    share = np.append(counts + 1, lexicon.others) / 100
    assert np.allclose(lm.score_group(network, lexicon, docs), [np.log10(share[d]).sum() for d in docs], atol=1e-3)
    alone = [lm.score_group(network, lexicon, [d])[0] for d in docs]
    assert np.allclose(lm.score_group(network, lexicon, docs), alone, atol=1e-3)


def test_network_gradients_match_differences():
    rng = np.random.default_rng(1)
    lexicon = lm.Lexicon([b"w%d" % i for i in range(43)], np.arange(43, 0, -1.0), 1000, 48)
    assert lexicon.other == 44  # 22 classes of two words
    network = lm.Network(*(p.astype(np.float64) for p in lm.Network.start(lexicon).parts()))
    network.words[:, :-1] += rng.normal(0, 0.3, network.words[:, :-1].shape)
    ids, state = np.append(rng.integers(0, 43, 14), 44).reshape(5, 3), rng.normal(0, 0.5, (3, lm.HIDDEN))
    alive = np.ones(ids.shape, dtype=bool)
    _, grads, _ = network.step(ids, alive, state)
    for part, grad in zip(network.parts(), grads):
        for at in [tuple(rng.integers(0, s) for s in part.shape) for _ in range(12)]:
            held, losses = part[at], []
            for move in (1e-2, -1e-2):
                part[at] = held + move
                losses.append(-network.step(ids, alive, state)[2])
            part[at] = held
            assert math.isclose((losses[0] - losses[1]) / 2e-2, grad[at], rel_tol=0.08, abs_tol=2e-3)


def test_base_spans_as_stated():
    rnd = random.Random(8)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abcd1234", "x", "AKIA", "QWERTYUIOP12", "0123456789abcdef" * 2, "f", "é", "\n", "ſecret"]
    for _ in range(800):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert secrets.written(secrets.base_spans(text)) == brute.base_spans(text)


def test_guess_costs_and_added_spans():
    assert secrets.guess_cost("") == 0
    assert secrets.guess_cost("password123") < secrets.guess_cost("xk7#Qpz!2mVw")
    for weak in ("qwertyuiop", "aaaaaaaaaaaa", "20240131", "changeme", "P@ssw0rd", "abcdefghij"):
        assert secrets.guess_cost(weak) < 6, weak
    assert secrets.scan("pwd: hunter2")[1] == []
    text = "é passphrase = \"gR8#vT!qZ2&w\" and token: 'your-token-here' pwd=changeme12 auth_key: Zx9!kLm2@pQ7"
    base, every = secrets.scan(text)
    added = [text[a:b] for a, kind, b in every if kind == "value"]
    assert added == ["gR8#vT!qZ2&w", "Zx9!kLm2@pQ7"] and set(base) <= set(every)
    assert len(secrets.scan("password = " + "ab!" * 40000)[1]) < 2  # one long repeat


def test_secret_rows(spark, texts):
    rows = result(secrets.scan_documents(frame(spark, [*texts, (300, "token = abcdefgh12")])))
    assert rows[300]["spans"] == "assign:0:18" and rows[100]["base_sha256"] == brute.sha("") and len(rows) == len(texts) + 1
    assert secrets.scan_documents(frame(spark, [])).count() == 0


PAGE = (
    "<html><head><title>no</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Menu words here</a></ul></nav>"
    '<div class="cookie-notice">We use cookies on this site to make it better for everyone</div>'
    "<article><h1>A  title</h1><p>First <b>bold</b>\n words &amp; more &lt;b&gt;<p>Second part<form><label>Your name</label></form>"
    '<div class="ad">Buy this now, it is cheap today</div><ul><li>one item<li>two items</ul><p>Last<br>line &eacute;</article>'
    '<section id="comments"><p>What a great text, thank you so much for all of this work</p></section><footer>&copy; somebody</footer></body></html>'
)


def test_main_text():
    want = "A title\nFirst bold words & more <b>\nSecond part\none item\ntwo items\nLast line é"
    assert extract.main_text(PAGE, {}) == want
    assert extract.main_text(PAGE.replace("article>", "div>"), {}) == want
    assert extract.main_text(None, {}) == extract.main_text("", {}) == extract.main_text("<nav>only a menu</nav>", {}) == ""
    assert extract.main_text("a < b <!-- no --> c", {}) == "a < b c"
    framed = '<div class="page has-sidebar"><div class="post"><header class="entry-header"><h1>Head</h1></header>text</div></div>'
    assert extract.main_text(framed.replace("post", "x").replace('<div class="x">', "<article>").replace("text</div>", "text</article>"), {}) == "Head\ntext"
    assert extract.main_text("<article>Hi</article><div class=q>a long text that has many more words than the article has</div>", {}) == "Hi"
    assert extract.main_text('<p>seen<p style="display:none">not seen at all by any reader</p><p hidden>nor this one</p>', {}) == "seen"
    assert extract.main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", {}).startswith("deep")


def test_best_run_is_the_maximum():
    rnd = random.Random(5)
    for _ in range(200):
        scores = [rnd.randint(-4, 4) for _ in range(rnd.randint(0, 12))]
        a, b = extract.best_run(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *sums])


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", PAGE, 0), (3, "w", PAGE.replace("h1", "h2"), 0)], "page_id long, url string, html string, text int")
    rows = result(extract.extract(pages), "page_id")
    assert rows[1]["text"].startswith("A title\n") and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[2]["n_chars"] == 0 and rows[None]["url"] == "v"
    assert extract.extract(pages.limit(0)).count() == 0


QUESTION = "Maria has 12 apples and gives 5 kg of them to Peter before she walks 12 miles to the old market near the river"


def test_decontamination(spark):
    rnd = random.Random(6)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    changed = QUESTION.replace("Maria", "Ana").replace("12", "30").replace("Peter", "Tom").replace("kg", "lb")
    uneven = "Maria has 12 apples and gives 5 kg of them to Peter 7 miles 30 days ".replace("12", "9")
    bench = spark.createDataFrame([(1, QUESTION), (2, noise(9)), (3, None), (4, "two words"), (None, "null item id with some words")], "item_id long, text string")
    rows = [(1, f"{noise(40)} {QUESTION} {noise(9)}"), (2, f"{noise(4)} {changed} {noise(30)}"), (3, QUESTION.upper()), (4, noise(200)), (5, None), (6, ""), (7, uneven), (None, QUESTION), (8, "* ".join(QUESTION.split()))]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (8, 1), (None, 1)}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench, block_chars=60).collect()}
    assert blocks == found
    left = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == [-1, 4, 5, 6, 7]
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_slots_must_be_consistent():
    item = decontaminate.Block.of([(1, "add 7 to red box then take 7 from red box and put 7 on blue box")])
    canon = decontaminate.Canon()
    assert item.search(*canon("add 9 to red box then take 9 from red box and put 9 on blue box"))
    assert not item.search(*canon("add 9 to red box then take 8 from red box and put 6 on blue box"))


def test_factorisation_machine_identity_and_learning():
    rng = np.random.default_rng(0)
    machine = quality.FactorisationMachine(0.1, rng.normal(size=quality.N_FEATURES), rng.normal(size=(quality.N_FEATURES, quality.FACTORS)))
    at, x = np.array([3, 17, 900, quality.WORD_BINS + 2]), rng.normal(size=4)
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert math.isclose(machine.raw(at, x), 0.1 + machine.linear[at] @ x + pairs)


def test_quality_on_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables hold out a handful of labels only
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, quality.train(docs, labels)).join(labels, "doc_id").filter(quality.doc_crc() % 5 == 0).collect()
    assert sum((r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in rows) >= 0.9 * len(rows)


def test_quality_of_odd_tables(spark, texts):
    docs = frame(spark, [*texts, (None, "abc")])
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    machine = quality.train(docs, none)
    assert {r["score"] for r in quality.score_documents(docs, machine).collect()} == {0.5}
    labels = spark.createDataFrame([(d, d % 2, "clash") for d, _ in texts] + [(None, 1, ""), (1, None, "")], "doc_id long, quality int, text string")
    scores = [r["score"] for r in quality.score_documents(docs, quality.train(docs, labels)).collect()]
    assert len(scores) == len(texts) + 1 and all(0 <= s <= 1 for s in scores)
    assert quality.score_documents(frame(spark, []), machine).count() == 0
    assert quality.with_scores(docs, machine).columns[: len(docs.columns)] == docs.columns


def test_labels_and_names_are_no_inputs(spark, texts):
    machine = quality.FactorisationMachine.start()
    docs = frame(spark, texts)
    other = docs.selectExpr("doc_id + 1000 doc_id", "text", "'xx' lang", "'s' source", "n_chars")
    a = sorted(r["score"] for r in quality.score_documents(docs, machine).collect())
    assert a == sorted(r["score"] for r in quality.score_documents(other, machine).collect())


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and after
        if name == "line dedup":
            want = brute.line_dedup(before.items())
            assert after == {d: t for d, (_, _, t) in want.items()}
        elif name == "SimHash near-dedup":
            assert set(after) == {c for _, c in brute.components(before.items()).values()}
        elif name == "benchmark decontamination":
            bench = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(before) - set(after) >= {d for d, t in before.items() if any(b in " ".join((t or "").split()) for b in bench)}
    last = result(corpus_pipeline.STAGES[-1][1](spark, docs, sf))
    assert set(last) == set(after) == set(result(entry.queries()["pipeline"](spark, sf)))


def test_line_dedup_query_matches_its_sql(spark, con, sf):
    from compare import compare

    name = "op1_line_dedup"
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf) == []


def test_query_columns(spark, sf):
    want = json.loads(
        '{"op2_decontamination": ["doc_id", "item_id"], "op3_quality": ["doc_id", "held_out", "score", "predicted"],'
        ' "op5_winnowing": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],'
        ' "op6_simhash": ["doc_id", "fingerprint", "component_id"], "op7_main_text": ["page_id", "url", "text", "n_chars"],'
        ' "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op10_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"]}'
    )
    for name, columns in want.items():
        assert set(columns) <= set(entry.queries()[name](spark, sf).columns), name
