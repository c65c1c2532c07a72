"""The plain word patterns against the tokenizers' own, batches of bounded bytes, and searches of several texts at once."""

from __future__ import annotations

import random

import pyarrow as pa
import regex

from weftaudit.llm import common, decontaminate, pieces

# The word patterns of the two public tokenizers, as their files have them.
OWN = {
    pieces.WORD_END_PATTERN: r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    pieces.BYTE_LEVEL_PATTERN: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
PLAIN = [c for c in map(chr, range(0x250)) if pieces._PLAIN.fullmatch(c)]


def test_patterns_split_plain_texts_alike():
    rnd = random.Random(7)
    texts = [f"a{c}b 1{c}2 {c}" for c in PLAIN] + ["".join(rnd.choices(PLAIN + [" ", "'", "s", "e", "r", "\n"] * 60, k=60)) for _ in range(3000)]
    for ours, own in OWN.items():
        split, want = pieces.re.compile(ours).findall, regex.compile(own).findall
        for text in texts:
            assert split(text) == want(text) and split(text.lower()) == want(text.lower()), text


def test_pieces_survive_generations(monkeypatch):
    from weftaudit.llm.bpe import ChunkEncoder
    from weftaudit.llm.queries import tokenizer_file

    path = tokenizer_file("word_bpe_49k.json")
    texts = [" ".join(f"word{i * j % 37}" for j in range(30)) for i in range(20)]
    want = [ChunkEncoder(path)(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_PIECES", 5)
    encode = ChunkEncoder(path, cache_bytes=0)
    assert [encode(t) for t in texts] == want and len(encode.pieces.known) <= 5


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset(common._BATCH_CONF)
    common.bounded_batches(spark)
    assert int(spark.conf.get(common._BATCH_CONF)) == common.BATCH_BYTES
    rows = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 60 and max(r["n"] for r in sizes) <= 6
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1_000_000] * 10 + ["y"] * 10})
    cut = list(common.small_slices([batch]))
    assert sum(c.num_rows for c in cut) == 20 and max(c.num_rows for c in cut) < 8


def test_several_texts_are_searched_as_each_alone():
    rnd = random.Random(9)
    words = "The train leaves at 9 km from Paris and 12 Berlin . ! one two three four".split()
    some = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, some(rnd.randint(3, 20))) for i in range(30)]
    block = decontaminate.Block.of(items)
    texts = [None, "", "."] + [f"{some(8)} {items[i % 30][1]} {some(5)}" if i % 2 else some(rnd.randint(0, 30)) for i in range(60)]
    found = list(block.search_many(decontaminate.Canon(), texts))
    assert found == [(n, f) for n, t in enumerate(texts) for f in block.search(*decontaminate.Canon()(t))] and found
