"""Guess costs against all segmentations, words learned from the documents, and values in credential contexts."""

from __future__ import annotations

import functools
import math
import random
import re

import pytest

from weftaudit.llm import secrets

WORDS = secrets.Words(["abca", "qaz", "seat", "mountain", "butterflies"])


def _segment_costs(value, a, b):
    """Costs of the segment from a to b as each pattern that it is, by the patterns' statement."""
    part, low, n = value[a:b], value[a:b].lower(), b - a
    yield n * secrets._alphabet(value)
    for start, extra in ((0, 0.0), *([(1, secrets.SEPARATOR)] if part[0] in " -_./" else [])):
        word = low[start:]
        for form, more in ((word, 0.0), (word.translate(secrets._LEET), secrets.LEET)):
            for way, most in ((form, 0.0), (form[::-1], secrets.REVERSED)):
                if way in WORDS.rank and len(way) > 2:
                    yield WORDS.rank[way] + more + most + extra + secrets.CASED * (word != part[start:])
    if n >= 3:
        moves = {ord(y) - ord(x) for x, y in zip(part, part[1:])}
        if moves == {0}:
            yield secrets._alphabet(value) + math.log10(n)
        if moves in ({1}, {-1}):
            yield secrets.SEQUENCE + math.log10(n)
        if all(c in secrets._PLACE for c in low):
            keys = [secrets._PLACE[c] for c in low]
            steps = [(y[0] - x[0], y[1] - x[1]) for x, y in zip(keys, keys[1:])]
            if set(steps) <= secrets._STEPS:
                yield secrets.WALK + math.log10(n) + secrets.TURN * sum(x != y for x, y in zip(steps, steps[1:]))
    if any(value[a - p : b - p] == part for p in range(2, min(n, a, secrets.BLOCK) + 1)):
        yield secrets.COPY + math.log10(n)
    if n > 4 and secrets._DATE.fullmatch(part):
        yield secrets.DATE
    if re.fullmatch(r"(19|20)\d\d", part):
        yield secrets.YEAR


def _by_all_segmentations(value):
    @functools.cache
    def cheapest(a, count):
        """The least sum of ``count`` segments from a on."""
        if count == 0:
            return 0.0 if a == len(value) else math.inf
        return min((min(_segment_costs(value, a, b)) + cheapest(b, count - 1) for b in range(a + 1, len(value) + 1)), default=math.inf)

    return min(cheapest(0, k) + math.log10(math.factorial(k)) for k in range(len(value) + 1))


@pytest.mark.parametrize("alphabet", ["abc", "aqz1-", "seat 5", "1920-Ab", "0123"])
def test_guess_cost_is_the_least_of_all_segmentations(alphabet):
    rnd = random.Random(alphabet)
    values = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 14))) for _ in range(120)]
    for value in [*values, "2019-03-01ab", "01.02.1999", "mountain2019", "Mountain-qaz", "tae5-zaq", "passsss"]:
        want = _by_all_segmentations(value)
        assert math.isclose(secrets.guess_cost(value, WORDS), want, abs_tol=1e-9), value
        assert math.isclose(secrets.guess_cost(value, WORDS, 3.0), min(want, 3.0), abs_tol=1e-9), value


def test_weak_values_of_many_kinds_and_long_ones():
    for weak in ("1qaz2wsx3edc", "butterflies", "mountain2019", "drowssap", "zaq12wsx", "your-token-here", "xyabcabcabc"):
        assert secrets.guess_cost(weak, WORDS) < secrets.LEAST_COST, weak
    text = 'passphrase: "violet engine crisp walnut orbit tunnel maple quiet ember fjord"'
    assert secrets.scan(text)[1] == [(13, "value", len(text) - 1)]
    rnd = random.Random(3)
    long = "".join(rnd.choices("ghijklmn#12", k=500_000))
    assert secrets.scan(f"pwd = '{long}'")[1] == [(7, "value", 500_007)]


def test_words_are_learned_from_documents_but_not_from_values(spark):
    rows = [(i, f"The (mountain) path, \"quiet\" ember{'s' if i % 2 else ''}; pwd: vkwqhtbzmf x1mixed y") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "rare words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.learn_words(docs).learned == ["mountain", "path", "quiet"]
    assert secrets.learn_words(docs, most=1).learned == ["mountain"]
    assert secrets.learn_words(docs.limit(0)).learned == []
    found = {r["doc_id"]: r for r in secrets.scan_documents(docs).collect()}
    assert len(found) == 15 and found[50]["spans"] == "" and found[0]["n_value"] == 1
