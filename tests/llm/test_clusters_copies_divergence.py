"""Centroid clustering, exact dedup and source divergences against plain versions and for odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare

import __spark_entry__ as entry
from weftaudit.llm import centroids, divergence, exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_exact_dedup", "op13_source_divergence"])
def test_queries_match_their_sql(spark, con, sf, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf) == []


# Centroid clustering


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(middle))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in range(len(middle)):
            own = [v for (_, v), f in zip(kept, found) if f == j]
            if own:
                middle[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((-1 if i is None else i), near(v)[1], near(v)[0]) for i, v in kept), middle


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_clusters_match_plain_rounds(spark, rounds):
    rnd = random.Random(rounds)
    rows = [(i, [rnd.choice((-2.0, 0.3, 5.5)) + rnd.gauss(0, 0.4) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]  # copies
    rows += [(5, rows[9][1]), (5, rows[5][1]), (None, rows[7][1]), (301, None), (302, []), (303, rows[0][1][:5]), (304, rows[0][1] + [1.0])]
    rows += [(305 + i, [*rows[0][1][:5], bad]) for i, bad in enumerate((None, math.nan, math.inf, -math.inf))]
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    want, middle = plain_clusters(rows, 4, rounds, 6)
    got = centroids.cluster_vectors(frame.repartition(5), k=4, rounds=rounds, dims=6)
    assert got.centroids.tolist() == middle
    report = got.report().collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in report) == want
    assert {r["inertia"] for r in report} == {sum(w[2] for w in want)}
    assert {r["centroid_sha256"] for r in report} <= {hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle}


def test_dot_products_stay_exact(spark):
    """The stored matrix after some rounds of partial updates is the product with the last centroids."""
    rnd = np.random.default_rng(1)
    v = rnd.integers(-500, 500, (300, 8))
    old = None
    rows = centroids.pa.RecordBatch.from_arrays([centroids.pa.array(range(300)), centroids._lists(v)], names=["vec_id", "v"])
    for _ in range(4):
        new = rnd.integers(-500, 500, (3, 8)) if old is None else np.where(rnd.random((3, 8)) < 0.3, old + 7, old)
        (rows,) = centroids._step(old, new)(iter([rows]))
        old = new
        assert (centroids._matrix(rows["dots"], 3) == v @ new.T).all()
    assert rows["distance"].to_pylist() == [min(((a - c) ** 2).sum() for c in new) for a in v]


def test_clusters_of_few_and_of_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = centroids.cluster_vectors(frame, dims=2)
    assert len(got.centroids) == 2 and {(r["vec_id"], r["cluster"], r["distance"]) for r in got.report().collect()} == {(1, 0, 0), (2, 0, 0)}
    for none in (frame.where("false"), frame.select("vec_id", centroids.F.lit(None).cast("array<float>").alias("embedding"))):
        assert centroids.cluster_vectors(none, dims=2).report().count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dims=1)


# Exact dedup


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        own = groups[(t or "").translate(LOWER)]
        ids = [j for j in own if j is not None]
        out.append((i, max(ids, default=None), len(own), hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()))
    return sorted(out, key=str)


def documents(n=300):
    rnd = random.Random(n)
    rows = [(i, "".join(rnd.choice("aÄb\n ZÉé") for _ in range(rnd.randint(0, 9)))) for i in range(n)]
    rows += [(1000 + i, "One Large group of COPIES" if i % 2 else "one large GROUP of copies") for i in range(200)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, "only without id"), (None, "Only without id"), (8, None), (9, "")]
    return rows


def copies(frame, **how):
    found = exact.find_copies(frame, **how).collect()
    stay = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(stay.values()) == {1} and set(stay) == {r["text_sha256"] for r in found}
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str)


@pytest.mark.parametrize(
    "how",
    [
        {},
        {"capacity": 3},
        {"capacity": 3, "batches": 3},
        {"capacity": 2, "key_bits": 3, "batches": 2},  # eight keys: long chains of different texts
        {"broadcast_keys": 0, "broadcast_groups": 0},
    ],
)
def test_copies_match_plain_groups(spark, how):
    rows = documents()
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, sha string, h int, row int, size int")
    assert copies(frame.repartition(6), **how) == plain_copies(rows)


def test_directory_doubles_and_buckets_stay_small(spark):
    index = exact.ExtendibleIndex(spark, capacity=20)
    keys = spark.range(1000).select(
        exact.F.xxhash64("id").alias("h"), exact.F.lit("s").alias("sha"), exact.F.lit(1).cast("long").alias("size"),
        exact.F.struct("id", exact.F.col("id").alias("row")).cast(exact.KEPT).alias("keep"),
    )
    depths = []
    for part in range(4):
        index.add(keys.where(exact.F.col("keep.doc_id") % 4 == part))
        depths.append(index.depth)
        slots = index.directory.collect()
        assert sorted(r["slot"] for r in slots) == list(range(1 << index.depth))
        for r in slots:  # a slot names the bucket whose bits it begins with
            assert r["bucket"] == "b" + f"{r['slot']:0{index.depth}b}"[: r["own"]]
        sizes = Counter(r["bucket"] for r in index.rows().collect())
        assert sum(sizes.values()) == 250 * (part + 1) and max(sizes.values()) <= 20
    assert depths[0] >= 4 and depths[-1] > depths[0]
    assert {r["own"] for r in index.directory.collect()} != {index.depth}  # some buckets use fewer bits
    assert index.chains().count() == 0 and index.entries().count() == 1000


def test_copies_of_odd_tables(spark):
    assert exact.find_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "Ab é\n" * 2_000_000
    assert copies(spark.createDataFrame([(1, long), (2, long.lower()), (3, long + "x")], "doc_id long, text string")) == plain_copies(
        [(1, long), (2, long.lower()), (3, long + "x")]
    )


def test_dropping_copies_keeps_one_row_each(spark):
    rows = documents()
    frame = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row string, keep int")
    left = exact.drop_copies(frame, capacity=50).collect()
    assert sorted((r["text"] or "").translate(LOWER) for r in left) == sorted({(t or "").translate(LOWER) for _, t in rows})
    assert left[0].__fields__ == ["doc_id", "text", "row", "keep"]


def test_no_python_in_the_plan(spark):
    plan = exact.find_copies(spark.createDataFrame(documents(20), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapIn", plan)


# Source divergences

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_divergences(rows, min_docs, top):
    read = [(lang or "", source or "", WORD.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in read}:
        own = [r for r in read if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = sorted((t for t in df if df[t] >= min_docs), key=str.encode)
        count = {s: Counter(t for r in own if r[1] == s for t in r[2] if df[t] >= min_docs) for s in {r[1] for r in own}}
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in count.items():
            pairs = [(o, sum(abs(p(c, t) - p(d, t)) for t in kept)) for o, d in count.items() if o != s]
            terms = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def corpus():
    rnd = random.Random(3)
    words = ["tree", "Tree", "océan", "ÉTÉ", "été", "x9y", "don't", "日本語", "q\x7fr", "a_b", "_", "\u0085", "Z[z", "naïve"] + [f"w{i}w" for i in range(40)]
    rows = []
    for i in range(160):
        text = " ".join(rnd.choice(words) + rnd.choice(["", "\n", "3"]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "é", "hot", "hot", None]), text))
    rows += [("en", "hot", rows[0][2])] * 30 + [("xx", "alone", "few words"), ("xx", "other", None), (None, None, None), ("yy", "one", "")]
    return rows


@pytest.mark.parametrize("spill, tile, block", [(divergence.SPILL, divergence.TILE, divergence.BLOCK), (25, 2, 7)])
def test_divergences_match_plain_counts(spark, spill, tile, block):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, df int").repartition(4)
    got = divergence.divergences(frame, min_docs=8, top=5, spill=spill, tile=tile, block=block).collect()
    assert sorted(tuple(r) for r in got) == plain_divergences(rows, 8, 5)


def test_stripes_do_not_depend_on_blocks_and_spills():
    rnd = random.Random(5)
    text = "".join(rnd.choice(["a", "Éé", " ", "  ", "9", "z" * 30, "\n"]) for _ in range(400))
    want = Counter(WORD.findall(text.translate(LOWER)))
    for block in (1, 2, 3, 8, 31, 100_000):
        held = divergence.Stripes(1000, block)
        held.add("en", "a", text.encode())
        held.add("en", "b", b"")
        (rows,) = held.spill()
        assert {t: c[0] for t, c in zip(rows["term"].to_pylist(), rows["counts"].to_pylist())} == want
        assert set(rows["df"].to_pylist()) == {1} and list(held.spill()) == []


def test_sorted_partial_stripes_merge_across_batches():
    rnd = random.Random(6)
    partial = [(rnd.choice("de"), f"t{rnd.randint(0, 9)}", rnd.randint(1, 4), rnd.sample("abc", 2), [1, rnd.randint(1, 9)]) for _ in range(80)]
    partial.sort(key=lambda r: r[:2])
    want = {}
    for lang, term, df, sources, counts in partial:
        old = want.setdefault((lang, term), [0, Counter()])
        old[0] += df
        old[1].update(dict(zip(sources, counts)))
    for size in (1, 2, 7, 80):
        batches = [
            divergence.pa.RecordBatch.from_pylist([dict(zip(divergence._STRIPE.names, r)) for r in partial[i : i + size]], divergence._STRIPE)
            for i in range(0, 80, size)
        ]
        rows = [r for b in divergence._merge(9)(iter(batches)) for r in b.to_pylist()]
        got = {(r["lang"], r["term"]): [r["df"], Counter(dict(zip(r["sources"], r["counts"])))] for r in rows}
        assert got == {k: v for k, v in want.items() if v[0] >= 9} and len(rows) == len(got)


def test_likelihoods_beyond_64_bits():
    assert divergence.likelihood(10**15, 3 * 10**15, 7) == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_divergences_of_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergences(spark.createDataFrame([], schema)).count() == 0
    rows = [("en", "a", "too rare"), ("en", "b", None)]
    got = sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(rows, schema)).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    with pytest.raises(ValueError, match="groups"):
        divergence.divergences(spark.createDataFrame(rows, schema), most_groups=1)
