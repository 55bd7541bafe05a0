import random

import numpy as np
import pytest

from atomflow.llm import graph, scratch, setsketch, vectors
from atomflow.llm.graph import components
from atomflow.llm.setsketch import band_length, estimate, merged, near_duplicates, registers_of, without_near_copies
from atomflow.llm.text import shingle_sets
from atomflow.llm.vectors import near_vectors, recall


def joined(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_documents(texts, k, num, den):
    sets = shingle_sets([t.lower().encode() if t else None for t in texts], k)
    sets = [set(s.tolist()) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and den * (n := len(sets[i] & sets[j])) >= num * (len(sets[i]) + len(sets[j]) - n)]
    return [(len(s), c) for s, c in zip(sets, joined(len(sets), pairs), strict=True)]


def corpus(rng, groups, size, words=60):
    texts = []
    for _ in range(groups):
        base = ["w%d" % rng.randint(0, 5000) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "z%d" % rng.randint(0, 10**6)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_documents_against_brute_force(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(setsketch, "BLOCK", 32)
    monkeypatch.setattr(scratch, "HOT", 8)
    monkeypatch.setattr(graph, "HOT", 8)
    rng = random.Random(7)
    texts = [None, "", " \n", "a", "A", "a b", "one two three", "One TWO  three"] + corpus(rng, 40, 6) + corpus(rng, 1, 120, 90) + ["hot copy of a text " * 4] * 80 + ["long " * 20_000]
    rows = [(i, t, "clash", 1, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sig string, n int, rep bigint")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k, num, den).collect()}
    want = brute_documents(texts, k, num, den)
    assert got == {i: (n, c, i == c) for i, (n, c) in enumerate(want)}


def test_documents_without_rows_or_ids(spark):
    schema = "doc_id bigint, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "q w e r t y"), (4, "q w e r t y")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (4, 4, True), (4, 4, True)]


def test_repeated_and_null_ids(spark):
    rng = random.Random(5)
    far, base, lone = (["%s%d" % (w, rng.randint(0, 10**6)) for _ in range(60)] for w in "fbl")
    close = lambda words, i: " ".join([*words[:-1], "z%d" % i])
    rows = [(3, " ".join(base)), (7, close(base, 1)), (7, " ".join(far)), (7, close(far, 2)), (None, close(base, 3))]
    rows += [(None, close(lone, i)) for i in range(4)] * 3 + [(8, "one two three four five six")] * 20 + [(None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, lang string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "n_shingles", "component_id", "kept"}
    count = lambda i, c, kept: sum((r.doc_id, r.component_id, r.kept) == (i, c, kept) and r.n_shingles > 0 for r in got)
    assert [count(3, 3, True), count(7, 3, False), count(None, 3, False), count(7, 7, True), count(7, 7, False)] == [1, 1, 1, 1, 1]
    assert [count(None, None, True), count(None, None, False), count(8, 8, True)] == [1, 11, 20]
    kept = without_near_copies(docs.distinct())
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and (3, rows[0][1]) in left and sum(i == 7 for i, _ in left) == 1
    assert rows[1] not in left and sum(i is None and bool(t) for i, t in left) == 1 and len(left) == 6


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2000]), np.sort(x[500:3000])
    ra, rb, both = registers_of([a, b, np.unique(np.concatenate([a, b]))])
    assert (merged(ra, rb) == both).all()
    found = estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(found - 1500 / 3000) < 0.15
    same = estimate(np.array([0]), np.array([0]), np.array([10.0]), np.array([10.0]))[0]
    assert same > 0.99


def test_bands_are_long_enough_and_miss_little():
    for t in (0.8, 0.85):
        r = band_length(t)
        assert r >= 5 and (1 - t**r) ** (setsketch.REGISTERS // r) <= 1e-5


@pytest.mark.parametrize("hot", [4, 10**6])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(scratch, "HOT", hot)
    monkeypatch.setattr(graph, "HOT", hot)
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 6), (6, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 160)} | {5: 5, 6: 5}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_vectors(rows, threshold):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    links, pairs = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    pairs.append((i, j))
    return links, joined(len(rows), pairs)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SMALL", 4)
    rng = np.random.default_rng(3)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 8, 1), (3, [1.0, None] + [0.0] * 6, 1), (4, [float("nan")] + [1.0] * 7, 1), (5, [1.0] * 8, None), (6, [1.0] * 8, 1), (7, [2.0] * 8, 1), (8, [1.0] * 4, 1)]
    for _ in range(12):
        base = rng.standard_normal(8)
        for _ in range(int(rng.integers(1, 12))):
            v = base + rng.normal(0, 0.12, 8)
            rows.append((len(rows), v.astype("f4").tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + i, rows[20][1], rows[20][2]) for i in range(60)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, vec string, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    links, labels = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 0.93)
    assert got == {i: (n, c, i == c) for i, (n, c) in enumerate(zip(links, labels, strict=True))}


def test_vectors_empty_and_recall(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
    assert recall() > 0.99 and all(recall(projections=k, tables=vectors.tables_for(k)) > 0.99 for k in (12, 20, 30))
    assert vectors.projections_for(10**9) > vectors.projections_for(10**6) > vectors.projections_for(10) >= 4


def test_recall_on_planted_pairs_of_dimension_64(spark):
    """Pairs of cosine 0.93 to 0.95 among unrelated vectors: measured recall against brute force."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((1500, 64))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.95, (1500, 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * off]).astype("f4")
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    want = ((d @ d.T) >= 0.93).sum(1) - 1
    assert want.sum() >= 2990 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_extreme_null_and_repeated_vectors(spark):
    """Very small and very large components link like all others; ids may be null or repeat; the type may be double."""
    big = [1e200, 2e200, -1e200]
    rows = [(1, big, 1), (2, [x * 1e-300 for x in big], 1), (3, [x / 1e200 * 1e-300 for x in big], 1), (4, [x / 1e200 * 5e-320 for x in big], 1), (None, big, 1), (None, None, 1), (5, big, 2)]
    rows += [(7, [0.0, 1.0, 0.0], 3), (7, [0.0, 1.0, 0.01], 3), (8, [-0.0, 2.0, 0.0], 3), (9, [0.0] * 2, 3), (9, [1.0] * 40_000, 3), (10, [2.0] * 40_000, 3)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), key=repr)
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (None, 0, None, True), (None, 0, None, True), (5, 0, 5, True)]
    want += [(7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 0, 9, True), (9, 1, 9, True), (10, 1, 9, False)]
    assert got == sorted(want, key=repr)


def test_large_buckets_in_blocks(spark, monkeypatch):
    """A cluster of hundreds of unequal near copies, of which many share large buckets, among small groups."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    center = rng.standard_normal(16)
    rows = [(i, (center + rng.normal(0, 0.09, 16)).astype("f4").tolist(), 1) for i in range(400)]
    for _ in range(60):
        base = rng.standard_normal(16)
        rows += [(len(rows) + k, (base + rng.normal(0, 0.09, 16)).astype("f4").tolist(), k % 2) for k in range(6)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    links, labels = brute_vectors([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 0.93)
    found = sum(n for n, _ in got.values())
    assert found >= 0.995 * sum(links) and all(got[i][0] <= links[i] for i in got)
    assert sum(got[i][1] == c for i, c in enumerate(labels)) >= 0.99 * len(rows)


@pytest.mark.parametrize("hot", [4, 10**6])
def test_components_in_the_cluster(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "LOCAL", 0)
    test_components(spark, monkeypatch, hot)


def test_components_of_a_small_graph_take_few_jobs(spark, tmp_path):
    spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint").write.parquet(f"{tmp_path}/edges")
    edges = spark.read.parquet(f"{tmp_path}/edges")
    spark.sparkContext.setJobGroup("small-graph", "components")
    try:
        labels = components(edges)
    finally:
        spark.sparkContext.setJobGroup("others", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small-graph")) <= 5
    assert {r.component for r in labels.collect()} == {0}


def test_likely_pairs_are_those_with_a_high_estimate():
    rng = np.random.default_rng(3)
    na, nb = rng.integers(1, 3000, 4000).astype(float), rng.integers(1, 3000, 4000).astype(float)
    nb[:3000] = np.maximum(1, (na[:3000] * rng.uniform(0.7, 1.4, 3000)).round())
    greater = rng.binomial(setsketch.REGISTERS, rng.uniform(0, 0.3, 4000))
    less = rng.binomial(setsketch.REGISTERS - greater, rng.uniform(0, 0.3, 4000))
    for least in (0.5, 0.72, 0.85):
        high = estimate(greater, less, na, nb)
        got = setsketch.likely(greater, less, na, nb, least)
        clear = np.abs(high - least) > 1e-6
        assert (got == (high >= least))[clear].all() and 100 < got.sum() < 3900
