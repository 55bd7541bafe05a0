import math
import os
import random
import re

import numpy as np
import pytest

from atomflow.llm.tokens import Memory
from atomflow.llm.toxicity import Sample, fit, learn, learn_from, severity, token_features


def made(n, seed):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["qvile", "Qvilest", "xworst,"]) + rng.choice(["", "er", "ing"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy():
    model = learn(*made(800, 1))
    texts, toxic = made(600, 2)
    memory = Memory(lambda t: token_features(t, model.known))
    p = model.above(np.array([model.score(t, memory) for t in texts]))
    assert ((p[:, 0] >= 0.5) == np.array(toxic)).mean() > 0.98
    assert (np.diff(model.thresholds) > 0).all() and (p[:, 0] >= p[:, 1]).all()


def test_gradient_reaches_the_order_of_grades():
    texts = ["bad"] * 20 + ["bad bad bad bad bad bad bad"] * 20 + ["fine"] * 40
    model = fit(texts, [1] * 20 + [2] * 20 + [0] * 40, {"bad": 0})
    memory = Memory(lambda t: token_features(t, model.known))
    clean, mild, hard = (model.above(np.array([model.score(t, memory)])).sum() for t in ("fine", "bad", "bad " * 7))
    assert clean < 0.3 < mild < 1.4 < hard


def test_query_forms(spark):
    texts, toxic = made(300, 3)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(900, None, "c"), (901, "", "c"), (None, "qvile qvilest", "c"), (902, "ok " * 40_000 + "qvile", "c")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(0, None, 1), (None, 1, 1), (5, 0, 1)], "doc_id bigint, toxic int, quality int")
    rows = {r.doc_id: r for r in severity(docs, learn_from(docs, labels)).collect()}
    assert len(rows) == 304
    assert not rows[900].toxic and not rows[901].toxic and rows[None].toxic
    assert sum(rows[i].toxic == bool(t) for i, t in enumerate(toxic)) > 290
    none = learn_from(docs, labels.filter("toxic = 0"))
    assert none is None and {r.expected_severity for r in severity(docs, none).collect()} == {0.0}
    assert severity(docs.limit(0), none).count() == 0


@pytest.mark.parametrize(("sf", "share"), [("sf0.001", 0.9), ("sf0.01", 0.85)])
def test_recall_on_small_tables(spark, sf, share):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't there")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    marks = {r.doc_id: r.toxic for r in labels.dropna().collect()}
    found = [(marks[r.doc_id], r.toxic) for r in severity(docs, learn_from(docs, labels)).collect() if r.doc_id in marks]
    toxic, clean = [f for t, f in found if t], [f for t, f in found if not t]
    assert sum(toxic) >= share * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_long_and_repeated_documents_are_sampled(spark, caplog):
    texts, toxic = made(200, 4)
    schema = "doc_id bigint, text string"
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    long = spark.createDataFrame([(i, t + f" {'ok ' * 3000}") for i, t in enumerate(texts)], schema)
    rows = {r.doc_id: r.toxic for r in severity(long, learn_from(long, labels)).collect()}
    assert sum(rows[i] == bool(t) for i, t in enumerate(toxic)) > 180
    # Copies of one id don't crowd out the others.
    crowded = spark.createDataFrame([(0, texts[0])] * 2000 + list(enumerate(texts)), schema)
    assert learn_from(crowded, labels, sample=200) is not None
    assert not caplog.records
    assert learn_from(long.filter("doc_id < 0"), labels) is None and "every severity will be 0" in caplog.text


def test_gradient_equals_numeric_differences():
    rng = np.random.default_rng(4)
    for top in (1, 2, 4):
        n, f, nnz = 40, 6, 150
        sample = Sample(rng.integers(0, n, nnz), rng.integers(0, f, nnz), rng.uniform(0.5, 3, nnz), rng.integers(0, top + 1, n), top, f, 0.3)
        params = rng.normal(0, 0.5, f + top)
        _, grad = sample.objective(params)
        for i in range(len(params)):
            step = np.zeros_like(params)
            step[i] = 1e-5
            numeric = (sample.objective(params + step)[0] - sample.objective(params - step)[0]) / 2e-5
            assert abs(numeric - grad[i]) < 1e-7, (top, i)


def plain_objective(texts, grades, known, weights, thresholds, penalty):
    """The cumulative-link model written out for one text after the other."""
    total = 0.0
    for text, grade in zip(texts, grades, strict=True):
        score = plain_score(text, known, weights)
        above = [1.0, *(1 / (1 + math.exp(t - score)) for t in thresholds), 0.0]
        total += math.log(above[grade] - above[grade + 1])
    return total / len(texts) - penalty / 2 * sum(w * w for w in weights)


def plain_score(text, known, weights):
    seen = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for feature in {word} | {word[:n] + "-" for n in range(4, min(7, len(word)) + 1)}:
            if feature in known:
                seen[feature] = seen.get(feature, 0) + 1
    return sum(weights[known[f]] * math.log2(1 + n) for f, n in seen.items())


def test_fit_and_scores_against_a_plain_model(spark):
    texts, toxic = made(160, 7)
    known = {"qvile": 0, "qvil-": 1, "xwor-": 2, "abc": 3}
    grades = [t * (1 + (i % 3 == 0)) for i, t in enumerate(toxic)]
    model = fit(texts, grades, known, steps=3000, penalty=0.05)
    best = plain_objective(texts, grades, known, model.weights, model.thresholds, 0.05)
    rng = np.random.default_rng(2)
    for _ in range(200):  # no other parameters nearby are better
        w, t = model.weights + rng.normal(0, 0.05, 4), model.thresholds + np.sort(rng.normal(0, 0.05, 2))
        assert t[0] >= t[1] or plain_objective(texts, grades, known, w, t, 0.05) <= best + 1e-9
    odd = [*texts, None, "", "Qvile, qvile_QVILE 1qvile2", "xworsting " * 50_000, "ÄQVILE qvileä"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for r in severity(docs, model).collect():
        score = plain_score(odd[r.doc_id], known, model.weights)
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(r.expected_severity - sum(above)) < 1e-9
        assert r.grade == sum(p >= 0.5 for p in above) and r.toxic == (above[0] >= 0.5)


def test_features_are_chosen_as_by_plain_counts():
    texts, toxic = made(400, 5)
    model = learn(texts, toxic)
    sets = [{f for w in re.findall(r"[a-z]+", t.lower()) for f in {w} | {w[:n] + "-" for n in range(4, min(7, len(w)) + 1)}} for t in texts]
    n = [toxic.count(0), toxic.count(1)]
    every = set().union(*sets)
    counts = {f: [sum(f in s for s, t in zip(sets, toxic, strict=True) if t == k) for k in (0, 1)] for f in every}
    tried = {f for f in every if sum(counts[f]) >= 2}
    least = min(2 * math.log(sum(sum(counts[f]) >= 4 for f in tried)) + 1, 8 + len(texts) / 200)

    def evidence(f):
        (a, b), out = (counts[f][1], counts[f][0]), 0.0
        p = (a + b) / sum(n)
        for k, m in ((a, n[1]), (b, n[0])):
            out += (k * math.log(k / m / p) if k else 0) + ((m - k) * math.log((1 - k / m) / (1 - p)) if m > k else 0)
        return 2 * out

    want = {f for f in tried if evidence(f) >= least and counts[f][1] * n[0] > 3 * counts[f][0] * n[1]}
    assert set(model.known) == want and {"qvil-", "xwor-"} <= want


def test_clean_rows_are_handed_on_in_small_parts(monkeypatch):
    import pyarrow as pa

    from atomflow.llm import text, toxicity

    monkeypatch.setattr(text, "PART", 10_000)
    model = toxicity.Model({"bad": 0}, np.array([9.0]), np.array([1.0]))
    texts = [None if i % 7 == 0 else ("bad " if i % 3 == 0 else "good ") * 200 for i in range(500)] + ["good " * 9000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(toxicity._clean(iter([batch, batch.slice(0, 0)]), model, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [i for i, t in enumerate(texts) if not (t or "").startswith("bad")]
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts[:-3]) < 12_000 and len(parts) >= 40
