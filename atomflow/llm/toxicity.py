"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

Features of a text are its words (runs of letters, in lower case) and their beginnings of
4 to 7 letters, so that inflected forms of a stem share evidence; a feature's value is log2(1 + occurrences).
The model is P(grade > k) = 1 / (1 + exp(t_k - w x)) for ordered thresholds t_0 < t_1 < ...,
with one weight vector w for all of them. The expected severity is the sum of P(grade > k) over k.

The labels tell toxic from clean only. Grades are made from them: 0 is clean, 1 toxic, and 2 toxic with at least as
many occurrences of telling words as the median toxic document of the sample.

Fitting takes a bounded sample of distinct labelled documents of any length: ordered by a hash of their id and text,
up to ``SAMPLE`` of either class and up to ``SAMPLE_CHARS`` characters on average, but at least one; the driver fits the model on them. Scoring covers every document and
its whole text.

Defined results: a null text is an empty one and gets the score of a text without features. Of
several labels of one document the largest counts, null labels not at all. Without toxic and clean labelled documents there is
no evidence, and every severity is 0; a warning is logged if the labels had both. Very long texts are scored whole. Ties in the order of the sample are
settled by id and text, and rows that repeat both are one; null ids have no label but are scored. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atomflow.llm.text import mix, parts_of, shingle_sets, trim
from atomflow.llm.tokens import Memory

log = logging.getLogger("atomflow")
SAMPLE = 2000
SAMPLE_CHARS = 8000
SHORTEST, LONGEST = 4, 7
#: A feature must occur in so many documents of the sample.
MIN_DOCS = 2
#: Features that count as tried are those in so many documents.
TRIED_DOCS = 4
#: Features kept for the model: those that tell of toxic texts with a log-likelihood ratio (chi-squared with one degree of
#: freedom) of at least twice the logarithm of the number of features tried, plus MARGIN, or what a small sample can give: FLOOR, and one more for each PER_EVIDENCE documents.
#: So many features at most.
MARGIN = 1.0
FLOOR, PER_EVIDENCE = 8.0, 200
#: Strength of the penalty on squared weights, over the documents of the sample: with little evidence, weights shrink.
SHRINK = 0.08
FEATURES = 6000
_LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> set[str]:
    """A word in lower case and its beginnings, which are marked apart from whole words."""
    return {word, *(word[:n] + "-" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))}


def token_features(token: str, known: dict[str, int]) -> tuple[int, ...]:
    """Numbers of the known features in a run without white space."""
    return tuple(known[f] for w in _LETTERS.findall(token) for f in features(w) if f in known)


@dataclass
class Model:
    """Feature numbers, their weights, and the thresholds in ascending order."""

    known: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score (rows) and k (columns)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))

    def score(self, text: str | None, memory: Memory) -> float:
        found = [f for f in map(memory.__getitem__, (text or "").lower().split()) if f]
        if not found:
            return 0.0
        seen = Counter(i for f in found for i in f)
        return float(sum(self.weights[i] * np.log2(1 + n) for i, n in seen.items()))


def fit(texts: Sequence[str], grades: Sequence[int], known: dict[str, int], steps: int = 600, rate: float = 0.1, penalty: float = 2e-5) -> Model:
    """Weights and thresholds of the cumulative-link model by full-batch gradient steps."""
    y = np.asarray(grades)
    top = int(y.max(initial=1))
    memory = Memory(lambda t: token_features(t, known))
    rows, cols, vals = [], [], []
    for r, text in enumerate(texts):
        seen = Counter(i for t in text.lower().split() for i in memory[t])
        rows += [r] * len(seen)
        cols += seen.keys()
        vals += [np.log2(1 + n) for n in seen.values()]
    rows, cols, vals = np.array(rows, int), np.array(cols, int), np.array(vals, float)
    sample = Sample(np.array(rows, int), np.array(cols, int), np.array(vals, float), y, top, len(known), penalty)
    share = np.bincount(y, minlength=top + 1) / len(y)
    first = -np.log(max(1 - share[0], 1e-3) / max(share[0], 1e-3))
    first = -first if share[0] < 0.5 else abs(first)
    params = np.concatenate([np.zeros(len(known)), [first], np.zeros(top - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, grad = sample.objective(params)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(known, params[: len(known)], sample.thresholds(params))


@dataclass
class Sample:
    """Feature values of texts (row, column, value) with their grades, and the objective of the fit.

    params: the weights, the first threshold, and the logarithms of the gaps between thresholds.
    """

    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    y: np.ndarray
    top: int
    features: int
    penalty: float

    def thresholds(self, params: np.ndarray) -> np.ndarray:
        f = self.features
        return params[f] + np.concatenate([[0], np.cumsum(np.exp(params[f + 1 :]))])

    def objective(self, params: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log-likelihood less half the penalty on squared weights, and its gradient."""
        n, f, y, top = len(self.y), self.features, self.y, self.top
        w, t = params[:f], self.thresholds(params)
        score = np.bincount(self.rows, self.vals * w[self.cols], n)
        q = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -40, 40)))  # P(grade > k)
        upper = np.concatenate([np.ones((n, 1)), q], 1)
        lower = np.concatenate([q, np.zeros((n, 1))], 1)
        at = np.arange(n)
        p = np.maximum(upper[at, y] - lower[at, y], 1e-12)
        d = q * (1 - q)
        du = np.concatenate([np.zeros((n, 1)), d], 1)[at, y] / p  # by the score, through the lower threshold
        dl = np.concatenate([d, np.zeros((n, 1))], 1)[at, y] / p
        by_score = (du - dl) / n
        grad = np.zeros_like(params)
        grad[:f] = np.bincount(self.cols, self.vals * by_score[self.rows], f) - self.penalty * w
        by_t = np.zeros(top)
        np.add.at(by_t, y[y > 0] - 1, -du[y > 0] / n)
        np.add.at(by_t, y[y < top], dl[y < top] / n)
        grad[f] = by_t.sum()
        grad[f + 1 :] = np.exp(params[f + 1 :]) * np.cumsum(by_t[::-1])[::-1][1:]
        return float(np.log(p).mean() - self.penalty / 2 * (w @ w)), grad


def _evidence(a: int, b: int, na: int, nb: int) -> float:
    """Twice the log-likelihood ratio of different against equal shares a / na and b / nb."""

    def part(k: int, n: int, p: float) -> float:
        return (k * np.log(k / n / p) if k else 0.0) + ((n - k) * np.log((1 - k / n) / (1 - p)) if n > k else 0.0)

    p = (a + b) / (na + nb)
    return 0.0 if p == 1 else 2 * (part(a, na, p) + part(b, nb, p))


def unlike(texts: Sequence[str], minima: int = 8, shared: int = 3) -> list[int]:
    """Numbers of the texts without those that resemble an earlier one, which would make its rare words look telling.

    Two texts resemble each other if they share so many of the minima of their hashed runs of three words.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    factors = mix(np.arange(1, minima + 1, dtype=np.uint64)) | np.uint64(1)
    for i, members in enumerate(shingle_sets([t.lower().encode() for t in texts], 3)):
        keys = [(k, int((members * f).min())) for k, f in enumerate(factors)] if len(members) else []
        if not keys or sum(k in seen for k in keys) < shared:
            out.append(i)
        seen.update(keys)
    return out


def learn(texts: Sequence[str], toxic: Sequence[int]) -> Model | None:
    """Chooses the features, makes the grades and fits the model; None if a class is missing."""
    own = unlike(texts)
    texts, toxic = [texts[i] for i in own], np.array([toxic[i] for i in own], int)
    n = np.bincount(toxic, minlength=2)
    if not n.all():
        return None
    memory = Memory(lambda t: [features(w) for w in _LETTERS.findall(t)], 20_000)  # entries are large
    counts = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        counts[label].update({f for t in set(text.lower().split()) for fs in memory[t] for f in fs})
    tried = [f for f in counts[0].keys() | counts[1].keys() if counts[0][f] + counts[1][f] >= MIN_DOCS]
    often = sum(counts[0][f] + counts[1][f] >= TRIED_DOCS for f in tried)
    least = min(2 * np.log(max(often, 1)) + MARGIN, FLOOR + len(texts) / PER_EVIDENCE)
    told = {f: e for f in tried if (e := _evidence(counts[1][f], counts[0][f], n[1], n[0])) >= least}
    telling = [f for f in told if counts[1][f] * n[0] > 3 * counts[0][f] * n[1]]
    known = {f: i for i, f in enumerate(sorted(telling, key=lambda f: (-told[f], f))[:FEATURES])}
    marks = Memory(lambda t: sum(not features(w).isdisjoint(known) for w in _LETTERS.findall(t)))
    hits = np.array([sum(marks[t] for t in text.lower().split()) for text in texts])
    middle = np.median(hits[toxic == 1])
    grades = np.where(toxic == 1, 1 + ((hits >= middle) & (hits > 0)), 0)
    if grades.max() > 1 and not (grades == 1).any():
        grades = np.minimum(grades, 1)
    return fit(texts, grades, known, penalty=SHRINK / len(texts))


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of labelled documents."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = own.filter("text is not null").withColumn("hash", F.xxhash64("text"))
    lengths = own.select("doc_id", "hash", F.char_length("text").alias("chars")).join(marks, "doc_id").distinct()
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash")
    first = lengths.withColumn("nr", F.row_number().over(order)).filter(F.col("nr") <= sample)  # Spark limits the groups before it shuffles
    chosen: list[tuple[int, int, int]] = []
    chars: Counter[int] = Counter()
    full: set[int] = set()
    for r in sorted(first.collect(), key=lambda r: (r["toxic"], r["nr"])):
        label = r["toxic"]
        if label in full or (chars[label] and chars[label] + r["chars"] > sample * SAMPLE_CHARS):
            full.add(label)
            continue
        chars[label] += r["chars"]
        chosen.append((r["doc_id"], r["hash"], label))
    wanted = own.sparkSession.createDataFrame(chosen, "doc_id bigint, hash bigint, toxic int")
    rows = own.join(F.broadcast(wanted), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).orderBy("doc_id", "text").collect()
    model = learn([r["text"] for r in rows], [r["toxic"] for r in rows])
    if model is None and marks.select("toxic").distinct().count() == 2:
        log.warning("the labels have toxic and clean documents, but the %d sampled ones don't: every severity will be 0", len(rows))
    trim()
    return model


def _memory(model: Model | None) -> Memory:
    """Known features of the runs without white space that a task has met."""
    return Memory(lambda t: token_features(t, model.known), limit=24 << 20, cost=lambda t, found: 180 + 2 * len(t) + 8 * len(found))


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    trim()
    memory = _memory(model)
    for batch in batches:
        n = batch.num_rows
        if model:
            above = model.above(np.array([model.score(t, memory) for part in parts_of(batch, 1) for t in part.column(1).to_pylist()]))
        else:
            above = np.zeros((n, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype("i4")), pa.array(above[:, 0] >= 0.5)],
            ["doc_id", "expected_severity", "grade", "toxic"],
        )


def _clean(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    """The rows that aren't toxic. They are handed on in parts, since whole batches are held here and, once more, by the JVM."""
    trim()
    memory = _memory(model)
    for batch in batches:
        for part in parts_of(batch, at):
            above = model.above(np.array([model.score(t, memory) for t in part.column(at).to_pylist()]))
            yield part.filter(pa.array(above[:, 0] < 0.5))
    memory.clear()
    memory.old.clear()
    trim()


def severity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, grade (the median one) and toxic (grade above 0 is more likely than not)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scored(it, model), "doc_id bigint, expected_severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose grade is more likely 0 than not; texts are scored where they are read."""
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _clean(it, model, at), docs.schema) if model else docs
