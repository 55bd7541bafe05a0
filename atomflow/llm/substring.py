"""Repeated passages across documents, found through difference-cover anchors.

A word goes when it is covered by a window of ``window`` consecutive words whose word sequence
also starts in a document with a smaller id. Windows are judged on the input, not on what is left.

A difference cover D modulo v holds, for any two positions, an offset below v that takes both of them to
cover positions (positions in D modulo v). So if two windows of n words are equal, they hold equal
runs of n - v + 1 words that start at cover positions of either document: the anchors. Only anchors are
hashed and exchanged at first, |D| / v of all positions; windows are hashed and exchanged where an
anchor of theirs occurs in another document, which extends the match to the full window.

How it runs: documents are dealt by a hash of their id and text into batches of some megabytes of
text. A batch sends each distinct anchor hash once, packed with others into one binary row for each of
a number of hash ranges, so that the shuffle carries a few bytes per anchor and a passage that a third of all
documents share costs one entry per batch. Each range tells the batches which of their anchors occur in another batch; the
batches then do the same with the windows, and each range tells them which windows start in a smaller
document elsewhere. All three visits to a batch read the same shuffled texts.

Windows count as equal when two 64-bit hashes of theirs are, 128 bits in all: among 10**13 windows, two different ones meet with a chance
below 10**-11, unless they differ only in words whose own 64-bit hashes agree.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has none. Repetition
inside a document, or between rows of the same id, removes nothing. A null id
counts as larger than every other; between rows without an id nothing is removed. Texts of any length are taken whole. An empty table gives no rows;
only the columns for id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomflow.llm.scratch import input_bytes, shuffle_partitions
from atomflow.llm.text import OTHER, hash_runs, hash_words, mix, sliced, trim

#: Bytes of input (as stored) in a batch of documents, at least: a task's memory is some tens of times this.
BATCH = 1 << 20
#: Bytes of input (as stored) whose anchors one hash range takes, at least; about half as many bytes.
RANGE = 64 << 20
_NONE = np.int64(2**63 - 1)


@lru_cache(None)
def difference_cover(v: int) -> tuple[int, ...]:
    """A smallest set whose differences are all numbers modulo v (v up to about 32)."""
    size = 1
    while size * (size - 1) + 1 < v:
        size += 1
    while True:
        for rest in combinations(range(1, v), size - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return cover
        size += 1


def period(window: int) -> int:
    """A period that makes anchors rare but leaves them at least half a window long; those with a perfect cover."""
    return max((v for v in (1, 3, 7, 13, 21, 31) if v <= window // 2 + 1), default=1)


class Batch:
    """The words of some documents, and the hashes of their anchors and windows."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        self.window, self.v = window, period(window)
        self.cover = difference_cover(self.v)
        self.anchor = window - self.v + 1
        self.ids = np.array([_NONE if i is None else i for i in ids], np.int64)
        self.texts = [t.encode() if t else b"" for t in texts]
        words, bounds = [], [np.zeros(1, np.int64)]
        at = 0
        for lo, hi in sliced(self.texts):
            w, b = hash_words(self.texts[lo:hi])
            words.append(w)
            bounds.append(b[1:] + at)
            at += len(w)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.bounds = np.concatenate(bounds)
        n = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.words)) - np.repeat(self.bounds[:-1], n)
        self.left = np.repeat(self.bounds[1:], n) - np.arange(len(self.words))  # words to the end of the document

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors among all words, and their hashes."""
        at = np.flatnonzero(np.isin(self.place % self.v, self.cover) & (self.left >= self.anchor))
        return at, hash_runs(self.words, self.anchor)[at] if len(at) else np.empty(0, np.uint64)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at these positions."""
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return hash_runs(self.words, self.window)[at], hash_runs(mix(self.words), self.window, OTHER)[at]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Positions of the windows of which an anchor at a cover position is shared; shared holds anchor positions."""
        flag = np.zeros(len(self.words) + 1, np.int32)
        flag[shared] = 1
        before = np.concatenate([[0], np.cumsum(flag)])
        at = np.flatnonzero(self.left >= self.window)
        return at[before[at + self.v] > before[at]]


def _by_hash(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order with their smallest and largest owner."""
    if not len(hashes):
        return hashes, owners, owners
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.minimum.reduceat(o, first), np.maximum.reduceat(o, first)


def _by_window(h: np.ndarray, c: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows (two hashes) in ascending order with their smallest owner."""
    if not len(h):
        return h, c, owners
    order = np.lexsort((c, h))
    h, c, o = h[order], c[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
    return h[first], c[first], np.minimum.reduceat(o, first)


def _find(h: np.ndarray, c: np.ndarray, wanted_h: np.ndarray, wanted_c: np.ndarray) -> np.ndarray:
    """Where each wanted window stands among distinct ones in ascending order, or -1."""
    at = np.searchsorted(h, wanted_h)
    out = np.full(len(at), -1)
    todo = np.arange(len(at))
    while len(todo):
        todo = todo[at[todo] < len(h)]
        todo = todo[h[at[todo]] == wanted_h[todo]]
        same = c[at[todo]] == wanted_c[todo]
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1  # another window with the same first hash
    return out


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes starts in the ascending hashes, and the end."""
    marks = np.array([(k << 64) // n for k in range(n)], np.uint64)
    return np.append(np.searchsorted(hashes, marks), len(hashes))


def _texts(table: pa.Table) -> tuple[list, list]:
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def _out(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    trim()
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


#: An anchor is sent as 32 of its bits beside its range. Two anchors that agree by accident only cost a needless look at a window.
def _send_anchors(table: pa.Table, window: int, ranges: int) -> pa.Table:
    batch = table.column("batch")[0].as_py()
    b = Batch(*_texts(table), window)
    at, hashes = b.anchors()
    h = np.unique(hashes)
    starts = _ranges(h, ranges)
    short = _short(h)
    rows = [(k, batch, short[s:e].tobytes()) for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if e > s]
    return _out(rows, ["range", "batch", "hashes"], [pa.int32(), pa.int32(), pa.binary()])


def _short(h: np.ndarray) -> np.ndarray:
    return (mix(h) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each batch, the anchors of this range that another batch has too."""
    k = table.column("range")[0].as_py()
    batches = table.column("batch").to_pylist()
    parts = [np.unique(np.frombuffer(x.as_buffer(), "<u4")) for x in table.column("hashes")]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for batch, part in zip(batches, parts, strict=True):
        mine = part[np.isin(part, twice, assume_unique=True)]
        if len(mine):
            rows.append((batch, k, mine.tobytes()))
    return _out(rows, ["batch", "range", "hashes"], [pa.int32(), pa.int32(), pa.binary()])


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    marks = np.array([(k << 64) // n for k in range(n)], np.uint64)
    return np.searchsorted(marks, h, side="right") - 1


def _send_windows(texts: pa.Table, answers: pa.Table, window: int, ranges: int) -> pa.Table:
    names, types = ["range", "batch", "hashes", "checks", "owners"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    if not texts.num_rows:
        return _out([], names, types)
    batch = texts.column("batch")[0].as_py()
    b = Batch(*_texts(texts), window)
    at, hashes = b.anchors()
    h, lo, hi = _by_hash(hashes, b.doc[at])
    told = [np.empty(0, np.uint64)]
    for k, x in zip(answers.column("range").to_pylist(), answers.column("hashes"), strict=True):
        told.append(np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) | (np.uint64(k) << np.uint64(32)))
    keys = _short(h).astype(np.uint64) | (_range_of(h, ranges).astype(np.uint64) << np.uint64(32))
    shared = h[(lo != hi) | np.isin(keys, np.concatenate(told))]
    where = b.candidates(at[np.isin(hashes, shared)])
    w, check = b.windows(where)
    h, c, least = _by_window(w, check, b.ids[b.doc[where]])
    starts = _ranges(h, ranges)
    rows = [(k, batch, h[s:e].tobytes(), c[s:e].tobytes(), least[s:e].tobytes()) for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if e > s]
    return _out(rows, names, types)


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each batch, the windows of this range that start in a document of another batch with a smaller id than all of its own."""
    batches = table.column("batch").to_pylist()
    parts = [tuple(np.frombuffer(x.as_buffer(), "<u8") for x in pair) for pair in zip(table.column("hashes"), table.column("checks"), strict=True)]
    owners = [np.frombuffer(x.as_buffer(), "<i8") for x in table.column("owners")]
    h, c, least = _by_window(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(owners))
    rows = []
    for batch, (part, check), own in zip(batches, parts, owners, strict=True):
        mine = least[_find(h, c, part, check)] < own
        if mine.any():
            rows.append((batch, part[mine].tobytes(), check[mine].tobytes()))
    return _out(rows, ["batch", "hashes", "checks"], [pa.int32(), pa.binary(), pa.binary()])


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _judge(texts: pa.Table, answers: pa.Table, window: int, full: bool) -> pa.Table:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * full
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * full
    rest = [c for c in ("rest",) if c in texts.column_names]
    if not texts.num_rows:
        out = _out([], names, types)
        return out.append_column("rest", texts.column("rest")) if rest else out
    ids, raw = _texts(texts)
    b = Batch(ids, raw, window)
    at = np.flatnonzero(b.left >= window)
    w, check = b.windows(at)
    told = [np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x.as_buffer(), "<u8") for x in answers.column(n))]) for n in ("hashes", "checks")]
    h, c, least = _by_window(w, check, b.ids[b.doc[at]])
    smaller = least[_find(h, c, w, check)] < b.ids[b.doc[at]] if len(w) else np.zeros(0, bool)
    h, c, _ = _by_window(*told, np.zeros(len(told[0]), np.int8))
    hit = at[smaller | (_find(h, c, w, check) >= 0)]
    cover = np.zeros(len(b.words) + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    rows = []
    for i, (lo, hi) in enumerate(zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True)):
        words = b.texts[i].split()
        out = gone[lo:hi]
        removed = int(out.sum())
        kept = b" ".join([x for x, y in zip(words, out.tolist(), strict=True) if not y] if removed else words)
        row = (ids[i], hi - lo, removed, hashlib.sha256(kept).hexdigest())
        rows.append((*row, kept.decode() if removed else raw[i]) if full else row)
    out = _out(rows, names, types)
    for c in rest:
        out = out.append_column(c, texts.column(c))
    return out


def _bytes(size: str) -> int:
    """A size as Spark's settings spell it: a number and a unit, mebibytes without one."""
    found = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", size.strip().lower())
    return int(found[1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[found[2] or "m"] if found else 1 << 30


def sizes_for(spark: SparkSession, batch_bytes: int | None = None) -> tuple[int, int]:
    """Bytes of a batch and of a range, from the memory that a core of an executor has: the larger they are, the fewer and longer the rows between them."""
    conf = spark.sparkContext.getConf()
    memory = _bytes(conf.get("spark.executor.memory", "1g")) // max(1, int(conf.get("spark.executor.cores", "1")))
    return batch_bytes or max(BATCH, memory >> 11), max(RANGE, memory >> 4)


def remove_repeats(
    docs: DataFrame, window: int = 13, full: bool = True, batch_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", rest: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    With full also kept: the text as it was if nothing is removed, else the kept words joined by spaces. With rest
    also rest: a struct of the document's further columns.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    size = input_bytes(docs, text_col)
    batch_bytes, range_bytes = sizes_for(docs.sparkSession, batch_bytes)
    ranges, batches = max(partitions, -(-size // range_bytes)), max(partitions, -(-size // batch_bytes))
    doc_id, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    # Dealt by the text too: rows without an id, or of one id, are spread; owners are compared by id wherever they lie.
    cols = [doc_id.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(batches)).cast("int").alias("batch")]
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    if rest:
        cols.append(F.struct(*(docs[c] for c in others)).alias("rest") if others else F.struct(F.lit(0).alias("none")).alias("rest"))
    dealt = docs.select(*cols)
    by_batch = dealt.groupBy("batch")
    sent = by_batch.applyInArrow(lambda t: _send_anchors(t, window, ranges), "range int, batch int, hashes binary")
    shared = sent.groupBy("range").applyInArrow(_answer_anchors, "batch int, range int, hashes binary")
    windows = by_batch.cogroup(shared.groupBy("batch")).applyInArrow(
        lambda t, a: _send_windows(t, a, window, ranges), "range int, batch int, hashes binary, checks binary, owners binary"
    )
    smaller = windows.groupBy("range").applyInArrow(_answer_windows, "batch int, hashes binary, checks binary")
    schema = _RESULT + ", kept string" * full + (f", rest {dealt.schema['rest'].dataType.simpleString()}" if rest else "")
    return by_batch.cogroup(smaller.groupBy("batch")).applyInArrow(lambda t, a: _judge(t, a, window, full), schema)


def without_repeats(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with their own columns and the repeated passages taken out of their texts.

    Where words went, length_col, if there is one, gets the new number of characters.
    """
    out = remove_repeats(docs, window, id_col=id_col, text_col=text_col, rest=True)
    cols = []
    for f in docs.schema:
        if f.name == id_col:
            c = F.col("doc_id")
        elif f.name == text_col:
            c = F.col("kept")
        elif f.name == length_col:
            c = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("rest")[f.name])
        else:
            c = F.col("rest")[f.name]
        cols.append(c.cast(f.dataType).alias(f.name))
    return out.select(*cols)
