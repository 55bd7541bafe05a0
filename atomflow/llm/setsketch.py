"""Near-duplicate documents by SetSketch registers, joint likelihood and exact verification.

A document's set holds the hashes of its distinct runs of ``k`` words, in lower case for A-Z. Register i of its
sketch is floor(1 - log_base(m_i)), truncated to 16 bits, where m_i is the least of the set's
exponentially distributed i-th hash values. The registers of a union are the larger ones of its parts, and two sets agree in a
register with a chance near their Jaccard similarity, so bands of registers serve as buckets.

1. Documents with equal sets are collapsed to one node. Nodes are numbered in the order of their smallest ids.
2. Nodes that share a band are candidates. In each bucket the smallest node is compared with all others.
   Pairs whose likelihood, jointly over the counts of larger, equal and smaller registers and given both set sizes,
   peaks clearly below the threshold are left out; the rest are confirmed on the full sets.
3. Links make components. In buckets that still hold several components, every node outside the
   bucket's largest one is compared with the members of other components, in square blocks inside Python: by
   sketch, then, from the most equal registers down, on the full sets, until one member of that component is
   linked. Only links leave Python. Nodes that are in one component already need no further
   comparison, so a group of any number of copies costs a few comparisons each, and no bucket is capped.

With ``miss`` as the bound for the chance that a pair exactly at the threshold shares no band, the band length follows.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than k words, but at least one, has its
whole sequence as its only member; a null or empty text or one without words has an empty set and links with nothing. A node
is a set, not an id: rows that repeat an id but not the set are separate documents, and rows without an id are linked as all others.
component_id is the smallest id in the component, null if it has none. In each component one row is kept, and with it only those that
repeat its id (not null) and text. Texts of any length are taken whole, in blocks. An empty table gives no rows; only the columns for id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomflow.llm.graph import components
from atomflow.llm.scratch import rows_that_stay, shuffle_partitions, small_side, split_join, stored
from atomflow.llm.text import mix, parts_of, shingle_sets, sliced, trim
from atomflow.llm.vectors import groups_of as runs_of

REGISTERS = 160
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
BLOCK = 256
#: Candidates are left out if their estimate is so many standard errors below the threshold.
ERRORS = 4.5
_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_length(threshold: float, miss: float = 1e-5, registers: int = REGISTERS) -> int:
    """The longest band with which a pair at the threshold shares no band with at most that chance."""
    return max((r for r in range(1, registers + 1) if (1 - threshold**r) ** (registers // r) <= miss), default=1)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches (sets x registers) of non-empty sets of 64-bit hashes."""
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i, f in enumerate(_FACTORS):
        least[:, i] = np.minimum.reduceat(x * f, at)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    minima = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(minima) / math.log(BASE)), 0, LIMIT).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def estimate(greater: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood.

    greater, less: in how many registers a is larger or smaller than b; na, nb: set sizes. The
    log-likelihood is concave in the similarity, so a ternary search finds its peak.
    """
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    equal = registers - greater - less

    def value(j):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return greater * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + equal * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = value(x) < value(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def likely(greater: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, registers: int = REGISTERS) -> np.ndarray:
    """Whether the estimate is at least so high: as the log-likelihood is concave, whether it doesn't fall there."""
    u, v = na / (na + nb), nb / (na + nb)
    c, tiny = (BASE - 1) / BASE, 1e-300
    x, y = u - v * least, v - u * least
    a, b = (np.maximum(-np.log1p(-np.clip(z, 0, 1) * c) / math.log(BASE), tiny) for z in (x, y))
    # How fast the chances of a larger and of a smaller register fall.
    da, db = v * c / (1 - x * c) / math.log(BASE), u * c / (1 - y * c) / math.log(BASE)
    slope = (registers - greater - less) * (da + db) / np.maximum(1 - a - b, tiny) - greater * da / a - less * db / b
    return (slope >= 0) & (np.minimum(u / v, v / u) >= least)


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["row", "doc_id", "digest", "n", "sig", "sketch"]
    for batch in (p for b in batches for p in parts_of(b, 3)):
        texts = [t.encode().lower() if t else None for t in batch.column("text").to_pylist()]
        for lo, hi in sliced(texts, 1 << 19):
            sets = shingle_sets(texts[lo:hi], k)
            full = [s for s in sets if len(s)]
            sketch = iter(registers_of(full)) if full else iter(())
            sig, out = [], []
            for s in sets:
                sig.append(np.array([mix(s).sum(), mix(s * np.uint64(0xD6E8FEB86659FD93)).sum()], "<u8").tobytes() if len(s) else None)
                out.append(next(sketch).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names[:3]), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.array(out, pa.binary())], names)
    trim()


def _bands(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    bands = REGISTERS // length
    for batch in batches:
        if not batch.num_rows:
            continue
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(batch.num_rows, REGISTERS).astype(np.uint64)
        keys = np.zeros((batch.num_rows, bands), np.uint64)
        keys += np.arange(bands, dtype=np.uint64) << np.uint64(32)
        for i in range(length):
            keys = mix(keys + s[:, i : bands * length : length] + np.uint64(1))
        number = np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(number), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["key", "band", "node"])


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate is high enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
        near = likely((a > b).sum(1), (a < b).sum(1), batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float), least)
        yield pa.RecordBatch.from_struct_array(batch.filter(pa.array(near)).select(["a", "b"]).to_struct_array())


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in parts_of(b, 1)):
        texts = [t.encode().lower() if t else None for t in batch.column(1).to_pylist()]
        for lo, hi in sliced(texts, 1 << 19):
            sets = shingle_sets(texts[lo:hi], k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])
    trim()


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two full sets are similar enough."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return n > 0 and den * n >= num * (len(a) + len(b) - n)


def _confirmed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
            keep.append(linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), num, den))
        yield pa.RecordBatch.from_struct_array(batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"]).to_struct_array())


def _across(batches: Iterator[pa.RecordBatch], least: float, length: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links from the outsiders of a bucket's block to members of other components.

    A pair that shares an earlier band is left to that bucket.
    """
    out: list[tuple[int, int]] = []
    for g in runs_of(batches, ["key", "one", "two"]):
        asks = g["asks"].to_numpy().astype(bool)
        if not asks.any() or asks.all():
            continue
        ids, comp, n = (g[c].to_numpy() for c in ("node", "comp", "n"))
        outside = g["outside"].to_numpy().astype(bool)
        band = g["band"][0].as_py()
        s = np.frombuffer(b"".join(g["sketch"].to_pylist()), "<u2").reshape(len(ids), REGISTERS)
        full = [np.frombuffer(x.as_buffer(), "<u8") for x in g["members"].combine_chunks()]
        members = np.flatnonzero(~asks)
        for q in np.flatnonzero(asks):
            # Of two outsiders, the one with the smaller id asks.
            m = members[(comp[members] != comp[q]) & (~outside[members] | (ids[members] > ids[q]))]
            equal = s[m] == s[q]
            same = equal.sum(1)
            near = same >= (least - 0.05) * REGISTERS
            if not near.any():
                continue
            if band:
                near &= ~equal[:, : band * length].reshape(len(m), band, length).all(2).any(1)
            m, same = m[near], same[near]
            greater = (s[q] > s[m]).sum(1)
            near = likely(greater, REGISTERS - same - greater, np.full(len(m), float(n[q])), n[m].astype(float), least)
            m, same = m[near], same[near]
            done: set[int] = set()
            for i in np.argsort(-same, kind="stable").tolist():
                if comp[m[i]] not in done and linked(full[q], full[m[i]], num, den):
                    done.add(comp[m[i]])
                    out.append((ids[q], ids[m[i]]))
    x = np.array(out, np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])
    trim()


class NearDuplicates:
    """One run over a table of documents; see near_duplicates."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str):
        self.spark, self.k, self.num, self.den = docs.sparkSession, k, num, den
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
        threshold = num / den
        self.least = threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / REGISTERS)
        self.length = band_length(threshold)

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """node and members (the full set) of these distinct nodes (a small stored table)."""
        k = self.k
        ids = ids.join(self.nodes.select("node", F.col("doc_id").alias("rep"), F.col("digest").alias("own")).hint("merge"), "node")
        ids = small_side(ids)
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("own"))).select("node", "text")
        if self.repeated:
            texts = texts.dropDuplicates(["node"])
        return stored(texts.mapInArrow(lambda it: _sets(it, k), "node bigint, members binary"), "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a stored table) that are links by their full sets."""
        num, den = self.num, self.den
        sets = self.sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        full = split_join(pairs, sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a", "b")
        full = full.join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")).hint("merge"), "b")
        return stored(full.select("a", "b", "ma", "mb").mapInArrow(lambda it: _confirmed(it, num, den), "a bigint, b bigint").distinct(), "links")

    def run(self) -> DataFrame:
        k, length, least = self.k, self.length, self.least
        docs = self.docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "text")
        sketches = stored(docs.mapInArrow(lambda it: _sketches(it, k), "row bigint, doc_id bigint, digest bigint, n bigint, sig binary, sketch binary"), "sketches")
        self.repeated = bool(sketches.filter("n > 0").groupBy("doc_id", "digest").agg(F.count("*").alias("c")).filter("c > 1").take(1))
        # The row that stands for a set: null ids come last, and only among them rows of one text are told apart.
        first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
        groups = sketches.filter("n > 0").groupBy("sig").agg(F.min(first).alias("first"), F.min_by(F.struct("n", "sketch"), first).alias("own"), F.count("*").alias("copies"))
        numbered = groups.orderBy("first", "sig").withColumn("node", F.monotonically_increasing_id())
        self.nodes = nodes = stored(numbered.select("node", "sig", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest"), "own.n", "own.sketch", "copies"), "nodes")
        keys = stored(nodes.select("node", "sketch").mapInArrow(lambda it: _bands(it, length), "key bigint, band int, node bigint"), "bands")
        shared = stored(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).filter("size > 1"), "shared")
        buckets = stored(split_join(keys, shared, "key", "node", shared.select("key", F.col("size").alias("n"))), "buckets")

        pairs = stored(buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "candidates")
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        tested = split_join(pairs, side("a"), "a", "b").join(side("b").hint("merge"), "b")
        tested = stored(tested.mapInArrow(lambda it: _likely(it, least), "a bigint, b bigint"), "pairs")
        links = self.confirmed(tested)
        labels = components(links)
        more = self.across(buckets, nodes, labels)
        if more is not None and more.take(1):
            labels = components(links.unionByName(more))
        tops = nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("top"))
        tops = split_join(labels, tops, "component", "node")
        placed = nodes.select("sig", "node", "first", "copies").join(tops.hint("merge"), "node", "left")
        placed = placed.select("sig", "first", "copies", F.when(F.col("component").isNull(), F.col("first.doc_id")).otherwise(F.col("top")).alias("component_id"), F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("root"))
        placed = stored(placed, "placed")
        whole = split_join(sketches.drop("sketch"), placed.drop("copies"), "sig", "row", placed.select("sig", F.col("copies").alias("n")), "left")
        kept = F.col("sig").isNull() | (F.col("root") & (first == F.col("first")))
        own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return whole.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"), "digest")

    def across(self, buckets: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Links across the components of buckets, or None if every bucket is in one component.

        A bucket of two was settled when its pair was tested.
        """
        placed = buckets.filter("size > 2").join(labels.hint("merge"), "node", "left")
        placed = stored(placed.select("key", "band", "node", F.coalesce("component", "node").alias("comp")), "labelled")
        counts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
        mixed = counts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", (-F.col("comp")).alias("back"))).alias("best"))
        mixed = mixed.filter("comps > 1").select("key", "size", (-F.col("best.back")).alias("most"), F.ceil(F.col("size") / BLOCK).alias("blocks"), F.ceil((F.col("size") - F.col("best.c")) / BLOCK).alias("ask_blocks"))
        mixed = stored(mixed, "mixed-keys")
        rows = split_join(placed, mixed.drop("size"), "key", "node", mixed.select("key", F.col("size").alias("n"))).withColumn("outside", F.col("comp") != F.col("most"))
        rows = stored(rows, "mixed")
        if not rows.take(1):
            return None
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        every = rows.withColumn("asks", F.lit(False)).withColumn("one", mine("blocks")).withColumn("two", upto("ask_blocks"))
        asking = rows.filter("outside").withColumn("asks", F.lit(True)).withColumn("two", mine("ask_blocks")).withColumn("one", upto("blocks"))
        both = every.unionByName(asking).select("key", "band", "one", "two", "node", "comp", "outside", "asks")
        sets = self.sets_of(rows.select("node").distinct())
        both = both.join(nodes.hint("merge"), "node").join(sets.hint("merge"), "node")
        dealt = both.repartition(shuffle_partitions(self.spark), "key", "one", "two").sortWithinPartitions("key", "one", "two")
        least, length, num, den = self.least, self.length, self.num, self.den
        return stored(dealt.mapInArrow(lambda it: _across(it, least, length, num, den), "a bigint, b bigint").distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; links have den * intersection >= num * union."""
    return NearDuplicates(docs, k, num, den, id_col, text_col).run().drop("digest")


def without_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps, told by id and text."""
    judged = stored(NearDuplicates(docs, k, num, den, id_col, text_col).run().select("doc_id", "digest", "kept"), "judged-rows")
    names = [f"_{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    return rows_that_stay(docs.toDF(*names), judged, doc_id, F.xxhash64(F.col(text).cast("string"))).toDF(*docs.columns)
