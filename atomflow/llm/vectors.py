"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors of one label are compared. Each normalised vector is projected on Gaussian directions; a table's code is
the tuple of its projections, shifted and cut into steps of ``width``, and a bucket is a label, a table and a code.
Two vectors of cosine c lie sqrt(2 - 2c) apart, so each of their projections falls into one step with a chance p(c) (``share``). The
number of projections grows with the logarithm of the largest label's number of distinct vectors, so that an unrelated
vector shares a bucket about once in eight tables, and the number of tables is such that a pair at the threshold
shares none of them with a chance of at most ``miss``.

1. Equal vectors of a label (by a 128-bit digest of their bytes) are collapsed to the smallest id with their number, so copies cost one row.
2. Only keys and ids go to the buckets. A bucket of few vectors gives its pairs of ids. Pairs whose signs on further random directions differ in
   more places than those of a link could (but for a chance of 1e-11) are left out in the JVM; the rest get their
   vectors and are checked by their exact cosine in double precision.
3. Buckets that are large in some task, or turn out to be, are compared in square blocks of vectors, for as many tasks as they need.
   These return for each vector the number of its links there and one edge to the smallest vector that it is linked with, directly or
   not; pairs are never written out. A pair that shares several large buckets counts in the first of them, and not in small ones.

No bucket is capped, and nothing grows with the square of a group but the comparisons of its blocks.

Defined results: a vector that is null, empty or zero, or that has null or non-finite components, or whose label is null, links with
nothing: 0 links, its own component, kept. Vectors of different lengths don't link; vectors of any length are taken whole. Rows that repeat an id
are separate vectors for the counts; they have one row each. Rows without an id link with nothing. An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomflow.llm.graph import components, label_all
from atomflow.llm.scratch import shuffle_partitions, small_side, stored
from atomflow.llm.text import mix

THRESHOLD = 0.93
MISS = 0.002
FEWEST = 4
WIDTH = 2.0
#: Vectors of a bucket that gives its pairs of ids; larger ones are compared in blocks.
SMALL = 16
BLOCK = 1024
SEED = 17
SIGNS = 128
#: Sign bits in which a link differs at most, in standard errors above their expected number.
ERRORS = 7.0


def share(cosine: float, width: float = WIDTH) -> float:
    """The chance that a projection puts two vectors of that cosine into one step."""
    r = width / math.sqrt(max(2 - 2 * cosine, 1e-12))
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(projections: int, cosine: float = THRESHOLD, miss: float = MISS, width: float = WIDTH) -> int:
    """So many tables leave a pair of that cosine apart with a chance of at most miss."""
    return math.ceil(math.log(miss) / math.log1p(-(share(cosine, width) ** projections)))


def projections_for(vectors: int, width: float = WIDTH) -> int:
    """So many projections let an orthogonal vector share a bucket about once in eight tables among so many vectors."""
    return max(FEWEST, math.ceil(math.log(8 * max(vectors, 1)) / -math.log(share(0.0, width))))


def recall(cosine: float = THRESHOLD, projections: int = 12, tables: int | None = None, width: float = WIDTH) -> float:
    """The chance that two vectors of that cosine share a code in some table."""
    return 1 - (1 - share(cosine, width) ** projections) ** (tables or tables_for(projections))


def differing(threshold: float) -> int:
    """Sign bits in which a link differs at most."""
    p = math.acos(min(threshold, 1.0)) / math.pi
    return math.ceil(SIGNS * p + ERRORS * math.sqrt(SIGNS * p * (1 - p)))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as doubles of length 1; they are divided by their largest component first, so that no square over- or underflows."""
    v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _directions(dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, n)), rng.uniform(0, 1, n)


def codes(units: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """32-bit codes (rows x tables) of unit vectors."""
    directions, shifts = _directions(units.shape[1], tables * projections, SEED)
    steps = np.floor(units @ directions / width + shifts).astype(np.int64).astype(np.uint64).reshape(len(units), tables, projections)
    total = np.zeros((len(units), tables), np.uint64)
    for k in range(projections):
        total = mix(total + steps[:, :, k] + np.uint64(0x9E3779B97F4A7C15))
    return (total >> np.uint64(32)).astype(np.uint32)


def signs(units: np.ndarray) -> np.ndarray:
    """Two 64-bit words of signs for each unit vector."""
    directions, _ = _directions(units.shape[1], SIGNS, SEED + 1)
    bits = np.packbits(units @ directions > 0, axis=1)
    return bits.view("<i8")


def _valid(batches: Iterator[pa.RecordBatch], kind: str, vectors: bool) -> Iterator[pa.RecordBatch]:
    """Digests, and bytes if wanted, of the vectors; the digest is null where a vector can't link."""
    for batch in batches:
        vecs = batch.column(2)
        flat = vecs.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(kind) if flat.null_count == 0 else np.array([np.nan if x is None else x for x in flat.to_pylist()], kind)
        values = values + values.dtype.type(0)  # -0.0 becomes 0.0
        sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(vecs).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        filled = sizes > 0
        starts = (ends - sizes)[filled]
        good = np.zeros(len(sizes), bool)
        if len(starts):
            good[filled] = (np.minimum.reduceat(np.isfinite(values), starts)) & (np.maximum.reduceat(values != 0, starts))
        ok = good & np.array(batch.column(0).is_valid()) & np.array(batch.column(1).is_valid())
        raw = [values[e - n : e].tobytes() if g else None for g, n, e in zip(ok.tolist(), sizes.tolist(), ends.tolist(), strict=True)]
        digests = [hashlib.blake2b(x, digest_size=16).digest() if x is not None else None for x in raw]
        cols = [batch.column(0), batch.column(1), pa.array(digests, pa.binary())] + ([pa.array(raw, pa.binary())] if vectors else [])
        yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "digest", "vec"][: len(cols)])


def _by_length(raw: list[bytes]) -> Iterator[list[int]]:
    for n in sorted({len(x) for x in raw}):
        yield [i for i, x in enumerate(raw) if len(x) == n]


def _signed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Adds each vector's signs."""
    for batch in batches:
        raw = batch.column(2).to_pylist()
        out = np.zeros((len(raw), 2), np.int64)
        for at in _by_length(raw):
            out[at] = signs(unit([raw[i] for i in at], kind))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[:, 0]), pa.array(out[:, 1])], [*batch.schema.names, "s0", "s1"])


def _keys(batches: Iterator[pa.RecordBatch], kind: str, tables: int, projections: int, width: float) -> Iterator[pa.RecordBatch]:
    """A row for each vector and table: key of the bucket (the table in its upper bits), the vector's id, and whether this batch alone makes it large."""
    bits = max(1, (tables - 1).bit_length())
    for batch in batches:
        raw = batch.column(2).to_pylist()
        for at in _by_length(raw):
            c = codes(unit([raw[i] for i in at], kind), tables, projections, width)
            labels = np.array(batch.column(1).take(pa.array(at)).to_pylist(), np.int64).astype(np.uint64)
            where = mix(mix(labels + np.uint64(len(raw[at[0]]) << 32))[:, None] + (np.arange(tables, dtype=np.uint64) << np.uint64(32))[None, :] + c)
            where = where >> np.uint64(bits + 1) | np.arange(tables, dtype=np.uint64)[None, :] << np.uint64(63 - bits)
            key = where.ravel().view(np.int64)
            _, back, n = np.unique(key, return_inverse=True, return_counts=True)
            ids = np.repeat(np.array(batch.column(0).take(pa.array(at)).to_pylist(), np.int64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(n[back] > SMALL)], ["key", "rep", "large"])


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the named columns, of sorted batches; runs may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rep) sorted by key: the pairs of ids of small buckets, and with key the members of all others.

    No more than SMALL + 1 rows of a bucket that isn't finished are held.
    """
    names = ["key", "a", "b"]
    held_key, held = np.empty(0, np.int64), np.empty(0, np.int64)
    large: int | None = None  # the bucket that is being given out

    def finished(key: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        out = [(np.empty(0, np.int64),) * 2]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(start, len(key))), np.diff(np.append(start, len(key))))
        few = (size <= SMALL) & (key != large if large is not None else True)
        for step in range(1, SMALL):
            i = np.flatnonzero((key[step:] == key[:-step]) & few[step:])
            if not len(i):
                break
            x, y = rep[i], rep[i + step]
            out.append((np.minimum(x, y), np.maximum(x, y)))
        a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        many = ~few
        keys = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key[many])])
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([a, rep[many]])), pa.concat_arrays([pa.array(b), pa.nulls(int(many.sum()), pa.int64())])], names)

    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy()])
        rep = np.concatenate([held, batch.column(1).to_numpy()])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if len(key) - cut > SMALL or key[-1] == large:
            if cut:
                yield finished(key[:cut], rep[:cut])
            large = int(key[-1])
            yield finished(key[cut:], rep[cut:])
            held_key, held = key[:0], rep[:0]
        else:
            if cut:
                yield finished(key[:cut], rep[:cut])
            held_key, held = key[cut:], rep[cut:]
    if len(held):
        yield finished(held_key, held)


def _checked(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose cosine reaches the threshold."""
    for batch in batches:
        one, two = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
        keep = np.zeros(len(one), bool)
        for at in _by_length(one):
            at = [i for i in at if len(two[i]) == len(one[i])]
            if at:
                keep[at] = np.einsum("ij,ij->i", unit([one[i] for i in at], kind), unit([two[i] for i in at], kind)) >= threshold
        yield pa.RecordBatch.from_struct_array(batch.filter(pa.array(keep)).select(["a", "b", "na", "nb"]).to_struct_array())


def _links(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each vector of a large bucket's pair of blocks: its links there (copies counted), and the smallest vector of its component there."""
    out: list[np.ndarray] = []
    held = 0
    for g in groups_of(batches, ["key", "one", "two"]):
        key, one, two = (g[c][0].as_py() for c in ("key", "one", "two"))
        raw = g["vec"].to_pylist()
        if len(raw) < 2 or any(len(x) != len(raw[0]) for x in raw):  # another length met here by accident: each is with its own in other tables
            continue
        ids, n, block, label = (g[c].to_numpy() for c in ("rep", "copies", "block", "label"))
        v = unit(raw, kind)
        left = np.flatnonzero(block == one)
        right = left if one == two else np.flatnonzero(block == two)
        i, j = np.nonzero(v[left] @ v[right].T >= threshold)
        i, j = left[i], right[j]
        keep = (i < j if one == two else i != j) & (label[i] == label[j])
        i, j = i[keep], j[keep]
        # A pair counts in the first large bucket that it shares: keys are in the order of their tables.
        earlier: dict[int, int] = {}
        of = [frozenset(earlier.setdefault(k, k) for k in ks if k < key) for ks in g["keys"].to_pylist()]
        if len(i) and any(of):
            first = np.array([of[x].isdisjoint(of[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[first], j[first]
        if not len(i):
            continue
        links = np.zeros(len(raw), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = ids[order][label_all(len(ids), rank[i], rank[j])[rank]]
        some = links > 0
        out.append(np.stack([ids[some], links[some], root[some]]))
        held += int(some.sum())
        if held > 50_000:
            x = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in x], ["rep", "links", "root"])
            out, held = [], 0
    x = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(r) for r in x], ["rep", "links", "root"])


def _large_links(large: DataFrame, reps: DataFrame, keys_of: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Links (rep, links, root) within the large buckets (key, rep)."""
    sizes = stored(large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "large-sizes")
    blocks = large.join(small_side(sizes), "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "rep", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    full = placed.join(reps.select("rep", "label", "vec", "copies").hint("merge"), "rep").join(keys_of.hint("merge"), "rep")
    dealt = full.repartition(shuffle_partitions(large.sparkSession), "key", "one", "two").sortWithinPartitions("key", "one", "two")
    return stored(dealt.mapInArrow(lambda it: _links(it, kind, threshold), "rep bigint, links bigint, root bigint"), "large-links")


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, width: float = WIDTH, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    single = table.schema[vec_col].dataType.elementType.typeName() == "float"
    kind, typed = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).cast(typed).alias("vec"))
    valid = rows.mapInArrow(lambda it: _valid(it, kind, True), "vec_id bigint, label bigint, digest binary, vec binary").filter("digest IS NOT NULL")
    reps = valid.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    signed = "rep bigint, label bigint, vec binary, copies bigint, digest binary, s0 bigint, s1 bigint"
    reps = stored(reps.select("rep", "label", "vec", "copies", "digest").mapInArrow(lambda it: _signed(it, kind), signed), "distinct")
    repeated = bool(reps.groupBy("rep").count().filter("count > 1").take(1))
    reps = reps.withColumn("vec_id", F.col("rep"))
    if repeated:  # different vectors of one id: they are numbered in the order of their ids
        reps = stored(reps.orderBy("vec_id", "label", "digest").withColumn("rep", F.monotonically_increasing_id()), "numbered")
    most = reps.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 1
    projections = projections_for(most, width)
    tables = tables_for(projections, threshold, miss, width)
    keys = stored(reps.select("rep", "label", "vec").mapInArrow(lambda it: _keys(it, kind, tables, projections, width), "key bigint, rep bigint, large boolean"), "keys")
    hot = stored(keys.filter("large").select("key").distinct(), "hot")
    cool = keys.join(small_side(hot), "key", "left_anti").select("key", "rep")
    cool = cool.repartition(shuffle_partitions(table.sparkSession), "key").sortWithinPartitions("key")
    found = stored(cool.mapInArrow(_small, "key bigint, a bigint, b bigint"), "candidates")
    pairs = found.filter("key IS NULL").select("a", "b")
    large = found.filter("key IS NOT NULL").select("key", F.col("a").alias("rep")).unionByName(keys.join(small_side(hot), "key", "left_semi").select("key", "rep"))
    large = stored(large, "large")
    some_large = bool(large.take(1))

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("s0").alias(f"s0{c}"), F.col("s1").alias(f"s1{c}")).hint("merge")
    apart = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    near = stored(pairs.join(side("a"), "a").join(side("b"), "b").filter(apart <= differing(threshold)).select("a", "b").distinct(), "near")
    if some_large:
        # At most one key for each table, so these lists are bounded.
        keys_of = stored(large.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("keys")), "large-keys")
        lists = lambda c: keys_of.select(F.col("rep").alias(c), F.col("keys").alias(f"k{c}")).hint("merge")
        near = near.join(lists("a"), "a", "left").join(lists("b"), "b", "left").filter(~F.coalesce(F.arrays_overlap("ka", "kb"), F.lit(False))).select("a", "b")
    full = lambda c: reps.select(F.col("rep").alias(c), F.col("vec").alias(f"v{c}"), F.col("copies").alias(f"n{c}"), F.col("label").alias(f"l{c}")).hint("merge")
    both = near.join(full("a"), "a").join(full("b"), "b").filter("la = lb").select("a", "b", "na", "nb", "va", "vb")
    edges = stored(both.mapInArrow(lambda it: _checked(it, kind, threshold), "a bigint, b bigint, na bigint, nb bigint"), "links")
    links = edges.select(F.col("a").alias("rep"), F.col("nb").alias("links")).unionByName(edges.select(F.col("b").alias("rep"), F.col("na").alias("links")))
    graph = edges.select("a", "b")
    if some_large:
        more = _large_links(large, reps, keys_of, kind, threshold)
        links = links.unionByName(more.select("rep", "links"))
        graph = graph.unionByName(more.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(graph).withColumnRenamed("node", "rep")
    known = reps.select("rep", "vec_id", "label", "digest", "copies").join(counts, "rep", "left").join(groups, "rep", "left")
    top = F.coalesce("component", "vec_id")
    if repeated:
        known = known.join(reps.select(F.col("rep").alias("component"), F.col("vec_id").alias("top")).hint("merge"), "component", "left")
        top = F.coalesce("top", "vec_id")
    known = stored(
        known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), top.alias("component_id")),
        "judged",
    )
    own = rows.mapInArrow(lambda it: _valid(it, kind, False), "vec_id bigint, label bigint, digest binary")
    own = own.withColumn("label", F.when(F.col("digest").isNotNull(), F.col("label")))
    return own.join(known.hint("merge"), ["label", "digest"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
