import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomflow.llm import substring
from atomflow.llm.substring import difference_cover, period, remove_repeats, without_repeats


def brute(rows, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t, *_ in rows]
    ids = [float("inf") if i is None else i for i, *_ in rows]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, float("inf")), i)
    out = []
    for (i, *_), own, w in zip(rows, ids, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < own:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 3, 13, 50])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 120))] for _ in range(6)]
    rows = [(3, None), (9, ""), (4, " \t"), (None, " ".join(passages[0])), (None, " ".join(passages[0])), (7, "é\xa0x y" * 3)]
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            words += p[a : a + rng.randint(0, 100)] + ["u%d" % rng.randint(0, 10**6) for _ in range(rng.randint(0, 20))]
        rows.append((rng.randint(0, 40), " \n".join(words)))
    rows += [(200 + i, "the same line of exactly thirteen words that all of these documents share") for i in range(80)]
    rows.append((500, "word " * 30_000))
    docs = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id bigint, text string, kept string, batch int, rest string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, window, full=False).collect()), key=repr)
    assert got == brute(rows, window)


def test_documents_keep_their_columns(spark):
    line = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a  {line}", "en", 5), (2, f"{line} b", None, 6), (3, "c  d", "x", 7)], "doc_id bigint, text string, batch string, n_chars bigint")
    out = without_repeats(docs, 13)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect()), key=repr) == [(1, f"a  {line}", "en", 5), (2, "b", None, 1), (3, "c  d", "x", 7)]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_covers():
    for v in (1, 3, 7, 13, 21, 31):
        cover = difference_cover(v)
        for i in range(v):
            for j in range(v):
                assert any((i + d) % v in cover and (j + d) % v in cover for d in range(v))
    assert len(difference_cover(7)) == 3 and period(13) == 7 and period(1) == 1


def test_rows_without_ids_are_spread(spark):
    """Many rows without an id, or of one id, don't meet in one batch; nothing is removed among them, but what a smaller id has."""
    rng = random.Random(2)
    line = " ".join(f"p{i}" for i in range(20))
    rows = [(None, f"n{i} {line} m{i}") for i in range(3000)] + [(7, f"s{i} {line}") for i in range(500)] + [(3, line), (None, None), (7, "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = remove_repeats(docs, 13, full=False, batch_bytes=20_000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, 13)
    sizes = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)).alias("b")).groupBy("b").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 400


def test_windows_need_both_hashes():
    h, c = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    assert substring._find(h, c, np.array([5, 5, 5, 9, 9, 1, 10], np.uint64), np.array([2, 1, 3, 3, 4, 1, 1], np.uint64)).tolist() == [1, 0, -1, 2, -1, -1, -1]
    a, b, least = substring._by_window(np.array([9, 5, 5, 5], np.uint64), np.array([3, 2, 1, 2], np.uint64), np.array([4, 8, 2, 6]))
    assert (a.tolist(), b.tolist(), least.tolist()) == ([5, 5, 9], [1, 2, 3], [2, 6, 4])
    assert substring._bytes("1800m") == 1800 << 20 and substring._bytes("16g") == 16 << 30 and substring._bytes("512") == 512 << 20
