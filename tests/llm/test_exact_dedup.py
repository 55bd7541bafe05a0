import hashlib
import re

from atomflow.llm.exact_dedup import DigestIndex, exact_dedup, kept_rows

SCHEMA = "doc_id bigint, text string, digest string, keep_id int"


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    keep = {k: sorted(v, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0][0] for k, v in groups.items()}
    return sorted(
        ((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows),
        key=repr,
    )


def test_against_brute_force(spark):
    texts = ["a b", "ab", " a\tb\n", "ab ", None, "", " ", "é", "é", "x y", "xy", "A b", "z" * 200_000, "z" * 200_000 + " "]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(100 + i, "hot copy", "clash", 1) for i in range(300)] + [(None, "q", "c", 1), (1, "ab", "c", 1)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_remembers_earlier_batches(spark):
    index = DigestIndex(spark, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.kept for r in index.deduplicate(frame([(1, "a"), (2, "b")])).collect())
    second = {r.doc_id: (r.keep_id, r.kept) for r in index.deduplicate(frame([(3, "a "), (4, "c"), (5, "c")])).collect()}
    assert second == {3: (1, False), 4: (4, True), 5: (4, False)}
    assert index.rows().count() == 3 and index.rows().select("digest").distinct().count() == 3
    assert index.deduplicate(frame([])).count() == 0
    index.close()


def test_a_batch_that_is_run_again_keeps_its_rows(spark):
    """A job that fails after its batch was appended loses nothing when it is run again."""
    index = DigestIndex(spark, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    first, second = frame([(1, "a"), (2, "b"), (7, "a")]), frame([(3, "a "), (4, "c")])
    verdict = lambda df, **k: sorted((r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(df, **k).collect())
    want = verdict(first)
    assert want == [(1, 1, True), (2, 2, True), (7, 1, False)] and verdict(first) == want
    later = verdict(second, batch="nightly")
    assert later == [(3, 1, False), (4, 4, True)] and verdict(second, batch="nightly") == later and verdict(first) == want
    assert index.rows().count() == 3
    index.close()


def test_batches_against_brute_force(spark):
    import random

    rng = random.Random(4)
    index, seen = DigestIndex(spark, buckets=4), {}
    for batch in range(4):
        rows = [(batch * 100 + i, rng.choice("abcdefgh") + rng.choice(["", " ", "  "]) + rng.choice(["", "x", "y"]) if rng.random() < 0.9 else None) for i in range(25)] if batch != 2 else []
        rows = [(i, t) for i, t in rows if t is not None] + ([(batch * 100 + 90, None)] if rows else [])
        groups = {}
        for i, t in rows:
            groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        want = {}
        for key, members in groups.items():
            best = min(members)[1]
            keep = seen.get(key, best)
            want |= {i: (keep, len(members), key not in seen and i == best) for _, i in members}
        assert got == want
        seen |= {k: min(m)[1] for k, m in groups.items() if k not in seen}
    assert index.rows().count() == len(seen)
    index.close()


def test_the_index_decides_and_leaves_no_table(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(i, f"text {i // 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sum(r.kept for r in exact_dedup(docs).collect()) == 20
    assert {t.name for t in spark.catalog.listTables()} == before
    # Without the anti-join against the index, digests of both halves would be there twice.
    monkeypatch.setattr(DigestIndex, "new", lambda self, groups: groups)
    assert exact_dedup(docs).count() > 40


def test_kept_rows(spark):
    schema = "_0 string, doc_id bigint, text string, _gone_id int, digest string, kept string"
    rows = [(1, "a b"), (2, "ab"), (2, "c"), (3, "c"), (None, "d"), (None, "d "), (None, "e"), (5, "f "), (5, "f"), (5, "g"), (6, None), (7, ""), (8, "x" * 100_000), (9, "h"), (9, "h")]
    out = kept_rows(spark.createDataFrame([("clash", i, t, k, "clash", "clash") for k, (i, t) in enumerate(rows)], schema))
    assert out.columns == ["_0", "doc_id", "text", "_gone_id", "digest", "kept"]
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=repr)
    assert got == sorted([(1, "a b"), (2, "c"), (None, "d "), (None, "e"), (5, "f "), (5, "g"), (6, None), (8, "x" * 100_000), (9, "h")], key=repr)
    assert kept_rows(spark.createDataFrame([], schema)).count() == 0
