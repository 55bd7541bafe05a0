"""The pipeline and the queries over the smallest tables; every stage against what it must keep."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from atomflow.llm.scratch import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't there")


@pytest.mark.parametrize("name", ["op1_chat_format", "op3_minhash", "op6_near_vectors", "op7_substring_dedup", "op9_warc", "op10_exact_dedup"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "exact dedup":
            assert {"".join(t.split()) for t in after.values()} == {"".join(t.split()) for t in before.values()}
        if name == "substring dedup":
            assert set(after) == set(before)
        before = after
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(before)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


def test_every_stage_on_odd_documents(spark):
    """Null and repeated ids, null, empty and very long texts, ties, repeated rows and columns with the names that stages use inside."""
    schema = "_0 string, doc_id bigint, text string, rest string, n_chars bigint, _gone_id int, kept boolean, digest string, label int"
    passage = " ".join(f"w{i}" for i in range(60))
    own = lambda c: " ".join(f"{c}{i}" for i in range(100))
    near = " ".join(f"v{i}" for i in range(80))
    texts = [(1, "one two"), (1, "one  two"), (1, "one two"), (1, "three"), (None, "three "), (None, None), (None, ""), (2, None), (3, "z " * 60_000), (4, "z " * 60_000 + "z")]
    texts += [(5, f"{own('a')} {passage} b"), (6, f"{own('c')} {passage} d"), (None, f"{own('e')} {passage}"), (7, near), (8, near + " x"), (None, near + " y"), (8, "quite another text"), (9, "tie"), (10, "tie")]
    rows = [("c", i, t, "r", len(t or ""), k, True, "d", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        seen[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        assert all((r.rest, r.digest, r.kept) == ("r", "d", True) for r in docs.collect())
    assert seen["toxicity"] == sorted(texts, key=repr)
    exact = seen["exact dedup"]
    assert [t for i, t in exact if i == 1] == ["one  two"] and [i for i, t in exact if t and t.strip() == "three"] == [None]
    assert sum(not t for _, t in exact) == 1 and [i for i, t in exact if t == "tie"] == [9] and [i for i, t in exact if (t or "").startswith("z z")] == [3, 4]
    near_kept = seen["near dedup"]
    assert [i for i, t in near_kept if (t or "").startswith("z z")] == [3]
    assert [i for i, t in near_kept if (t or "").startswith("v0")] == [7] and (8, "quite another text") in near_kept
    assert sorted(t for i, t in seen["substring dedup"] if t and t[:2] in ("a0", "c0", "e0")) == [f"{own('a')} {passage} b", f"{own('c')} d", own("e")]
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in pieces) == len(seen["substring dedup"])
