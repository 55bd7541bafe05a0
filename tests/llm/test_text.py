import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from atomflow.llm import text as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\xa0é", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 4))
def test_hashes_follow_words(raw, k):
    raw = [t.encode() if t is not None else None for t in raw]
    words, bounds = T.hash_words(raw)
    own = [WORD.findall(t or b"") for t in raw]
    assert np.diff(bounds).tolist() == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    assert len(words) == len(flat)
    by_word = {}
    for w, h in zip(flat, words.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    sets = T.shingle_sets(raw, k)
    for ws, s in zip(own, sets, strict=True):
        want = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
        assert len(s) == len(want)


def test_blocks_do_not_change_hashes(monkeypatch):
    raw = [b"one two  three" * 50, b"", None, b"x" * 500 + b" y"]
    a, b = T.hash_words(raw), None
    runs = T.hash_runs(a[0], 3)
    monkeypatch.setattr(T, "BLOCK", 16)
    b = T.hash_words(raw)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert (T.hash_runs(b[0], 3) == runs).all()


def test_short_texts_keep_lengths_apart():
    one, two = T.shingle_sets([b"a", b"a a"], 3)
    assert one[0] != two[0]
