import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from atomflow.llm import bpe_chunks
from atomflow.llm.bpe_chunks import ChunkedBpe, cut_points, encode_documents
from atomflow.llm.matrices import best_fit_decreasing, packed_matrices, position_ids, read_matrices, write_matrices
from atomflow.llm.op5 import pack_documents
from atomflow.llm.packing import _dominating, best_fit, intervals, plan, reduced
from atomflow.llm.tokens import ByteBpe, Memory, library

BYTE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = ["a", "B", "é", " ", " ", "\n", "\t", "'s", "1", "\xa0", "\x85", " ", "\x1c", "!", "日", "ß", "́", "\r", "<|endoftext|>", "word "]


def samples(n, length=40, seed=1):
    rng = random.Random(seed)
    fixed = [None, "", " ", "  ", "a  b", "\n a", " <|endoftext|> b<|startoftext|>", "don't we'll", "x" * 30_000, "I’m “q” — x", "a　 b"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_byte_bpe_equals_the_library():
    encoder, lib = ByteBpe(BYTE, memory=50), library(BYTE)
    for t in samples(1500):
        assert encoder.encode(t) == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


@pytest.mark.parametrize("mean", [4, 64])
def test_chunks_agree_with_whole_texts(mean):
    encoder, lib = ChunkedBpe(WORDS, mean=mean, words=100, chunks=20), library(WORDS)
    texts = samples(1000)
    encoder.meet(texts[:60])
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert encoder.encode(t) == (len(ids), " ".join(map(str, ids)).encode(), lib.decode(ids, skip_special_tokens=False).encode()), repr(t)


def test_shared_passages_are_encoded_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000))
    encoder = ChunkedBpe(WORDS, mean=64)
    encoder.encode("first words " + passage)
    n = encoder.encoded_chunks
    encoder.encode("quite another beginning " + passage)
    assert encoder.encoded_chunks - n <= 4 < n
    data = passage.encode()
    assert cut_points(data, 64)[-1] == len(data)


def test_joins_are_repaired_until_they_agree(monkeypatch):
    """Every join is encoded again; where a neighbour's ids don't agree, the window grows, and in the end the whole text is encoded."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    lib = library(WORDS)
    want = lib.encode(text, add_special_tokens=False).ids
    encoder = ChunkedBpe(WORDS, mean=64)
    assert encoder.encode(text)[0] == len(want) and encoder.repaired > 50 and encoder.widened == 0
    # Wrong ids beside the joins, as a tokenizer would give that looks beyond white space: all windows of one word disagree.
    wrong = ChunkedBpe(WORDS, mean=64)
    real = wrong._chunk

    def other(data):
        chunk = real(data)
        if chunk:
            chunk.first = chunk.last = [1, 2, 3]
        return chunk

    wrong.chunks.make = other
    assert wrong.encode(text)[1] == " ".join(map(str, want)).encode() and wrong.widened > 50
    monkeypatch.setattr(bpe_chunks, "between", lambda ids, before, after: None)
    assert ChunkedBpe(WORDS, mean=64).encode(text)[1] == " ".join(map(str, want)).encode()


def test_chunks_are_bounded():
    data = ("日本" * 400_000).encode()
    ends = cut_points(data)
    assert max(b - a for a, b in zip([0, *ends], ends)) <= bpe_chunks.LONGEST + 3 and ends[-1] == len(data)
    assert all(data[:e].decode() is not None for e in ends[:50])
    assert cut_points(b"x" * 200_000, 64)[-1] == 200_000 and len(cut_points(b"x" * 200_000)) >= 6


def test_memory_is_bounded():
    m = Memory(lambda k: k + 1, 10)
    assert [m[i % 37] for i in range(500)] == [i % 37 + 1 for i in range(500)]
    assert len(m) <= 10 and len(m.old) <= 10


def test_memory_is_bounded_in_bytes():
    m = Memory(lambda k: k.encode(), 10**6, limit=1 << 20)
    for i in range(3000):
        assert m[str(i) * 300] == (str(i) * 300).encode()
        assert m.held <= 1 << 20
    assert m["y" * 200_000] and "y" * 200_000 not in m and len(m) + len(m.old) < 1000


def test_text_without_spaces_is_not_remembered_whole():
    encoder, lib = ByteBpe(BYTE), library(BYTE)
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(8000))
        ids = encoder.encode(t)
    assert ids == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() and encoder.memory.held <= 48 << 20


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        ByteBpe(WORDS)
    with pytest.raises(ValueError):
        ChunkedBpe(BYTE)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, piece int")


def test_encode_documents(spark):
    lib, texts = library(WORDS), samples(50)
    for r in encode_documents(frame(spark, texts), WORDS).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, lib.decode(ids, skip_special_tokens=False))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert encode_documents(frame(spark, []), WORDS).count() == 0


def test_packing_of_documents(spark):
    lib = library(BYTE)
    texts = samples(60, 200) + ["long text " * 3000, "x y " * 511, "x y " * 511]
    rows = pack_documents(frame(spark, texts)).collect()
    docs, rows_by = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        rows_by.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(docs[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    for parts in rows_by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(rows_by) <= -(-total // 1024) + 2
    assert pack_documents(frame(spark, [])).count() == 0


def test_packing_with_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "one two"), (None, "one two"), (3, "x " * 3000), (3, "x " * 3000), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], "doc_id bigint, text string, length int, piece int, _salt string, sequence_id int")
    out = pack_documents(docs).collect()
    lib = library(BYTE)
    want = sorted(((i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows), key=repr)
    got = [(r.doc_id, r.length) for r in out if r.piece == 0 and r.length <= 3]
    assert sorted(got, key=repr) == [x for x in want if x[1] <= 3]
    assert sum(r.length for r in out) == sum(n for _, n in want) and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    matrices = packed_matrices(docs, BYTE, capacity=512).collect()
    assert sum(r.n_tokens for r in matrices) == sum(n for _, n in want) and sum(r.doc_ids.count(None) for r in matrices) == 2


def test_plan_uses_up_the_histogram_and_is_near_the_bound():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100, 1024])
        items = [rng.randint(1, rng.choice([capacity, capacity // 2 + 1])) for _ in range(rng.choice([1, 5, 300, 3000]))]
        counts = {x: items.count(x) for x in set(items)}
        found = plan(counts, capacity)
        assert all(sum(row) <= capacity for _, row, _ in found)
        assert sorted(x for n, row, _ in found for x in row * n) == sorted(items)
        assert sum(n for n, _, _ in found) <= len(best_fit_decreasing(items, capacity)) * 1.01 + 1
        places = {}
        for x, lo, hi, row0, q, at in intervals(found):
            for number in range(lo, hi):
                places.setdefault(row0 + (number - lo) // q, []).append((at + (number - lo) % q * x, x))
        for parts in places.values():
            at = 0
            for offset, x in sorted(parts):
                assert offset == at
                at += x
            assert at <= capacity


def test_exact_pairs_are_fixed():
    found = plan({6: 2, 4: 2, 7: 1, 3: 1}, 10)
    assert sorted(row for n, row, how in found for _ in range(n) if how == "fixed") == [(6, 4), (6, 4), (7, 3)]


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_of_equal_lengths_is_best_fit():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([7, 20, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        rows = best_fit({x: items.count(x) for x in set(items)}, capacity)
        assert sorted(x for n, row in rows for x in row * n) == sorted(items)
        assert all(sum(row) <= capacity for _, row in rows)
        assert sum(n for n, _ in rows) == brute_best_fit(items, capacity)


def fewest_rows(items, capacity):
    """The fewest rows, by trying everything."""
    best = [len(items)]

    def put(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({*rooms}):
            if r >= items[at]:
                rest = list(rooms)
                rest.remove(r)
                put(at + 1, [*rest, r - items[at]])
        put(at + 1, [*rooms, capacity - items[at]])

    items = sorted(items, reverse=True)
    put(0, [])
    return best[0]


def test_reduction_is_optimal_and_runs_until_no_rule_fires():
    """Fixed sets never cost a row against the best packing; the remainder is what no rule settles, packed by best fit."""
    rng = random.Random(12)
    for _ in range(300):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = reduced({x: items.count(x) for x in set(items)}, capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sorted([x for n, row in fixed for x in row * n] + left) == sorted(items)
        assert sum(n for n, _ in fixed) + fewest_rows(left, capacity) == fewest_rows(items, capacity), (items, capacity, fixed)
        for x in rest:
            others = rest | {x: rest[x] - 1}
            assert _dominating(x, capacity - x, others, sorted(y for y, n in others.items() if n)) is None
        found = plan({x: items.count(x) for x in set(items)}, capacity)
        how = [h for _, _, h in found]
        assert how == sorted(how, reverse=True) and sum(n for n, _, h in found if h == "best fit") == brute_best_fit(left, capacity)


def test_tree_packs_as_well_as_best_fit():
    rng = random.Random(4)
    for _ in range(100):
        capacity = rng.choice([7, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        rows = best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= capacity for r in rows)
        assert len(rows) == brute_best_fit(lengths, capacity)


def test_matrices_lose_nothing(spark):
    lib, texts = library(BYTE), [*samples(80, 200), "long text " * 3000]
    got = {}
    rows = packed_matrices(frame(spark, texts), BYTE, capacity=256, block=1000).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        assert r.position_resets == r.cu_seqlens[:-1] and [i for i, p in enumerate(position_ids(r.cu_seqlens)) if p == 0] == r.position_resets
        for i, (a, b) in enumerate(zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True)):
            got.setdefault(r.doc_ids[i], []).append((r.starts[i], ids[a:b].tolist()))
    for i, t in enumerate(texts):
        assert [x for _, p in sorted(got[i]) for x in p] == [*lib.encode(t or "", add_special_tokens=False).ids, 50256]
    assert packed_matrices(frame(spark, []), BYTE).count() == 0


def test_matrices_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    packed = packed_matrices(frame(spark, ["one two three " * 50, "", None, "four"]), BYTE, capacity=64)
    write_matrices(packed, path)
    back = read_matrices(spark, path)
    assert back.columns == packed.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, packed.collect()))


def test_matrices_of_the_query_are_written(spark, tmp_path, monkeypatch):
    from atomflow.llm import op8

    frame(spark, ["one two", "three"]).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(op8, "fresh_path", lambda spark, label: f"file://{tmp_path}/out")
    rows = op8.op8_token_matrices(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, rows)) and rows


def test_latin_words_need_no_call_of_the_library_each():
    """Words that the merge loop takes get the library's ids, and only others and windows go through the library."""
    lib = library(WORDS)
    chars = [c for c in map(chr, range(0x21, 0x180)) if c not in "\x7fİ" and not 0x80 <= ord(c) <= 0xA0]
    rng = random.Random(5)
    words = ["".join(rng.choices(chars, k=rng.randint(1, 12))) for _ in range(3000)]
    words += ["It's", "we'LL", "'re's", "x²½9", "naïve", "ŉſß", "a_b", "</w>", "\u00adx", "ŒUVRE"]
    odd = ["İx", "\u1e9e", "e\u0301", "a\xa0b", "<|endoftext|>", "x<|startoftext|>y", "q\x01z", "日本", "Σας", "\u023a", "x\x85"]
    encoder = ChunkedBpe(WORDS, mean=64)
    for text in (" ".join(words), " ".join(words[:50] + odd + words[50:90]), "\n".join(odd)):
        want = lib.encode(text, add_special_tokens=False).ids
        encoder.meet([text])
        assert encoder.encode(text)[1] == " ".join(map(str, want)).encode()
    assert encoder.latin.encode_all(words) == [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert not any(encoder.latin.takes(w) for w in odd)
    calls = []
    encoder = ChunkedBpe(WORDS, mean=64)
    inner, encoder.tokenizer = encoder.tokenizer, type("Counting", (), {"encode_batch_fast": lambda self, texts, **k: calls.extend(texts) or inner.encode_batch_fast(texts, **k)})()
    encoder.meet([" ".join(words + ["日本"])])
    assert calls == ["日本"]
