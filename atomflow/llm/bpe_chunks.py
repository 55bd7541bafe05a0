"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over 16 bytes cuts every text where the content says so, so that passages which
documents share fall into the same chunks wherever they stand. The words inside a chunk, between its first and its last white space, are encoded
once by each Python worker, while the chunk stays in the worker's memory. A cut may run through a word, so at every join of chunks a window
is encoded again: what is broken there and a word on either side. Its ids must begin and end with those that the neighbouring chunks have for
these words; then what lies between is the repair. If they don't agree, the window takes more words on either side, and when a
chunk has no more of them, the whole text is encoded at once. Chunks that are short of words are part of the window.
Windows go through the tokenizers library, many in one call. So do words that aren't in memory, unless they are Latin ones and the file
has the normaliser and pattern that ``LatinWords`` knows: it gives the same ids by tiktoken's merge loop, for many words at once.

Chunks can be encoded apart only by tokenizers that drop white space and never look beyond it, such as ``word_bpe_49k``; others are refused.
Decoding joins the tokens with spaces, as the library does for a file without a decoder; files with one are refused too.

Reuse is per worker, not across the cluster. An exchange would have to bring the texts, or the ids of shared chunks back to their documents, through a
shuffle by document: 1.1 times the check tables (operator 7's shuffle of the same texts: 561 MB for 0.51 GB), and the digests and ids of
shared chunks on top, of 1.5 times allowed in all; about one chunk in ten of these tables is shared, and its words are in memory anyway.

Defined results: a null text is an empty one, with 0 tokens and the digests of the empty string. Texts of any length are taken whole; chunks have
at most ``LONGEST`` bytes, longer stretches without a cut are cut there. Ids may be null or repeat: there is one row for each document. Only the columns
for id and text are read, so others may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomflow.llm.text import SPACES, mix, powers, sliced
from atomflow.llm.tokens import Memory, library, loaded

WINDOW = 16
MEAN = 512
#: Bytes of a chunk at most.
LONGEST = 64 * MEAN
CHUNKS = 20_000
#: Bytes of remembered words in each of two generations.
WORDS_BYTES = 80 << 20
#: Words that are encoded as one text.
TOGETHER = 4096
_LATIN = re.compile("[ -~\xa1-\u012f\u0131-\u017f]*")
_NORMALIZER = ["NFC", ("Replace", {"Regex": "\\s+"}, " "), "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "\x01"
_BASE = 0x9E3779B97F4A7C15
_WHITE = re.compile(rb"[\t-\r ]")
_WORD = re.compile(rb"[^\t-\r ]+")


def cut_points(data: bytes, mean: int = MEAN) -> list[int]:
    """Where chunks end: behind windows whose rolling hash is 0 modulo mean, never inside a character."""
    n = len(data)
    out: list[int] = []
    step = 1 << 20
    for at in range(0, max(n - WINDOW, 0), step):
        a = np.frombuffer(data, np.uint8, min(step + WINDOW, n - at), at)
        p, q = powers(_BASE, len(a) + 1)
        total = np.empty(len(a) + 1, np.uint64)
        total[0] = 0
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=total[1:])
        k = len(a) - WINDOW
        rolling = mix((total[WINDOW : WINDOW + k] - total[:k]) * q[:k])
        out += (np.flatnonzero(rolling % np.uint64(mean) == 0) + (at + WINDOW)).tolist()
    ends, last = [], 0
    for x in [*out, n]:
        while x < n and data[x] & 0xC0 == 0x80:
            x += 1
        while x - last > LONGEST:
            last += LONGEST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if last < x < n:
            ends.append(x)
            last = x
    return [*ends, n]


class LatinWords:
    """Ids of words of printable characters up to U+017F, for files with the normaliser and pattern of ``word_bpe_49k``.

    None of these characters changes or combines under NFC, and their lower case is one of them. Words are joined by spaces, and a mark takes the place
    of the suffix behind every piece. With the mark, a piece's last byte makes a token before any merge of the file is tried.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, vocab = file["model"], file["model"].get("vocab", {})
        plain = [tuple(n[k] for k in ("type", "pattern", "content")) if n["type"] == "Replace" else n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        pre = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split = {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True}
        known = plain == _NORMALIZER and pre[0] == split and [(p["type"], p["add_prefix_space"], p["use_regex"]) for p in pre[1:]] == [("ByteLevel", False, False)]
        options = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")}
        suffix = model.get("end_of_word_suffix")
        if not known or model["type"] != "BPE" or any(options.values()) or not suffix:
            raise ValueError(f"{path} has another normaliser, pattern or model")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        spelled = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte_of = {c: b for b, c in spelled.items()}

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return bytes(byte_of[c] for c in body) + (_END.encode() if body != token else b"")

        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        names = [*spelled.values(), *(c + suffix for c in spelled.values()), *(a + b for a, b in merged)]
        order = [bytes([b]) for b in spelled] + [raw(n) for n in names[256:]]
        ranks = {token: i for i, token in enumerate(order)}
        if len(ranks) < len(order):
            raise ValueError(f"{path} makes a token by several merges")
        self.ids = [vocab[n] for n in names]
        self.space = ranks[b" "]
        self.special = [t["content"] for t in file["added_tokens"]]
        self.merges = tiktoken.Encoding("own", pat_str=f"[^ {_END}]+{_END}| ", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(0x21, 0x180))}
        letters, digits = ("".join(c for c, kind in kinds.items() if kind == k) for k in "LN")
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^ {letters}{digits}]+")

    def takes(self, words: str) -> bool:
        """Whether all words of a text, with spaces between them, are of this kind."""
        return _LATIN.fullmatch(words) is not None and not any(s in words for s in self.special)

    def encode_all(self, words: list[str]) -> list[list[int]]:
        """The ids of each of these words, which are not empty."""
        ranks = self.merges.encode_ordinary(self.pieces.sub(rf"\g<0>{_END}", " ".join(words).lower()))
        ids, at, out = [self.ids[r] for r in ranks], 0, []
        for end in [*(i for i, r in enumerate(ranks) if r == self.space), len(ids)]:
            out.append(ids[at:end])
            at = end + 1
        return out


class Chunk:
    """A chunk with inner words: what stands before the first white space and after the last one, and the words between."""

    __slots__ = ("data", "body", "head", "tail", "first", "last", "left", "right")

    def __init__(self, data: bytes, entries: list[tuple[bytes, bytes]], words: list[bytes], head: int, tail: int):
        self.data, self.head, self.tail = data, head, tail
        self.body = b" ".join([e[0] for e in entries if e[0]]), b" ".join([e[1] for e in entries if e[0]])
        # The ids of the outer inner words, and where these words begin and end.
        self.first, self.last = numbers(entries[:1]), numbers(entries[-1:])
        self.right, self.left = data.index(words[0], head) + len(words[0]), data.rindex(words[-1], 0, tail)


def numbers(entries: list[tuple[bytes, bytes]]) -> list[int]:
    """The ids of entries."""
    return [int(x) for e in entries for x in e[0].split()]


class Join:
    """What lies between two chunks, or a chunk and the text's end: broken bytes with the words on either side."""

    __slots__ = ("before", "broken", "after")

    def __init__(self, before: Chunk | None, broken: bytes, after: Chunk | None):
        self.before, self.broken, self.after = before, broken, after

    def window(self) -> bytes:
        left = self.before.data[self.before.left :] if self.before else b""
        return left + self.broken + (self.after.data[: self.after.right] if self.after else b"")

    def wider(self, words: int) -> tuple[bytes, list[bytes], list[bytes]] | None:
        """The window with so many words on either side, and these words; None if a chunk has fewer."""
        left, right, one, two = b"", b"", [], []
        if self.before:
            inner = list(_WORD.finditer(self.before.data, self.before.head, self.before.tail))
            if len(inner) < words:
                return None
            left, one = self.before.data[inner[-words].start() :], [m[0] for m in inner[-words:]]
        if self.after:
            inner = list(_WORD.finditer(self.after.data, self.after.head, self.after.tail))
            if len(inner) < words:
                return None
            right, two = self.after.data[: inner[words - 1].end()], [m[0] for m in inner[:words]]
        return left + self.broken + right, one, two


def between(ids: list[int], before: Sequence[int], after: Sequence[int]) -> list[int] | None:
    """The ids between those at the beginning and at the end, if they are there."""
    a, b = len(before), len(ids) - len(after)
    return ids[a:b] if a <= b and ids[:a] == list(before) and ids[b:] == list(after) else None


class ChunkedBpe:
    """Encoder of whole texts through shared chunks, for tokenizers that drop white space and have no decoder."""

    def __init__(self, path: str, mean: int = MEAN, words: int = 250_000, chunks: int = CHUNKS):
        self.tokenizer, self.mean = library(path), mean
        alone = [self._ids(x) for x in ("ab", "cd")]
        if self.tokenizer.decoder is not None or any(self._ids(f"ab{x}cd") != alone[0] + alone[1] for x in (" ", "  ", "\n", "\t ", "\r\n")):
            raise ValueError(f"{path} has a decoder or doesn't drop white space, so chunks can't be encoded apart")
        try:
            self.latin = LatinWords(path)
        except (KeyError, ValueError):  # another kind of file: all words go through the library
            self.latin = None
        self.words = Memory(self._word, words, limit=WORDS_BYTES, cost=lambda word, entry: 300 + len(word) + len(entry[0]) + len(entry[1]))
        self.chunks = Memory(self._chunk, chunks, cost=lambda data, chunk: 600 + len(data) + (len(chunk.body[0]) + len(chunk.body[1]) if chunk else 0))
        self.encoded_chunks = self.repaired = self.widened = 0
        self.single = {i: (str(i).encode(), s.encode()) for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        """The ids and their decoded form: without a decoder in its file, the library joins tokens with spaces."""
        if len(ids) == 1:
            return self.single[ids[0]]
        one = [self.single[i] for i in ids]
        return b" ".join([e[0] for e in one]), b" ".join([e[1] for e in one])

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        return self._entry(self._ids(word.decode()))

    def meet(self, texts: list[str | None]) -> None:
        """Encodes the words of some texts that aren't in memory, all at once."""
        new = [w for w in set(" ".join([t for t in texts if t]).encode().split()) if w not in self.words and w not in self.words.old]
        if len(new) > self.words.size // 2:
            return  # they would push each other out; each is encoded when it comes
        put, others = self.words.put, []
        for at in range(0, len(new), TOGETHER):
            group = new[at : at + TOGETHER]
            if self.latin and not self.latin.takes(b" ".join(group).decode()):
                others += [w for w in group if not self.latin.takes(w.decode())]
                group = [w for w in group if self.latin.takes(w.decode())]
            elif not self.latin:
                others += group
                group = []
            for w, ids in zip(group, self.latin.encode_all([w.decode() for w in group]) if group else [], strict=True):
                put(w, self._entry(ids))
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        for w, e in zip(others, encoded, strict=True):
            put(w, self._entry(e.ids))

    def _chunk(self, data: bytes) -> Chunk | bool:
        """The chunk with its inner words encoded, or False if it has none that give ids on either side."""
        self.encoded_chunks += 1
        first = _WHITE.search(data)
        if not first:
            return False
        tail = 1 + max(data.rfind(c) for c in (SPACES[i : i + 1] for i in range(len(SPACES))))
        words = data[first.start() : tail].split()
        entries = [self.words[w] for w in words]
        if not words or not entries[0][0] or not entries[-1][0]:
            return False
        return Chunk(data, entries, words, first.start(), tail)

    def _parts(self, data: bytes) -> list[Join | Chunk]:
        """The chunks of a text with inner words, and the joins around them."""
        parts: list[Join | Chunk] = []
        before, broken, at = None, b"", 0
        for end in cut_points(data, self.mean):
            chunk = self.chunks[data[at:end]]
            if chunk:
                parts += [Join(before, broken, chunk), chunk]
                before, broken = chunk, b""
            else:
                broken += data[at:end]
            at = end
        return [*parts, Join(before, broken, None)]

    def encode_all(self, texts: list[str | None]) -> list[tuple[int, bytes, bytes]]:
        """Of each text the number of ids, the decimal ids joined by spaces, and the decoded text."""
        split = [self._parts((t or "").encode()) for t in texts]
        joins = [p for parts in split for p in parts if isinstance(p, Join)]
        encoded = self.tokenizer.encode_batch_fast([j.window().decode() for j in joins], add_special_tokens=False)
        repairs = {id(j): self._repair(j, e.ids) for j, e in zip(joins, encoded, strict=True)}
        out = []
        for text, parts in zip(texts, split, strict=True):
            entries = [p.body if isinstance(p, Chunk) else repairs[id(p)] for p in parts]
            if None in entries:  # no window agreed
                entries = [self._entry(self._ids(text or ""))]
            ids = b" ".join([e[0] for e in entries if e[0]])
            out.append(((ids.count(b" ") + 1 if ids else 0), ids, b" ".join([e[1] for e in entries if e[0]])))
        return out

    def encode(self, text: str | None) -> tuple[int, bytes, bytes]:
        return self.encode_all([text])[0]

    def _repair(self, join: Join, ids: list[int]) -> tuple[bytes, bytes] | None:
        """The ids between two chunks, from a window that agrees with both; None if none does."""
        self.repaired += 1
        found = between(ids, join.before.last if join.before else (), join.after.first if join.after else ())
        words = 1
        while found is None:
            self.widened += 1
            words *= 2
            wider = join.wider(words)
            if wider is None:
                return None
            window, one, two = wider
            found = between(self._ids(window.decode()), *(numbers([self.words[w] for w in side]) for side in (one, two)))
        return self._entry(found)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, mean: int, full: bool) -> Iterator[pa.RecordBatch]:
    encoder = loaded(ChunkedBpe, tokenizer, mean)
    for batch in batches:
        texts, rows = batch.column(1).to_pylist(), []
        for lo, hi in sliced(texts, 1 << 20):
            encoder.meet(texts[lo:hi])
            rows += encoder.encode_all(texts[lo:hi])
        cols = [
            batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if full:
            cols += [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())), pa.array([r[2].decode() for r in rows], pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(cols, names)


def encode_documents(docs: DataFrame, tokenizer: str, full: bool = True, mean: int = MEAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; with full also ids and decoded."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return rows.mapInArrow(lambda it: _encoded(it, tokenizer, mean, full), schema)
