"""Encoders around public tokenizer files, with bounded memories of what they encoded.

``ByteBpe`` gives the ids of the tokenizers library for a byte-level BPE file. A text of Latin letters, digits and signs
goes through tiktoken's merge loop as a whole, which works on the same vocabulary and pattern and is
several times as fast. Any other text is cut in front of every space that follows a character other than white
space; the file's pre-tokeniser always breaks there and never looks back, so the ids of the
parts are the ids of the whole. Parts that occurred before come from memory; new ones of Latin text go
the first way, all others through the tokenizers library itself. So does every text with the special token's string.

A tokenizer's path is a parameter; its file must be at that path on every executor.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from atomflow.llm.text import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts in each of the two generations of an encoder's memory.
MEMORY = 200_000
#: Bytes in each of them.
MEMORY_BYTES = 48 << 20
_SPACE = re.compile("[\t-\r\x1c-\x20\x85\xa0  -     　] ")
_CUT = re.compile(r"(?<=\S) ")
_LATIN = re.compile("[\x00-ɏ]*")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _cost(key, value) -> int:
    """About how many bytes a remembered key and value take."""
    return 300 + sum(80 * len(x) if hasattr(x, "__len__") else 32 for x in (key, value))


class Memory(dict):
    """A dictionary of two generations: when the young one is full, by its entries or its bytes, it becomes the old one.

    Missing keys are looked up in the old generation, then made by ``make``. An entry that alone takes a large part of
    the bytes isn't remembered.
    """

    def __init__(self, make, size: int = MEMORY, limit: int = MEMORY_BYTES, cost=_cost):
        super().__init__()
        self.make, self.size, self.limit, self.cost, self.held, self.old = make, size, limit, cost, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        cost = self.cost(key, value)
        if cost > self.limit >> 6:
            return
        if len(self) >= self.size or self.held + cost > self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += cost


def library(path: str):
    """The tokenizers library's own encoder, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteBpe:
    """Byte-level BPE; ids come as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, memory: int = MEMORY):
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pre = file["pre_tokenizer"] or {}
        if file["normalizer"] or file["model"]["type"] != "BPE" or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path} isn't a byte-level BPE file without normaliser and prefix space")
        special_ids = {t["id"] for t in file["added_tokens"]}
        self.special = [t["content"] for t in file["added_tokens"]]
        self.size = max([*file["model"]["vocab"].values(), *special_ids]) + 1
        # The file spells bytes as printable characters: the printable Latin-1 ones as themselves, the rest from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in file["model"]["vocab"].items() if i not in special_ids}
        self.merges = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory = Memory(self._make, memory, cost=lambda part, ids: 200 + 2 * len(part) + len(ids))

    @property
    def tokenizer(self):
        """The tokenizers library's own encoder, loaded when it is first needed."""
        if self._library is None:
            self._library = library(self.path)
        return self._library

    def _make(self, part: str) -> bytes:
        if _LATIN.fullmatch(part) and not any(s in part for s in self.special):
            ids = self.merges.encode_ordinary(part)
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        if not text:
            return b""
        special = any(s in text for s in self.special)
        if not special and _LATIN.fullmatch(text):
            return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()
        if special:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = _CUT.split(text) if "  " in text or _SPACE.search(text) else text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        return b"".join([self.memory[p] for p in parts])

    def decode(self, ids: bytes) -> str:
        return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


_loaded: dict[tuple, object] = {}
CACHES.append(_loaded)


def loaded(kind, path: str, *args):
    """One encoder per Python worker."""
    key = (kind, path, *args)
    if key not in _loaded:
        _loaded[key] = kind(path, *args)
    return _loaded[key]
