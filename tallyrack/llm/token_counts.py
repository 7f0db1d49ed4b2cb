"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A text is cut at special strings (one token each) and by the vocabulary's word pattern; the
number of tokens of a word is its number of bytes minus its merges.  Counts of short words are
remembered within a task.

Nulls count as empty texts (0 bytes, 0 tokens).  Every row is counted by itself, so repeated
rows and ids keep their rows; only id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from .common import file_bytes, map_rows, once, tokenizer_path
from .stable_letters import outside as stable_outside
from .stable_letters import word_pattern

#: Fixed value: the published word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def merge_count(symbols: Sequence, rank: Callable) -> int:
    """How many symbols remain: the initial ones minus the merges; no identifiers are made.

    The agenda holds adjacent pairs of a doubly linked list; the best one (lowest rank, then
    leftmost) is popped, its symbols become one, and the pairs with its new neighbours enter.
    An entry whose symbols have changed since still holds if what stands there now merges to
    the same string; others are skipped.
    """
    n = len(symbols)
    if n < 2:
        return n
    part = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    agenda = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := rank(part[i], part[i + 1])) is not None]
    heapify(agenda)
    merges = 0
    while agenda:
        _, i, merged = heappop(agenda)
        j = after[i]
        if part[i] is None or j >= n or part[i] + part[j] != merged or rank(part[i], part[j]) is None:
            continue
        merges += 1
        part[i] = merged
        part[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(part[i], part[k])) is not None:
                heappush(agenda, (r, i, part[i] + part[k]))
        h = before[i]
        if h >= 0 and (r := rank(part[h], part[i])) is not None:
            heappush(agenda, (r, h, part[h] + part[i]))
    return n - merges


class TokenCounter:
    """Counts tokens as the vocabulary file's library does by default."""

    def __init__(self, blob: bytes, words: str, outside: str, cache_words: int = 300_000):
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not spec["normalizer"] and not spec["post_processor"] and not model.get("ignore_merges")
        if not plain or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level byte-pair vocabulary")
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in letters.items()}
        self.whole = whole = lambda s: b"".join([back[c] for c in s])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(whole(a), whole(b)): i for i, (a, b) in enumerate(pairs)}
        self.words, self.outside = re.compile(words).findall, re.compile(outside).search
        self.cut = Tokenizer.from_buffer(blob).pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take in their surroundings are not supported")
        self.special = special
        self.split = re.compile("|".join(map(re.escape, special))).split if special else None
        # when the newer memory of words is full, it becomes the older
        self.newer: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.cache_words = cache_words

    def _word(self, word: str) -> int:
        n = self.newer.get(word) or self.older.get(word)
        if n is None:
            rank, raw = self.rank, word.encode()
            n = merge_count([raw[i : i + 1] for i in range(len(raw))], lambda a, b: rank.get((a, b)))
        if len(word) <= 48 and word not in self.newer:
            if len(self.newer) >= self.cache_words:
                self.newer, self.older = {}, self.newer
            self.newer[word] = n
        return n

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            parts = self.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        # where tables of other Unicode versions could cut otherwise, the library cuts
        words = [self.whole(w).decode() for w, _ in self.cut(text)] if self.outside(text) else self.words(text)
        make = self._word
        return sum([n or make(w) for n, w in zip(map(self.newer.get, words), words, strict=True)])


def count_tokens(
    df: DataFrame, vocabulary_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``df``: doc_id, n_bytes, n_tokens and whether there are more than ``limit``."""
    blob = file_bytes(vocabulary_path or tokenizer_path("byte_bpe_50k.json"))
    words, outside, crc = word_pattern(WORDS), stable_outside(), zlib.crc32(blob)

    def make():
        counter = once(("token counts", crc, words, outside), lambda: TokenCounter(blob, words, outside))

        def work(columns):
            texts = [t or "" for t in columns[1]]
            n = [counter.count(t) for t in texts]
            return {"doc_id": columns[0], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df, make, [id_col, text_col], f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
