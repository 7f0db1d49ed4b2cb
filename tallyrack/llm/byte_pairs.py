"""Byte-level byte-pair encoding and decoding through a queue of merge ranks.

A text is cut into words by the vocabulary's pattern.  The bytes of a word form a doubly linked
list; each merge rank has a bucket of the list positions whose pair has that rank, and a
hierarchical bitmap over the ranks (256 to a word) tells the lowest rank with a bucket by finding
first set bits.  Within a bucket the leftmost position comes first.
Entries whose pair has changed since are skipped.  A word of n bytes takes n steps of constant
work besides the order within buckets, so words of a megabyte are no trouble.

Many short words that were not met before go through one queue together (``merge_many``): words do
not touch, so the lowest bucket serves all words that have a pair there at once.

What is a letter, a number or white space is asked of the library itself (``classes``), so words
are cut as its version of Unicode has it.

Nulls count as empty texts (no ids, empty decoded text).  Every row is encoded by itself:
repeated rows and ids keep their rows.  Only id and text are read, so further columns of any name
are no concern.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from .common import file_bytes, map_rows, once, quoted, tokenizer_path

#: Characters of the longest words that are kept and merged together.
SHORT = 48


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines())}


@cache
def classes(points: int = 0x110000) -> dict[str, str]:
    r"""Bodies of character classes for ``\p{L}``, ``\p{N}`` and ``\s``, as the library has them: its
    own pattern matching is asked for every code point below ``points``."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    text = "".join(chr(p) for p in range(points) if not 0xD800 <= p < 0xE000)
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        asked = tiktoken.Encoding("asked", pat_str=name, mergeable_ranks=single, special_tokens={})
        found = np.frombuffer(bytes(asked.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
        cuts = np.flatnonzero(np.diff(found) != 1)
        first, last = found[np.concatenate([[0], cuts + 1])], found[np.concatenate([cuts, [len(found) - 1]])]
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))
    return out


def cutting_pattern(published: str, points: int = 0x110000) -> str:
    r"""The published pattern in terms of ``classes``: each of ``\p{L}``, ``\p{N}``, ``\s`` and ``\S``
    is spelt out, alone or inside a class; for texts of code points below ``points`` only."""
    known, deep = classes(points), False

    def spelt(m: re.Match) -> str:
        nonlocal deep
        name = m.group()
        if name in "[]":
            deep = name == "["
            return name
        if name == r"\S":
            return f"[^{known[chr(92) + 's']}]"
        return known[name] if deep else f"[{known[name]}]"

    return re.sub(r"\\p\{[LN]\}|\\[sS]|\[|\]", spelt, published)


class RankQueue:
    """Buckets of positions by rank under a bitmap of two levels: a bit of ``words[k]`` for each of
    the 256 ranks from 256 k on, and a bit of the top for each word that is not zero.

    It holds nothing between two words, so it is made once.  ``BytePairs.merge`` works on its
    parts in place, as calls would cost more than the steps."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words = [0] * (ranks + 255 >> 8)
        self.bit = [1 << k for k in range(max(256, len(self.words)))]


class Remembered(dict):
    """The ids of words as bytes, made where they are missing; short words are kept.  When this
    newer memory is full, it becomes the older.  Words that are kept are looked up without a step
    of Python."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= SHORT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class BytePairs:
    """Encodes and decodes by the ranks of a vocabulary.

    ``cut`` cuts any text, ``cut_ascii`` and ``cut_plane`` those of code points below 0x80 and
    0x10000, which they do faster."""

    def __init__(self, blob: bytes, cut: str, cut_ascii: str, cache_words: int = 150_000, cut_plane: str | None = None):
        self.ranks = read_ranks(blob)
        self.longest = max(map(len, self.ranks))
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("not a byte-level vocabulary: a byte has no rank")
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.cut, self.cut_ascii, self.cut_plane = (re.compile(p).findall for p in (cut, cut_ascii, cut_plane or cut))
        self.known = Remembered(self._word, cache_words)
        self.ready: dict[str, bytes] = {}  # words of the texts at hand, merged together
        self._decoding()
        self._joint()

    def _decoding(self) -> None:
        """The tokens one after the other, and the place and size of each rank there (-1: no such rank)."""
        count = len(self.queue.buckets)
        self.start, self.size = np.full(count, -1), np.zeros(count, np.int64)
        at = 0
        for token, rank in self.ranks.items():
            self.start[rank], self.size[rank] = at, len(token)
            at += len(token)
        self.flat = np.frombuffer(b"".join(self.ranks), np.uint8)

    def _joint(self) -> None:
        """What ``merge_many`` looks up: the rank of two bytes, and of two symbols by a sorted key."""
        get = self.ranks.get
        self.none = len(self.queue.words) << 8  # stands for the rank of what is no token
        self.single = np.array([get(bytes([b])) for b in range(256)])
        self.double = np.full((256, 256), self.none)
        found = {}
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.double[token[0], token[1]] = rank
            for k in range(1, len(token)):
                if (x := get(token[:k])) is not None and (y := get(token[k:])) is not None:
                    found[x * (self.none + 1) + y] = rank
        self.keys = np.array([*sorted(found), np.iinfo(np.int64).max])
        self.made = np.array([*map(found.__getitem__, self.keys[:-1].tolist()), self.none])

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, whatever its length."""
        ranks, longest, n = self.ranks, self.longest, len(word)
        get = ranks.get
        if n <= longest and (whole := get(word)) is not None:
            return [whole]
        buckets, words, bit, top = self.queue.buckets, self.queue.words, self.queue.bit, 0
        after = list(range(1, n + 2))  # where the symbol that starts here ends
        before = list(range(-1, n))
        pair = [-1] * n  # rank of the pair that starts here, while it stands
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                pair[i] = r
                bucket = buckets[r]
                if not bucket:
                    words[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
                bucket.append(i)  # positions come in order, so the bucket is a heap
        while top:
            k = (top & -top).bit_length() - 1
            held = words[k]
            low = held & -held
            r = k << 8 | low.bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                words[k] = held = held ^ low
                if not held:
                    top ^= bit[k]
            if pair[i] != r:
                continue  # stale
            j = after[i]
            after[i] = end = after[j]
            pair[i] = pair[j] = -1
            h = before[i]
            if end < n:
                before[end] = i
                spans = ((i, after[end]), (h, end)) if h >= 0 else ((i, after[end]),)
            else:
                spans = ((h, end),) if h >= 0 else ()
            for start, stop in spans:  # the new pairs on either side
                r = get(word[start:stop]) if stop - start <= longest else None
                if r is None:
                    pair[start] = -1
                    continue
                pair[start] = r
                bucket = buckets[r]
                if not bucket:
                    words[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
                heappush(bucket, start)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 4 bytes each) of many short words, through one queue.

        A bucket holds the positions of 256 ranks, and a bitmap over the buckets tells the lowest
        that has any by its first set bit.  There each word takes its lowest rank, leftmost first:
        what ``merge`` would take next."""
        none, size = self.none, np.array(list(map(len, words)), np.int64)
        # a place that pairs with nothing stands before all words and after each
        data = np.frombuffer(b"\0" + b"".join([w + b"\0" for w in words]), np.uint8)
        if len(data) > 1 << 27:
            raise ValueError("too many bytes for one queue")
        ends = size.cumsum() + np.arange(1, len(words) + 1)
        word = np.concatenate([[0], np.arange(len(words)).repeat(size + 1)])
        symbol = self.single[data]
        symbol[0] = symbol[ends] = none
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        pair = np.append(self.double[data[:-1], data[1:]], none)
        pair[0] = pair[ends] = pair[ends - 1] = none
        buckets: list[list[np.ndarray]] = [[] for _ in self.queue.words]
        entering, top = np.flatnonzero(pair < none), 0
        while True:
            if len(entering):
                held = (pair[entering] >> 8).astype(np.uint16)
                order = held.argsort(kind="stable")
                entering, held = entering[order], held[order]
                cuts = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(held)]
                for k, a, b in zip(held[cuts[:-1]].tolist(), cuts, cuts[1:]):
                    buckets[k].append(entering[a:b])
                    top |= 1 << k
            if not top:
                break
            k = (top & -top).bit_length() - 1
            at = np.concatenate(buckets[k])
            at = at[pair[at] >> 8 == k]  # others are stale
            key = (word[at] << 8 | pair[at] & 255) << 27 | at
            key.sort()
            at, of = key & (1 << 27) - 1, key >> 35
            lead = np.append(True, of[1:] != of[:-1])[: len(at)]
            i, rest = at[lead], at[~lead]
            buckets[k] = [rest] if len(rest) else []
            if not len(rest):
                top ^= 1 << k
            symbol[i] = pair[i]
            j = after[i]
            symbol[j], pair[j] = -1, none
            after[i] = end = after[j]
            before[end] = i
            changed = np.concatenate([i, before[i]])  # the new pairs on either side
            key = symbol[changed] * (none + 1) + symbol[after[changed]]
            found = self.keys.searchsorted(key)
            pair[changed] = made = np.where(self.keys[found] == key, self.made[found], none)
            entering = changed[made < none]
        symbol[0] = symbol[ends] = -1
        stands = symbol >= 0
        ids, stops = symbol[stands].astype("<u4").tobytes(), (4 * stands.cumsum()[ends]).tolist()
        whole = map(self.ranks.get, words)
        return [ids[a:b] if r is None else r.to_bytes(4, "little") for r, a, b in zip(whole, [0, *stops], stops)]

    def _word(self, word: str) -> bytes:
        got = self.ready.pop(word, None)
        return np.array(self.merge(word.encode()), "<u4").tobytes() if got is None else got

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.cut_ascii(text)
        # in UTF-8, code points from 0x10000 on begin with a byte from 0xF0 on
        return (self.cut if np.frombuffer(text.encode(), np.uint8).max() >= 0xF0 else self.cut_plane)(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self._words(text))), "<u4")

    def encode_many(self, texts: list[str], at_once: int = 500_000, least: int = 1000) -> Iterator[np.ndarray]:
        """As ``encode`` of each text.  Of texts with ``at_once`` words together, or as many words of a
        longer text, short words that are not known are merged together, if there are ``least``."""
        cut, count = [], 0
        for text in texts:
            words = self._words(text)
            if cut and count + len(words) > at_once:
                yield from self._together(cut, least)
                cut, count = [], 0
            if len(words) > at_once:
                parts = (words[k : k + at_once] for k in range(0, len(words), at_once))
                yield np.concatenate([ids for part in parts for ids in self._together([part], least)])
            else:
                cut.append(words)
                count += len(words)
        yield from self._together(cut, least)

    def _together(self, cut: list[list[str]], least: int) -> Iterator[np.ndarray]:
        self._make_ready(set().union(*cut), least)
        for words in cut:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
        self.ready = {}

    def _make_ready(self, words: set[str], least: int, at_once: int = 1 << 19) -> None:
        known, older = self.known, self.known.older
        new = [w for w in words if len(w) <= SHORT and w not in known and w not in older]
        if len(new) < least:
            return
        data = [w.encode() for w in new]
        part = np.cumsum(list(map(len, data))) // at_once  # by bytes, which bounds the memory
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(new)]
        for a, b in zip(cuts, cuts[1:]):
            self.ready.update(zip(new[a:b], self.merge_many(data[a:b]), strict=True))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self._bytes(ids[k : k + 65536]) for k in range(0, len(ids), 65536)])

    def _bytes(self, ids: np.ndarray) -> bytes:
        if ids.min() < 0 or ids.max() >= len(self.start) or (start := self.start[ids]).min() < 0:
            raise KeyError("an id that the vocabulary lacks")
        size = self.size[ids]
        skipped = start - size.cumsum() + size  # from a byte's place among these to that in ``flat``
        return self.flat[np.arange(size.sum()) + skipped.repeat(size)].tobytes()


def _coder(vocabulary_path: str | None, pattern: str | None):
    """A function that gives tasks their coder, made once a worker."""
    import public_tokenizers

    blob = file_bytes(vocabulary_path or tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    cuts = [cutting_pattern(pattern or public_tokenizers.PATTERN, points) for points in (0x110000, 0x80, 0x10000)]
    key = ("byte pairs", zlib.crc32(blob), *cuts)
    return lambda: once(key, lambda: BytePairs(blob, cuts[0], cuts[1], cut_plane=cuts[2]))


def encode_documents(
    df: DataFrame, vocabulary_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``df``: its id, the ids of its text, and what they decode to (UTF-8)."""
    coder = _coder(vocabulary_path, pattern)

    def make():
        pairs = coder()

        def work(columns):
            ids = list(pairs.encode_many([t or "" for t in columns[1]]))
            return {id_col: columns[0], "ids": ids, "decoded": [pairs.decode(i).decode() for i in ids]}

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df, make, [id_col, text_col], f"{quoted(id_col)} {kind}, ids array<bigint>, decoded string")


def decode_ids(df: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``df``: its id and the bytes that its array of ids stands for (null: none).

    An id that the vocabulary lacks raises an error; ids that are not valid UTF-8 together are no
    trouble, as bytes are returned."""
    coder = _coder(vocabulary_path, None)

    def make():
        pairs = coder()
        return lambda columns: {id_col: columns[0], "decoded": [pairs.decode(np.array(i or [], np.int64)) for i in columns[1]]}

    kind = dict(df.dtypes)[id_col]
    return map_rows(df, make, [id_col, ids_col], f"{quoted(id_col)} {kind}, decoded binary")


def encoding_digests(
    df: DataFrame, vocabulary_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As ``encode_documents``, reduced inside the task: doc_id, number of ids, SHA-256 of the ids
    (little-endian unsigned 32-bit) and of the decoded bytes."""
    coder = _coder(vocabulary_path, pattern)

    def make():
        pairs = coder()

        def work(columns):
            out = {"doc_id": columns[0], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in pairs.encode_many([t or "" for t in columns[1]]):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(pairs.decode(ids)).hexdigest())
            return out

        return work

    kind = dict(df.dtypes)[id_col]
    return map_rows(df, make, [id_col, text_col], f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
