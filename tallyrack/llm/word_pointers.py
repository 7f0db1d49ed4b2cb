"""Word counts of Arrow text buffers by sorting pointers to word starts.

No string is made for a word until its run is counted: pointers into the buffer are sorted by a
multikey quicksort whose characters are eight bytes wide, and equal runs give the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What each byte is in a term: letters A-Z in lower case, 0 for what ends a term.
LETTERS = np.zeros(256, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
#: The first k of eight bytes.
FIRST = np.array([0, *[(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)]], np.uint64)


class Words:
    """The words of a buffer: where each starts, its length, and the number of its text."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        _, cuts, data = texts.buffers()
        cuts = np.frombuffer(cuts, "<i8", len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(data, np.uint8, cuts[-1] - cuts[0], cuts[0]) if data is not None and cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
        cuts = cuts - cuts[0]
        #: lower-case bytes of the terms, zeros between them, and room for a last pointer's bytes
        self.bytes = np.concatenate([LETTERS[raw], np.zeros(16, np.uint8)])
        inside = self.bytes[: len(raw)] != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # a word ends with its text, even where the next text goes on with a letter
        opens, closes = cuts[:-1][cuts[:-1] < len(raw)], cuts[1:][cuts[1:] > 0] - 1
        first[opens], last[closes] = inside[opens], inside[closes]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.text = np.searchsorted(cuts[1:], self.start, side="right")
        self._windows = np.lib.stride_tricks.sliding_window_view(self.bytes, 8)

    def keys(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of the words ``at``, from byte 8 * depth on; zeros behind their ends."""
        left = np.clip(self.length[at] - 8 * depth, 0, 8)
        places = np.where(left > 0, self.start[at] + 8 * depth, 0)
        return np.ascontiguousarray(self._windows[places]).view(">u8")[:, 0].astype(np.uint64) & FIRST[left]

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words ``at`` as strings."""
        length = self.length[at]
        ends = np.cumsum(length)
        cuts = np.concatenate([[0], ends]).astype("<i8")
        places = np.arange(cuts[-1]) + np.repeat(self.start[at] - cuts[:-1], length)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(self.bytes[places])).cast(pa.string())


def sorted_runs(words: Words, small: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words in the order of their bytes, and where each run of equal words starts.

    Multikey quicksort: a slice is parted into the words below, at and above the middle of some of
    its keys; those at it agree in eight bytes and go on with the next eight, or have ended and are
    a run.  Slices of at most ``small`` words are ordered key after key.  Words of a run stay in
    the order of the buffer.
    """
    parts, firsts = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    # words, their keys (None: not made yet) and depth; depth -1: a run
    todo: list[tuple[np.ndarray, np.ndarray | None, int]] = [(np.arange(len(words.start)), None, 0)]
    while todo:
        at, keys, depth = todo.pop()
        if not at.size:
            continue
        if depth < 0:
            parts.append(at)
            firsts.append(np.arange(at.size) == 0)
            continue
        if keys is None:
            keys = words.keys(at, depth)
        if at.size <= small:
            at, first = _order_small(words, at, keys, depth)
            parts.append(at)
            firsts.append(first)
            continue
        some = keys[:: max(1, at.size // 999)]
        middle = np.partition(some, some.size // 2)[some.size // 2]
        below, above = keys < middle, keys > middle
        todo.append((at[above], keys[above], depth))
        todo.append((at[~(below | above)], None, depth + 1 if int(middle) & 0xFF else -1))
        todo.append((at[below], keys[below], depth))
    return np.concatenate(parts), np.flatnonzero(np.concatenate(firsts))


def _order_small(words: Words, at: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The words in order, and which of them starts a run."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    going = (keys & np.uint64(0xFF)) != 0
    while True:
        going &= ~(first & np.append(first[1:], True))  # a word alone is a run, whatever follows
        which = np.flatnonzero(going)
        if not which.size:
            return at, first
        depth += 1
        run, keys = np.cumsum(first)[which], words.keys(at[which], depth)
        order = np.lexsort((keys, run))
        at[which], keys = at[which[order]], keys[order]
        first[which[1:]] |= keys[1:] != keys[:-1]
        going[which] = (keys & np.uint64(0xFF)) != 0


def counts(texts: pa.Array, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """For each word and each group of texts that has it: the word, the group, how often, in how
    many texts.  ``groups``: the group of each text, numbers from 0 on."""
    words = Words(texts)
    order, starts = sorted_runs(words)
    size = np.diff(np.append(starts, len(order)))
    run = np.repeat(np.arange(len(starts)), size)
    text = words.text[order]
    # words of a run are in the order of their texts, so those of one text stand together
    new = np.ones(len(order), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(order)))
    many = int(groups.max(initial=0)) + 1
    code, place, docs = np.unique(run[at] * many + groups[text[at]], return_inverse=True, return_counts=True)
    n = np.bincount(place, times, len(code)).astype(np.int64)
    terms = words.strings(order[starts]) if len(starts) else pa.array([], pa.string())
    return terms.take(pa.array(code // many)), code % many, n, docs
