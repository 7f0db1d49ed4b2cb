"""Order MinHash near-duplicates.

A text is the sequence of its five-word shingles.  Each shingle is labelled with its occurrence
(first, second, ...), so repeats count.  A sketch takes, for each of ``bands`` hash functions,
the ``take`` smallest labelled shingles and keeps them in the order they have in the text: two
texts share it if they have those shingles and in the same order, which edits keep and moved
passages break.
"""

from __future__ import annotations

import numpy as np

from .shingles import STEP, factors, mixed


def labelled(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shingles mixed with how often they have stood in their text before."""
    if not len(shingles):
        return shingles
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
    order = np.argsort(mixed(shingles + text * STEP), kind="stable")
    same = np.concatenate([[False], (shingles[order][1:] == shingles[order][:-1]) & (text[order][1:] == text[order][:-1])])
    if not same.any():
        return shingles
    place = np.arange(len(order))
    count = place - np.maximum.accumulate(np.where(same, 0, place))
    out = shingles.copy()
    out[order] = np.where(same, mixed(shingles[order] + count.astype(np.uint64) * STEP), shingles[order])
    return out


def sketches(shingles: np.ndarray, starts: np.ndarray, bands: int = 16, take: int = 3, seed: int = 4) -> np.ndarray:
    """A row of ``bands`` sketches for each text; texts without shingles have zeros."""
    counts = np.diff(starts)
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), bands), np.uint64)
    if not full.size:
        return out
    first, sizes = starts[full], counts[full]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    labels = labelled(shingles, starts)
    for band, factor in enumerate(factors(bands, seed)):
        values = mixed(labels * factor)
        places = np.empty((take, len(full)), np.int64)
        for k in range(take):
            least = np.minimum.reduceat(values, first)
            hits = np.flatnonzero(values == np.repeat(least, sizes))
            owner = np.searchsorted(first, hits, "right") - 1
            lead = np.concatenate([[True], owner[1:] != owner[:-1]])
            places[k] = hits[lead]
            values[hits[lead]] = top
        places.sort(axis=0)
        key = np.full(len(full), np.uint64(band + 1))
        for k in range(take):
            # a text of fewer shingles repeats a place
            fresh = labels[places[k]] if k == 0 else np.where(places[k] == places[k - 1], np.uint64(0), labels[places[k]])
            key = mixed(key * STEP + fresh)
        out[full, band] = key
    return out
