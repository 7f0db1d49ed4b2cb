"""Metric trees over whole-number points, built by the anchors hierarchy, and their assignment to
the entries of a codebook.

Building: an anchor owns the points nearest to it; the next anchor is the furthest point of the
widest anchor, and takes from each other anchor only points that lie further from it than half way.
Square-root many anchors are merged from the middle up, always the two that fit the smallest ball,
and each anchor's points are parted in the same way from the middle down.  Every ball caches the
sum and the number of its points.

Assignment: a ball inherits the entries that its parent could not rule out.  An entry is ruled out
if it is further from the ball's centre than the nearest one by more than twice the radius; when
one entry is left it owns the ball with its cached sum and count, else its children go on, and the
points of leaves are compared with what is left.  All squared distances that decide are exact
whole numbers; balls are ruled by square roots with a margin, so ties reach the exact comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Components are bounded so that squared distances of up to 64 of them are exact in 64 bits.
MOST = 1 << 27


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squares, products and their sums over a row are exact as doubles."""
    top = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    return 4 * top * top * a.shape[1] < 1 << 52


@dataclass
class Tree:
    """Points in the order of the tree; balls from the root on, a parent before its children."""

    order: np.ndarray  # number of each point before sorting
    points: np.ndarray
    start: np.ndarray  # of each ball: its points are start to stop
    stop: np.ndarray
    left: np.ndarray  # its children, -1 for leaves
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray  # sum of its points


def _anchors(x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchor owns each point, and the anchors' points."""
    pivots = [0]
    owner = np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(pivots) < many:
        new = int(far.argmax())
        if far[new] == 0:
            break
        gap = np.sqrt(((x[pivots] - x[new]) ** 2).sum(1))
        can = np.flatnonzero(far > gap[owner] / 2)  # others are nearer to their own anchor
        d = np.sqrt(((x[can] - x[new]) ** 2).sum(1))
        won = d < far[can]
        owner[can[won]], far[can[won]] = len(pivots), d[won]
        pivots.append(new)
    return owner, np.array(pivots)


def _merged(centres: np.ndarray, radii: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to merge from the middle up; the k-th pair becomes number len(centres) + k."""
    n = len(centres)
    c, r, w = centres.copy(), radii.copy(), sizes.astype(float)
    names, out = list(range(n)), []
    apart = np.sqrt(np.maximum(0, (c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T))
    ball = np.maximum((apart + r[:, None] + r) / 2, np.maximum(r[:, None], r))
    np.fill_diagonal(ball, np.inf)
    for k in range(n - 1):
        i, j = sorted(divmod(int(ball.argmin()), n))
        out.append((names[i], names[j]))
        c[i] = (c[i] * w[i] + c[j] * w[j]) / (w[i] + w[j])
        r[i], w[i], names[i] = ball[i, j], w[i] + w[j], n + k
        ball[j] = ball[:, j] = np.inf
        alive = np.isfinite(ball[i])
        alive[i] = False
        if alive.any():
            d = np.sqrt(((c[alive] - c[i]) ** 2).sum(1))
            ball[i, alive] = ball[alive, i] = np.maximum((d + r[i] + r[alive]) / 2, np.maximum(r[i], r[alive]))
    return out


def build(x: np.ndarray, leaf: int = 24) -> Tree:
    """The tree of the rows of ``x``, whole numbers below ``MOST``; balls of at most ``leaf`` points,
    or of equal points, are leaves."""
    balls: list[list] = []  # points, left, right

    def grow(at: np.ndarray) -> int:
        me = len(balls)
        balls.append([at, -1, -1])
        here = x[at].astype(float)
        if len(at) <= leaf:
            return me
        owner, pivots = _anchors(here, int(np.ceil(np.sqrt(len(at)))))
        many = len(pivots)
        if many == 1:
            return me
        by = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by], np.arange(many + 1))
        parts = [by[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        means = np.stack([here[p].mean(0) for p in parts])
        radii = np.array([np.sqrt(((here[p] - m) ** 2).sum(1)).max() for p, m in zip(parts, means, strict=True)])
        pairs = _merged(means, radii, np.diff(cuts))

        def place(name: int, slot: int | None) -> int:
            """Lay down the ball of a merged pair (in ``slot`` if it is the root) or of an anchor."""
            if name < many:
                return grow(at[parts[name]])
            if slot is None:
                slot = len(balls)
                balls.append([None, -1, -1])
            a, b = pairs[name - many]
            balls[slot][1] = one = place(a, None)
            balls[slot][2] = two = place(b, None)
            balls[slot][0] = np.concatenate([balls[one][0], balls[two][0]])
            return slot

        place(2 * many - 2, me)
        return me

    x = np.asarray(x, np.int64)
    width = x.shape[1]
    if len(x):
        grow(np.arange(len(x)))
    order = balls[0][0] if balls else np.zeros(0, np.int64)
    n = len(balls)
    left, right = (np.array([b[k] for b in balls], np.int64) for k in (1, 2))
    start, stop = np.zeros(n, np.int64), np.array([len(b[0]) for b in balls], np.int64)
    for k in range(n):  # a parent's points are those of its left child, then those of its right
        if left[k] >= 0:
            start[left[k]], start[right[k]] = start[k], start[k] + len(balls[left[k]][0])
    stop += start
    points = x[order]
    sums = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points, axis=0)])
    total = sums[stop] - sums[start] if n else np.zeros((0, width), np.int64)
    centre = np.floor_divide(total, np.maximum(stop - start, 1)[:, None])
    radius = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(start, stop, centre, strict=True)])
    return Tree(order, points, start, stop, left, right, centre, radius, total)


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group, and the place within it, of each member of groups of these sizes."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _leaf_codes(tree: Tree, balls: np.ndarray, lists: list[np.ndarray], entries: np.ndarray, codes: np.ndarray, most_pairs: int) -> None:
    """Nearest entry of each point of the leaves ``balls`` among their lists, lowest index first."""
    if _small(tree.points, entries):
        x, e = tree.points.astype(float), entries.astype(float)
        norms = (e * e).sum(1)
        for ball, some in zip(balls.tolist(), lists, strict=True):  # a point's own square decides nothing
            a, b = tree.start[ball], tree.stop[ball]
            codes[a:b] = some[(norms[some] - 2 * (x[a:b] @ e[some].T)).argmin(1)]
        return
    sizes, choices = tree.stop[balls] - tree.start[balls], np.array([len(c) for c in lists], np.int64)
    ends = np.cumsum(sizes * choices)
    at = 0
    while at < len(balls):  # some leaves at a time, so that memory is bounded
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_pairs, side="right")))
        leaf, place = _ragged(sizes[at:stop])
        points = tree.start[balls[at:stop]][leaf] + place
        of, choice = _ragged(choices[at:stop][leaf])
        flat = np.concatenate(lists[at:stop])
        firsts = np.cumsum(choices[at:stop]) - choices[at:stop]
        entry = flat[firsts[leaf][of] + choice]
        d = ((tree.points[points][of] - entries[entry]) ** 2).sum(1)
        begin = np.flatnonzero(choice == 0)
        hit = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, begin), np.diff(np.append(begin, len(d)))))
        hit = hit[np.unique(of[hit], return_index=True)[1]]  # lists ascend, so the first is the lowest
        codes[points] = entry[hit]
        at = stop


def assign(tree: Tree, entries: np.ndarray, most_pairs: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each point in the tree's order (ties to the lower index), and for each entry
    the number and the sum of its points; balls owned as a whole add what they cache."""
    codes = np.zeros(len(tree.points), np.int64)
    n, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    if not len(tree.points):
        return codes, n, sums
    balls, sizes, flat = np.zeros(1, np.int64), np.array([len(entries)]), np.arange(len(entries))
    leaves, lists = [], []
    while balls.size:
        of, _ = _ragged(sizes)
        d = np.sqrt(((tree.centre[balls][of] - entries[flat]) ** 2).sum(1).astype(float))
        begin = np.cumsum(sizes) - sizes
        bound = (np.minimum.reduceat(d, begin) + 2 * tree.radius[balls]) * (1 + 1e-9) + 1e-6
        stays = d <= bound[of]
        sizes, flat = np.bincount(of[stays], minlength=len(balls)), flat[stays]
        cuts = np.append(0, np.cumsum(sizes))
        whole, leaf = sizes == 1, tree.left[balls] < 0
        for k in np.flatnonzero(whole):
            ball, entry = balls[k], flat[cuts[k]]
            codes[tree.start[ball] : tree.stop[ball]] = entry
            n[entry] += tree.stop[ball] - tree.start[ball]
            sums[entry] += tree.total[ball]
        ends = np.flatnonzero(leaf & ~whole)
        leaves.append(balls[ends])
        lists += [flat[cuts[k] : cuts[k + 1]] for k in ends]
        on = np.flatnonzero(~leaf & ~whole)
        of, place = _ragged(sizes[on])
        inherited = flat[cuts[on][of] + place]
        balls, sizes, flat = np.concatenate([tree.left[balls[on]], tree.right[balls[on]]]), np.tile(sizes[on], 2), np.tile(inherited, 2)
    balls = np.concatenate(leaves)
    if balls.size:
        _leaf_codes(tree, balls, lists, entries, codes, most_pairs)
        leaf, place = _ragged(tree.stop[balls] - tree.start[balls])
        points = tree.start[balls][leaf] + place
        np.add.at(n, codes[points], 1)
        np.add.at(sums, codes[points], tree.points[points])
    return codes, n, sums
