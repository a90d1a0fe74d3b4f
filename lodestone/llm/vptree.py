"""Exact links within a Hamming radius by vantage-point trees over 64-bit fingerprints (NumPy side).

Two fingerprints within the radius differ in at most half of it (rounded down) in one of their halves. So there are two trees,
whose distances are those of the low and of the high half and whose links are that much shorter: the border that a link may
cross is thin, and few points lie on it. What a leaf compares are whole fingerprints.

A node holds a vantage point v and a radius mu: points with d(v, p) <= mu are inside, the others outside. By the triangle
inequality two linked points on different sides both lie within the link's length r of the border, so the outside points with
d <= mu + r are also given to the inside subtree, as guests. A guest goes to every subtree that may hold a partner; a point
has one home leaf in a tree. Every link is thus found in a leaf that is the home of one end and has the other end as home or guest.
"""

from __future__ import annotations

import numpy as np

#: Tree nodes: (vantage, mu, inside, outside); a leaf is its number as an int.
Tree = "int | tuple[int, int, Tree, Tree]"
HALVES = (0xFFFFFFFF, 0xFFFFFFFF << 32)
BLOCK, PART, SMALL = 256, 4096, 600
#: Comparisons that cost as much as one more row to be routed, about.
ROW = 500


def reach(radius: int) -> int:
    """How far linked points may be apart in the half in which they are closer."""
    return radius // len(HALVES)


def distance(points: np.ndarray, v: int, half: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(v)) & np.uint64(half))


def best_split(homes: np.ndarray, guests: np.ndarray, half: int, r: int, tries: np.ndarray) -> tuple[float, float, int, int]:
    """comparisons, guests made, vantage point and mu of the cheapest split of a node by one of `tries`."""
    best = (np.inf, 0.0, 0, 0)
    for v in tries:
        ch, cg = (np.cumsum(np.bincount(distance(x, v, half), minlength=33)).astype(float) for x in (homes, guests))
        mu = np.arange(32)
        up, low = np.minimum(mu + r, 32), mu - r
        inside, border, gin = ch[mu], ch[up] - ch[mu], cg[up]
        gout = len(guests) - np.where(low >= 0, cg[np.maximum(low, 0)], 0)
        outside = len(homes) - inside
        work = inside * (inside / 2 + border + gin) + outside * (outside / 2 + gout)
        work[(inside == 0) | (outside == 0)] = np.inf
        k = int(work.argmin())
        if work[k] < best[0]:
            best = (float(work[k]), float(border[k] + gin[k] + gout[k] - len(guests)), int(v), k)
    return best


def fit(sample: np.ndarray, n: int, leaf: int, radius: int, half: int, seed: int = 7):
    """A tree over a sample of n points whose leaves are the homes of `leaf` points or fewer, unless the guests that a split
    would make cost more than it saves. Only the tree's balance depends on the sample, no result does."""
    rng, scale, r, leaves = np.random.default_rng(seed), n / max(1, len(sample)), reach(radius), 0

    def grow(homes: np.ndarray, guests: np.ndarray):
        nonlocal leaves
        if len(homes) * scale > leaf and len(homes) >= 8:
            work, made, v, mu = best_split(homes, guests, half, r, rng.choice(homes, min(16, len(homes)), replace=False))
            now = len(homes) * (len(homes) / 2 + len(guests))
            if (now - work) * scale**2 > ROW * made * scale:
                dh, dg = distance(homes, v, half), distance(guests, v, half)
                inside = grow(homes[dh <= mu], np.concatenate([homes[(dh > mu) & (dh <= mu + r)], guests[dg <= mu + r]]))
                return (v, mu, inside, grow(homes[dh > mu], guests[dg + r > mu]))
        leaves += 1
        return leaves - 1

    return grow(np.sort(sample), sample[:0])


def route(tree, points: np.ndarray, radius: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """leaf, index into points, home or guest: one row for each leaf that a point goes to."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    r = reach(radius)

    def down(node, homes: np.ndarray, guests: np.ndarray) -> None:
        if not len(homes) and not len(guests):
            return
        if isinstance(node, int):
            both = np.concatenate([homes, guests])
            out.append((np.full(len(both), node), both, np.arange(len(both)) < len(homes)))
            return
        v, mu, inside, outside = node
        dh, dg = distance(points[homes], v, half), distance(points[guests], v, half)
        down(inside, homes[dh <= mu], np.concatenate([homes[(dh > mu) & (dh <= mu + r)], guests[dg <= mu + r]]))
        down(outside, homes[dh > mu], guests[dg + r > mu])

    down(tree, np.arange(len(points)), np.arange(0))
    empty = np.arange(0)
    return tuple(np.concatenate([x[i] for x in out]) if out else empty for i in range(3))  # type: ignore[return-value]


class Groups:
    """Labels of the points of one leaf, joined as links are found."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        differ = la != lb
        if not differ.any():
            return
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in np.unique(np.stack([la[differ], lb[differ]], 1), axis=0).tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in list(up):
            to[x] = root(x)
        self.label = to[self.label]


def leaf_links(points: np.ndarray, home: np.ndarray, radius: int, half: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of points that join the leaf's points as all links with a home end would: fewer pairs than points; and the number of
    comparisons. A local tree narrows the leaf down further. Pairs that are joined already are not compared again, so a dense
    group costs about as much as its size."""
    groups, r, rng, compared = Groups(len(points)), reach(radius), np.random.default_rng(7), 0

    def compare(block: np.ndarray, others: np.ndarray) -> None:
        nonlocal compared
        own = points[block][:, None]
        for at in range(0, len(others), PART):
            part = others[at : at + PART]
            compared += len(block) * len(part)
            i, j = np.nonzero(np.bitwise_count(own ^ points[part][None, :]) <= radius)
            groups.join(block[i], part[j])

    def flat(homes: np.ndarray, guests: np.ndarray) -> None:
        everything, left = np.concatenate([homes, guests]), homes
        while len(left):
            labels = groups.label[everything]
            values, counts = np.unique(labels, return_counts=True)
            big = values[counts.argmax()]
            own = left[groups.label[left] == big]
            if counts.max() >= 4 * BLOCK and len(own):  # a dense group: only against what isn't in it
                rest = everything[labels != big]
                for at in range(0, len(own), BLOCK):
                    compare(own[at : at + BLOCK], rest)
                left = left[~np.isin(left, own)]
            else:
                block, left = left[:BLOCK], left[BLOCK:]
                compare(block, np.concatenate([block, left, guests]))

    def down(homes: np.ndarray, guests: np.ndarray) -> None:
        if len(homes) <= SMALL:
            return flat(homes, guests)
        work, _, v, mu = best_split(points[homes], points[guests], half, r, points[rng.choice(homes, 4, replace=False)])
        if work > 0.9 * len(homes) * (len(homes) / 2 + len(guests)):
            return flat(homes, guests)
        dh, dg = distance(points[homes], v, half), distance(points[guests], v, half)
        down(homes[dh <= mu], np.concatenate([homes[(dh > mu) & (dh <= mu + r)], guests[dg <= mu + r]]))
        down(homes[dh > mu], guests[dg + r > mu])

    down(np.flatnonzero(home), np.flatnonzero(~home))
    linked = np.flatnonzero(groups.label != np.arange(len(points)))
    return linked, groups.label[linked], compared
