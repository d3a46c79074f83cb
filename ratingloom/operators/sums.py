"""Sums over the shared items of every two users, in arrays, and the correlation that they give."""

from __future__ import annotations

import numpy as np

#: Items are taken together in arrays of users by items up to this size.
CHUNK = 256
#: An item goes through arrays where one of so many pairs of users meet over it.
DENSE = 300
#: Correlations of so many users are found together.
ROWS = 64
#: Pairs of users whose sums are found one by one are gathered so many at a time.
PAIRS = 4096
#: Whole numbers in doubles are exact below this.
EXACT = 2.0**52
#: And in single floats below this.
EXACT_SINGLE = 2.0**24
#: Powers of x and y in the six sums of a pair.
POWERS = ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1))

#: Users, items, values and weights of ratings.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Users of the left and the right side.
Pairs = tuple[np.ndarray, np.ndarray]


def pair_sums(left: Entries, right: Entries, shape: tuple[int, int], n_items: int) -> list[np.ndarray]:
    """Six sums for each pair of the two sides: count, x, y, squares and products over shared items.

    Every meeting counts by the product of its two weights. Values and weights are whole numbers. Items that many
    rate go through products of arrays of users by items, others pair by pair.
    """
    parts = []
    for who, item, x, weight in (left, right):
        order = np.argsort(item, kind="stable")
        x, weight = x[order], weight[order]
        starts = np.searchsorted(item[order], np.arange(n_items + 1))
        parts.append((who[order], (weight, weight * x, weight * x * x), starts))
    (u, wu, at), (v, wv, bt) = parts
    met = np.diff(at) * np.diff(bt)
    sums: list[np.ndarray] = []
    dense = np.flatnonzero(met * DENSE > shape[0] * shape[1])
    for a in range(0, len(dense), CHUNK):
        chosen, arrays = dense[a : a + CHUNK], []
        for who, moments, starts, size in ((u, wu, at, shape[0]), (v, wv, bt, shape[1])):
            rows = spans(starts, chosen)
            cell = who[rows] * len(chosen) + np.repeat(np.arange(len(chosen)), np.diff(starts)[chosen])
            arrays.append([np.bincount(cell, m[rows], size * len(chosen)).reshape(size, -1) for m in moments])
        products = [_product(arrays[0][i], arrays[1][j]).astype(np.float64, copy=False) for i, j in POWERS]
        sums = [np.add(s, p, out=s) for s, p in zip(sums, products)] if sums else products
    sums = sums or [np.zeros(shape) for _ in POWERS]
    sparse = np.flatnonzero((met > 0) & (met * DENSE <= shape[0] * shape[1]))
    ends = np.cumsum(met[sparse])
    while len(sparse):
        take = max(1, int(np.searchsorted(ends, 2_000_000, side="right")))
        here, sparse = sparse[:take], sparse[take:]
        ends = ends[take:] - ends[take - 1]
        # every rater of an item on the one side beside every one on the other
        per = np.repeat(np.diff(bt)[here], np.diff(at)[here])
        one = np.repeat(spans(at, here), per)
        begin = np.repeat(np.repeat(bt[here], np.diff(at)[here]), per)
        two = begin + np.arange(len(one)) - np.repeat(np.cumsum(per) - per, per)
        cell = u[one] * shape[1] + v[two]
        for total, (i, j) in zip(sums, POWERS):
            total += np.bincount(cell, wu[i][one] * wv[j][two], shape[0] * shape[1]).reshape(shape)
    return sums


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of arrays of users by items, in single floats where no sum leaves their whole numbers."""
    if np.abs(left).sum(axis=1).max(initial=0.0) * np.abs(right).max(initial=0.0) < EXACT_SINGLE:
        left, right = left.astype(np.float32), right.astype(np.float32)
    return left @ right.T


def shared_items(left: Entries, right: Entries, shape: tuple[int, int], n_items: int) -> np.ndarray:
    """Numbers of shared items of every two users, whose ratings of an item are one each."""
    rated = []
    for (who, item, _, _), size in zip((left, right), shape):
        has = np.zeros((size, n_items), np.float32)
        has[who, item] = 1.0
        rated.append(has)
    return rated[0] @ rated[1].T


def sums_of_pairs(left: Entries, right: Entries, shape: tuple[int, int], n_items: int, pairs: Pairs) -> list[np.ndarray]:
    """The six sums of :func:`pair_sums` of some pairs only, for no more items than go through arrays together."""
    arrays = _arrays(left, right, shape, n_items)
    sums = [np.empty(len(pairs[0])) for _ in POWERS]
    for at in range(0, len(pairs[0]), PAIRS):
        one, two = ([m[side[at : at + PAIRS]] for m in a] for a, side in zip(arrays, pairs))
        for total, (i, j) in zip(sums, POWERS):
            np.einsum("ij,ij->i", one[i], two[j], out=total[at : at + PAIRS])
    return sums


def products_of_pairs(
    left: Entries, right: Entries, shape: tuple[int, int], n_items: int, pairs: Pairs
) -> list[np.ndarray]:
    """The same from the products of all pairs, for more pairs than are worth a sum each."""
    arrays = _arrays(left, right, shape, n_items)
    at = pairs[0] * shape[1] + pairs[1]
    return [_product(arrays[0][i], arrays[1][j]).ravel()[at].astype(np.float64, copy=False) for i, j in POWERS]


def _arrays(left: Entries, right: Entries, shape: tuple[int, int], n_items: int) -> list[list[np.ndarray]]:
    """Users by items on either side: weights, and these times x and its square."""
    arrays = []
    for (who, item, x, weight), size in zip((left, right), shape):
        cell, moments = who * n_items + item, (weight, weight * x, weight * x * x)
        arrays.append([np.bincount(cell, m, size * n_items).reshape(size, n_items) for m in moments])
    return arrays


def spans(starts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Places of all entries of ``items``, those of each between its start and the next."""
    sizes = starts[items + 1] - starts[items]
    return np.repeat(starts[items] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def correlation(sums: list[np.ndarray], min_common: int) -> np.ndarray:
    """Pearson correlation of every two users, or of pairs; 0 where it is not positive or they share too little."""
    found = np.empty(sums[0].shape)
    # some rows at a time, which stay in the cache
    step = ROWS if found.ndim == 2 else ROWS * PAIRS
    for at in range(0, len(found), step):
        part = [s[at : at + step] for s in sums]
        value = pearson(part)
        found[at : at + step] = np.where((part[0] >= min_common) & (value > 0), value, 0.0)
    return found


def pearson(sums: list[np.ndarray]) -> np.ndarray:
    """Pearson correlation, NaN without variance on either side."""
    n, sx, sy, sxx, syy, sxy = _whole(sums)
    covariance, left, right = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    with np.errstate(divide="ignore", invalid="ignore"):
        found = covariance / np.sqrt(left.astype(np.float64, copy=False) * right.astype(np.float64, copy=False))
    found[(left <= 0) | (right <= 0)] = np.nan
    return found


def cosine(sums: list[np.ndarray]) -> np.ndarray:
    """Cosine, NaN where the ratings of either side are all 0."""
    _, _, _, sxx, syy, sxy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((sxx > 0) & (syy > 0), sxy / np.sqrt(sxx * syy), np.nan)


def _whole(sums: list[np.ndarray]) -> list[np.ndarray]:
    """Sums whose products are exact: doubles where all products are small, else longs."""
    n, _, _, sxx, syy, _ = sums
    # of the products, n * sxx or n * syy is the largest
    if n.size and n.max() * max(sxx.max(), syy.max()) >= EXACT:
        return [np.rint(s).astype(np.int64) for s in sums]
    return sums
