"""Order statistics of one array: counts of later smaller and greater values, midranks, slopes by rank.

All are merges of sorted runs, n log n in time and linear in memory; nothing here makes pairs.
"""

from __future__ import annotations

import numpy as np


def dense(x: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct values."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def midranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 with the mean of ties."""
    place = dense(x)
    counts = np.bincount(place) if len(x) else np.zeros(0, np.int64)
    return (np.cumsum(counts) - (counts - 1) / 2)[place]


def _merged(z: np.ndarray, count):
    """Bottom-up merges of runs; ``count`` sees each level's left runs, right runs and the indices of the left ones."""
    n = len(z)
    size = 1 << max(n - 1, 0).bit_length()
    values = np.concatenate((z, np.full(size - n, n, np.int64)))  # the filling comes after all ranks
    index = np.arange(size, dtype=np.int64)
    width = 1
    while width < size:
        rows = size // (2 * width)
        shift = (np.arange(rows, dtype=np.int64) * (n + 1))[:, None]
        pairs, ids = values.reshape(rows, 2, width), index.reshape(rows, 2, width)
        count((pairs[:, 0] + shift).ravel(), (pairs[:, 1] + shift).ravel(), ids[:, 0].ravel(), np.repeat(np.arange(rows) * width, width), shift, pairs[:, 1])
        order = np.argsort(values.reshape(rows, 2 * width), axis=1, kind="stable")
        values = np.take_along_axis(values.reshape(rows, 2 * width), order, axis=1).ravel()
        index = np.take_along_axis(index.reshape(rows, 2 * width), order, axis=1).ravel()
        width *= 2


def later_smaller(z: np.ndarray) -> np.ndarray:
    """For each value of a dense ranking, how many later ones are smaller."""
    out = np.zeros(1 << max(len(z) - 1, 0).bit_length(), np.int64)

    def count(left, right, ids, base, shift, runs):
        out[ids] += np.searchsorted(right, left, "left") - base

    _merged(z, count)
    return out[: len(z)]


def later_greater(z: np.ndarray) -> np.ndarray:
    """For each value of a dense ranking, how many later ones are greater."""
    n = len(z)
    out = np.zeros(1 << max(n - 1, 0).bit_length(), np.int64)

    def count(left, right, ids, base, shift, runs):
        real = np.repeat((runs < n).sum(axis=1), runs.shape[1])
        out[ids] += np.maximum(real - (np.searchsorted(right, left, "right") - base), 0)

    _merged(z, count)
    return out[:n]


def inversions(z: np.ndarray) -> int:
    """Pairs in which the earlier value is greater."""
    return int(later_smaller(z).sum())


def tied_pairs(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns."""
    counts = np.unique(np.column_stack(columns), axis=0, return_counts=True)[1] if len(columns) > 1 else np.unique(columns[0], return_counts=True)[1]
    return int((counts * (counts - 1) // 2).sum())


def kendall_sum(t: np.ndarray, v: np.ndarray) -> tuple[int, int, int]:
    """Kendall's S, the pairs tied in t, and those tied in v."""
    n = len(t)
    by_t, by_v = tied_pairs(t), tied_pairs(v)
    falling = inversions(dense(v)[np.lexsort((v, t))])
    return n * (n - 1) // 2 - by_t - by_v + tied_pairs(t, v) - 2 * falling, by_t, by_v


def not_above(t: np.ndarray, v: np.ndarray, slope: float) -> int:
    """How many pairs (of rows with different t, in order of t) have at most this slope.

    The row after is not above the line through the row before: an inversion of v - slope * t, ties included.
    ``t`` and ``v`` are sorted by t.
    """
    w = v - slope * t
    order = np.lexsort((-w, t))
    z = dense(w)
    later = later_greater(z[order])
    n = len(t)
    # Within a run of equal t, descending order leaves no greater later value.
    return n * (n - 1) // 2 - tied_pairs(t) - int(later.sum())


def ranked_slopes(t: np.ndarray, v: np.ndarray, ranks: list[int], seed: int = 1) -> list[float]:
    """The pairwise slopes at the given places (from 0) of their order, found by counting, without making the pairs.

    A sample of pairs brackets a place, then the bracket shrinks by interpolation and halving; when few pairs are
    left inside they are listed and the right one is returned exactly.  Trial slopes stand a little beside any
    likely slope, so rounding cannot move a pair over them; where a bracket of that width still holds many
    pairs, they are one slope many times.
    """
    order = np.argsort(t, kind="stable")
    t, v = t[order].astype(float), v[order].astype(float)
    t, n = t - t.mean() if len(t) else t, len(t)
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, max(n, 1), (2, min(200_000, 20 * n + 1000))) if n else np.zeros((2, 0), int)
    apart = t[i] != t[j]
    guesses = np.sort((v[i][apart] - v[j][apart]) / (t[i][apart] - t[j][apart]))
    if not len(guesses):
        return [float("nan")] * len(ranks)
    limit = (v.max() - v.min()) / np.diff(np.unique(t)).min()
    total, few, scale = n * (n - 1) // 2 - tied_pairs(t), max(4 * n, 1000), max(float(np.abs(guesses).mean()), 1e-6 * limit) or 1.0

    def beside(m: float) -> float:
        return m + (1 + rng.random()) * 1e-9 * max(abs(m), scale)

    out = []
    for rank in ranks:
        low, high, below, upto = -2 * limit - 1.0, 2 * limit + 1.0, 0, total
        trials = [float(guesses[int(q * len(guesses))]) for q in (rank / total - 4 / len(guesses) ** 0.5, rank / total + 4 / len(guesses) ** 0.5) if 0 < q < 1]
        turn = 0
        while upto - below > few and high - low > 8e-9 * max(abs(low), abs(high), scale):
            share = (rank + 0.5 - below) / (upto - below) if turn % 2 == 0 else 0.5
            m = beside(trials.pop() if trials else low + (high - low) * share)
            turn += 1
            if low < m < high:
                count = not_above(t, v, m)
                low, below, high, upto = (m, count, high, upto) if count <= rank else (low, below, m, count)
        if upto - below > few:
            held = guesses[(guesses > low) & (guesses <= high)]
            out.append(float(held[len(held) // 2]) if len(held) else high)
            continue
        inside = np.sort(slopes_between(t, v, low, high))
        out.append(float(inside[min(rank - below, len(inside) - 1)]))
    return out


def slopes_between(t: np.ndarray, v: np.ndarray, low: float, high: float) -> np.ndarray:
    """All pairwise slopes in (low, high]: the pairs that change places between the orders of v - low * t and v - high * t.

    Rows sorted by the first order; a pair's members come in the other order in the second, so runs of the
    merge list exactly these pairs (``t`` sorted).
    """
    n = len(t)
    # At or above the low line rising, not above the high line: greater w_low later, not greater w_high later.
    a, b = v - low * t, v - high * t
    order = np.lexsort((t, a))  # ascending w_low, ties by time
    z = dense(b)[order]
    found = []
    size = 1 << max(n - 1, 0).bit_length()
    values = np.concatenate((z, np.full(size - n, n, np.int64)))
    index = np.concatenate((order, np.full(size - n, -1, np.int64)))
    width = 1
    while width < size:
        rows = size // (2 * width)
        shift = (np.arange(rows, dtype=np.int64) * (n + 1))[:, None]
        pairs, ids = values.reshape(rows, 2, width), index.reshape(rows, 2, width)
        left, right = (pairs[:, 0] + shift).ravel(), (pairs[:, 1] + shift).ravel()
        base = np.repeat(np.arange(rows) * width, width)
        many = np.where(ids[:, 0].ravel() >= 0, np.searchsorted(right, left, "right") - base, 0)  # w_high of the later one is not greater
        if many.any():
            first = np.repeat(ids[:, 0].ravel(), many)
            place = np.repeat(base - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            second = ids[:, 1].ravel()[place]
            ok = t[second] > t[first]
            found.append((v[second[ok]] - v[first[ok]]) / (t[second[ok]] - t[first[ok]]))
        both = values.reshape(rows, 2 * width)
        merged = np.argsort(both, axis=1, kind="stable")
        values = np.take_along_axis(both, merged, axis=1).ravel()
        index = np.take_along_axis(index.reshape(rows, 2 * width), merged, axis=1).ravel()
        width *= 2
    every = np.concatenate(found) if found else np.zeros(0)
    return every[(every > low) & (every <= high)]


def above_both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row, the sum over the others of ([x greater] + [x equal] / 2) * ([y greater] + [y equal] / 2)."""
    n, dx, dy = len(x), dense(x), dense(y)
    out = np.zeros(n)
    for strict_x in (True, False):
        for strict_y in (True, False):
            # Equal x that must not count come in an order in which they are not later and greater.
            order = np.lexsort((-dy if strict_x else dy, dx))
            got = np.empty(n)
            if strict_y:
                got[order] = later_greater(dy[order])
            else:
                got[order] = np.arange(n - 1, -1, -1) - later_smaller(dy[order])
            if strict_x and not strict_y:
                # Later rows of the same x and y are counted as not smaller: they are not of a greater x.
                got -= _later_twins(dx, dy, order)
            if not strict_x and not strict_y:
                # Earlier rows of the same x and y are twins as well.
                got += _earlier_twins(dx, dy, order)
            out += got / 4
    return out


def _earlier_twins(dx: np.ndarray, dy: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(dx))
    cell = dense(dx * (len(dx) + 1) + dy)[order]
    starts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1] if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cell)])
    out[order] = np.arange(len(cell)) - np.repeat(starts, sizes)
    return out


def _later_twins(dx: np.ndarray, dy: np.ndarray, order: np.ndarray) -> np.ndarray:
    cell = dense(dx * (len(dx) + 1) + dy)
    return np.bincount(cell)[cell] - 1 - _earlier_twins(dx, dy, order)


def theil_sen_line(t: np.ndarray, v: np.ndarray, z: float) -> tuple[float, float, float]:
    """Median of the pairwise slopes and its rank confidence limits."""
    n = len(t)
    pairs = n * (n - 1) // 2 - tied_pairs(t)
    if not pairs:
        return float("nan"), float("nan"), float("nan")
    sizes = np.unique(v, return_counts=True)[1].astype(float)
    variance = (n * (n - 1) * (2 * n + 5) - (sizes * (sizes - 1) * (2 * sizes + 5)).sum()) / 18
    spread = z * max(variance, 0.0) ** 0.5
    low = int(max(np.rint((pairs - spread) / 2) - 1, 0))
    high = int(min(np.rint((pairs + spread) / 2), pairs - 1))
    a, b, lower, upper = ranked_slopes(t, v, [(pairs - 1) // 2, pairs // 2, low, high])
    return (a + b) / 2, lower, upper


def leave_one_out_rho(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank correlation without each row in turn (NaN where a side has no variance left).

    Without row i the rank of row j falls by 1 if its value is greater and by 1/2 if it is equal; sums over the
    rows above, and the tied groups' own, update all sums in closed form.
    """
    n = len(x)
    if n < 3:
        return np.full(n, np.nan)
    rx, ry = midranks(x), midranks(y)

    def over(a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Sum of r over the other rows with a greater value of a, and half of it over those with an equal one."""
        place = dense(a)
        own = np.bincount(place, weights=r)
        return (own.sum() - np.cumsum(own))[place] + (own[place] - r) / 2

    def squares(a: np.ndarray) -> np.ndarray:
        """Sum of squared deviations of the ranks that are left."""
        k = np.bincount(dense(a)).astype(float)
        m, own = n - 1, k[dense(a)]
        ties = (k**3 - k).sum() - (own**3 - own) + ((own - 1) ** 3 - (own - 1))
        return (m**3 - m - ties) / 12

    cross = (rx * ry).sum() - rx * ry - over(y, rx) - over(x, ry) + above_both(x, y)
    cov = cross - (n - 1) * (n / 2) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = cov / np.sqrt(squares(x) * squares(y))
    return np.where(np.isfinite(out), out, np.nan)
