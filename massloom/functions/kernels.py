"""Ordered-vector kernels in plain numpy: smoothing, peaks, local regression, fits, clustering.

None of these knows Spark; operators run them per group through Arrow.
"""

from __future__ import annotations

import math

import numpy as np

# ---------------------------------------------------------------- smoothing and baselines


def moving_average(x: np.ndarray, size: int) -> np.ndarray:
    """Centred mean over `size` points, ends repeated; an even window leans left; integers stay integers."""
    x = np.asarray(x)
    left = size // 2
    padded = np.concatenate([np.full(left, x[0]), x, np.full(size - 1 - left, x[-1])]) if len(x) else x
    sums = np.concatenate([[0], np.cumsum(padded.astype(np.float64))])
    out = (sums[size:] - sums[:-size]) / size if len(x) else x.astype(np.float64)
    return np.trunc(out + 1e-9).astype(x.dtype) if np.issubdtype(x.dtype, np.integer) else out


def max_of_two(x: np.ndarray) -> np.ndarray:
    """max(x[i-1], x[i]) with 0 before the first point."""
    x = np.asarray(x)
    return np.maximum(np.concatenate([[0], x[:-1]]), x) if len(x) else x


def detrend(y: np.ndarray) -> np.ndarray:
    """y less its least-squares line."""
    y = np.asarray(y, float)
    t = np.arange(len(y)) - (len(y) - 1) / 2
    slope = (t * y).sum() / max((t * t).sum(), 1e-12)
    return y - y.mean() - slope * t


# ---------------------------------------------------------------- peaks


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Middles (rounded down) of runs of equal values that are higher than both neighbours."""
    x = np.asarray(x)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.concatenate([starts[1:], [len(x)]]) - 1
    level = x[starts]
    inner = np.arange(1, len(starts) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (starts[top] + ends[top]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray, wlen: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prominence, left base, right base) of each peak within a window of wlen points around it."""
    n = len(x)
    half = n if wlen is None else wlen // 2
    out = np.zeros(len(peaks)), np.zeros(len(peaks), np.int64), np.zeros(len(peaks), np.int64)
    for k, p in enumerate(peaks):
        lo, hi = max(0, p - half), min(n - 1, p + half)
        above = np.flatnonzero(x[lo:p] > x[p])
        lo = lo + above[-1] + 1 if len(above) else lo
        above = np.flatnonzero(x[p + 1 : hi + 1] > x[p])
        hi = p + above[0] if len(above) else hi
        left, right = x[lo : p + 1], x[p : hi + 1]
        lb = p - int(np.argmin(left[::-1]))  # the lowest point nearest to the peak
        rb = p + int(np.argmin(right))
        out[0][k], out[1][k], out[2][k] = x[p] - max(x[lb], x[rb]), lb, rb
    return out


def widths(x: np.ndarray, peaks: np.ndarray, prom: np.ndarray, left: np.ndarray, right: np.ndarray, rel: float = 0.5) -> np.ndarray:
    """Widths at `rel` of the prominence below each peak, between linearly interpolated crossings."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        level = x[p] - rel * prom[k]
        i = p
        while i > left[k] and x[i] > level:
            i -= 1
        lo = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        j = p
        while j < right[k] and x[j] > level:
            j += 1
        hi = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
        out[k] = hi - lo
    return out


def find_peaks(x, height: float | None = None, distance: float | None = None, prominence: float | None = None, width: float | None = None, wlen: int | None = None) -> dict[str, np.ndarray]:
    """Peaks that pass the filters, applied in the order height, distance, prominence, width."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        gap, keep = math.ceil(distance), np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                keep[(np.abs(peaks - peaks[k]) < gap) & (np.arange(len(peaks)) != k)] = False
        peaks = peaks[keep]
    prom, left, right = prominences(x, peaks, wlen)
    if prominence is not None:
        ok = prom >= prominence
        peaks, prom, left, right = peaks[ok], prom[ok], left[ok], right[ok]
    wide = widths(x, peaks, prom, left, right)
    if width is not None:
        ok = wide >= width
        peaks, prom, left, right, wide = peaks[ok], prom[ok], left[ok], right[ok], wide[ok]
    return {"peaks": peaks, "heights": x[peaks], "prominences": prom, "left_bases": left, "right_bases": right, "widths": wide}


# ---------------------------------------------------------------- regression and fits


def lowess(y, x, frac: float = 2 / 3, it: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(sorted x, locally weighted linear fit there): tricube weights over the frac * n nearest points,
    `it` further passes with bisquare weights on the residuals. Equal x with no spread use their mean."""
    order = np.argsort(np.asarray(x, float), kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    if n < 2:
        return x, y.copy()
    k = min(n, max(2, int(frac * n + 1e-10)))
    robust, fitted = np.ones(n), y.copy()
    for step in range(it + 1):
        lo = 0
        for i in range(n):
            while lo + k < n and x[i] - x[lo] > x[lo + k] - x[i]:
                lo += 1
            xs, ys = x[lo : lo + k], y[lo : lo + k]
            far = max(x[i] - xs[0], xs[-1] - x[i])
            w = np.ones(k) if far <= 0 else np.clip(1 - (np.abs(xs - x[i]) / far) ** 3, 0, None) ** 3
            w = w * robust[lo : lo + k]
            total = w.sum()
            if total <= 0:
                continue
            mx, my = (w * xs).sum() / total, (w * ys).sum() / total
            var = (w * (xs - mx) ** 2).sum() / total
            slope = (w * (xs - mx) * (ys - my)).sum() / total / var if var > 1e-12 * max(1.0, (xs[-1] - xs[0]) ** 2) else 0.0
            fitted[i] = my + slope * (x[i] - mx)
        if step < it:
            r = np.abs(y - fitted)
            scale = 6 * np.median(r)
            robust = np.ones(n) if scale <= 0 else np.clip(1 - (r / scale) ** 2, 0, None) ** 2
    return x, fitted


def interpolate(at, x, y) -> np.ndarray:
    """Linear interpolation that goes on along the end segments; equal x keep their mean y."""
    x, where = np.unique(np.asarray(x, float), return_inverse=True)
    y = np.bincount(where, np.asarray(y, float)) / np.bincount(where)
    at = np.asarray(at, float)
    if len(x) == 1:
        return np.full(at.shape, y[0])
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    return y[i] + (at - x[i]) * (y[i + 1] - y[i]) / (x[i + 1] - x[i])


def gaussian(x, height: float, middle: float, sigma: float) -> np.ndarray:
    return height * np.exp(-((np.asarray(x, float) - middle) ** 2) / (2 * sigma**2))


def gaussian_area(height: float, sigma: float) -> float:
    return height * math.sqrt(2 * math.pi * sigma**2)


def fit_gaussian(x, y, height: float, middle: float, sigma: float, rounds: int = 200) -> tuple[float, float, float] | None:
    """Least squares by Levenberg-Marquardt; None where it does not settle on finite values."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p, damp = np.array([height, middle, sigma or 1.0], float), 1e-3
    with np.errstate(all="ignore"):
        r = y - gaussian(x, *p)
        cost = (r**2).sum()
        for _ in range(rounds):
            g = np.exp(-((x - p[1]) ** 2) / (2 * p[2] ** 2))
            jac = np.stack([g, p[0] * g * (x - p[1]) / p[2] ** 2, p[0] * g * (x - p[1]) ** 2 / p[2] ** 3], 1)
            a, b = jac.T @ jac, jac.T @ r
            if not (np.isfinite(a).all() and np.isfinite(b).all()):
                return None
            try:
                step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), b)
            except np.linalg.LinAlgError:
                return None
            new = p + step
            r2 = y - gaussian(x, *new) if new[2] else r
            c2 = (r2**2).sum()
            if np.isfinite(c2) and c2 < cost:
                done = cost - c2 <= 1e-10 * cost
                p, r, cost, damp = new, r2, c2, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 5
                if damp > 1e12:
                    break
    return (float(p[0]), float(p[1]), float(p[2])) if np.isfinite(p).all() else None


def goodness(y, fitted) -> float:
    """1 - SSE / SST."""
    y = np.asarray(y, float)
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - fitted) ** 2).sum() / total) if total > 0 else 0.0


def density(points, bandwidth: float, grid: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(grid, Gaussian kernel density) over the points' range and three bandwidths beyond."""
    p = np.asarray(points, float)
    at = np.linspace(p.min() - 3 * bandwidth, p.max() + 3 * bandwidth, grid)
    out = np.zeros(grid)
    for lo in range(0, len(p), 4096):
        out += np.exp(-0.5 * ((at[:, None] - p[lo : lo + 4096]) / bandwidth) ** 2).sum(1)
    return at, out / (len(p) * bandwidth * math.sqrt(2 * math.pi))


# ---------------------------------------------------------------- clustering and assignment


def linkage_clusters(distance: np.ndarray, cut: float, method: str = "average") -> np.ndarray:
    """Cluster numbers from 1 (by first member) after merging up to `cut`: `average` or `ward` by
    Lance-Williams updates of a full distance matrix."""
    n = len(distance)
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    for _ in range(n - 1):
        flat = int(np.argmin(np.where(alive[:, None] & alive[None, :], d, np.inf)))
        i, j = sorted(divmod(flat, n))
        if not d[i, j] <= cut:
            break
        a, b = size[i], size[j]
        if method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            s = a + b + size
            new = np.sqrt(np.maximum(((a + size) * d[i] ** 2 + (b + size) * d[j] ** 2 - size * d[i, j] ** 2) / s, 0))
        new[i] = new[j] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :] = d[:, j] = np.inf
        alive[j], size[i] = False, a + b
        label[label == j] = i
    _, first, out = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[out] + 1


def assign_pairs(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of an assignment with the greatest total gain (shortest augmenting paths)."""
    gain = np.asarray(gain, float)
    if not gain.size:
        return []
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j0]:
            used[j0] = True
            i0 = owner[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def density_seeds(mz: np.ndarray, tolerance: float) -> np.ndarray:
    """Seeds where a smoothed histogram of 0.0001 bins peaks, at least `tolerance` apart (integer counts)."""
    bins = np.floor(np.asarray(mz) * 10000).astype(np.int64)
    tol = max(1, int(tolerance * 10000))
    low = bins.min() - tol
    counts = np.bincount(bins - low, minlength=int(bins.max() - low + tol + 1))
    smooth = moving_average(counts, max(2, tol // 2))
    return (find_peaks(smooth, distance=tol)["peaks"] + low) / 10000.0


def nearest_seed(mz: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Index of the nearest of the sorted seeds; the lower one on ties."""
    mz, seeds = np.asarray(mz, float), np.asarray(seeds, float)
    hi = np.clip(np.searchsorted(seeds, mz), 0, len(seeds) - 1)
    lo = np.maximum(hi - 1, 0)
    return np.where(np.abs(mz - seeds[lo]) <= np.abs(seeds[hi] - mz), lo, hi)


def split_largest_gap(mz_sorted: np.ndarray) -> int:
    """Index of the first point after the largest gap (the first one on ties); 0 for a single point."""
    return int(np.argmax(np.diff(mz_sorted))) + 1 if len(mz_sorted) > 1 else 0


def split_wide(mz: np.ndarray, tolerance: float) -> np.ndarray:
    """Group numbers of sorted m/z values: one group if narrower than twice the tolerance, else by seeds;
    without seeds, cut at the largest gap."""
    mz = np.asarray(mz, float)
    if len(mz) < 2 or mz[-1] - mz[0] < 2 * tolerance:
        return np.zeros(len(mz), np.int64)
    seeds = density_seeds(mz, tolerance)
    if len(seeds) == 0:
        return (np.arange(len(mz)) >= split_largest_gap(mz)).astype(np.int64)
    return nearest_seed(mz, seeds)


def bin_by_median(values: np.ndarray, tolerance) -> np.ndarray:
    """Bins of ascending values: a new one where a value is tolerance(value) or more above the bin's median."""
    out, at, start = np.zeros(len(values), np.int64), 0, 0
    for i in range(1, len(values)):
        if values[i] - np.median(values[start:i]) >= tolerance(values[i]):
            at, start = at + 1, i
        out[i] = at
    return out


def intensity_groups(mz: np.ndarray, intensity: np.ndarray, tolerance: float) -> np.ndarray:
    """Group numbers around the most intense points: each point not yet taken, in falling order of intensity (the first on
    ties), takes all free points nearer than tolerance to it."""
    mz, free = np.asarray(mz, float), np.ones(len(mz), bool)
    out, at = np.zeros(len(mz), np.int64), 0
    for i in np.argsort(-np.asarray(intensity), kind="stable"):
        if free[i]:
            near = free & (np.abs(mz - mz[i]) < tolerance)
            near[i] = True
            out[near], at = at, at + 1
            free &= ~near
    return out
