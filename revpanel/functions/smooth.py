"""Smoothers in numpy: smoothing spline, trend filter and robust seasonal decomposition."""

from __future__ import annotations

import numpy as np


def _natural_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q and R of the natural cubic spline with knots at x: roughness is g' Q R^-1 Q' g."""
    h, n = np.diff(x), len(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    i = np.arange(n - 2)
    q[i, i], q[i + 1, i], q[i + 2, i] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    r[i, i] = (h[:-1] + h[1:]) / 3
    r[i[:-1], i[:-1] + 1] = r[i[:-1] + 1, i[:-1]] = h[1:-1] / 6
    return q, r


def smoothing_spline(x: np.ndarray, y: np.ndarray, x0: np.ndarray, df: float | None = None, lam: float | None = None, cv: bool = False, df_offset: float = 0, penalty: float = 1) -> tuple[np.ndarray, np.ndarray]:
    """Values and slopes at x0 of the smoothing spline; its weight from lam, df, or cross-validation.

    The latter is generalised, with df_offset + penalty * df for the degrees of freedom, or with ``cv`` leaves out one x at a time.
    """
    x, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    y = np.bincount(at, y) / weight
    lo, span = x[0], x[-1] - x[0]
    z = (x - lo) / span
    q, r = _natural_parts(z)
    n = len(x)
    # With s = sqrt(w): the fit is s^-1 (I + lam M)^-1 s y, whose eigenvalues give df and GCV for every lam at once.
    half = np.sqrt(weight)
    m = (q / half[:, None]) @ np.linalg.solve(r, (q / half[:, None]).T)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    values = np.maximum(values, 0)
    values[:2] = 0  # straight lines are not rough
    rotated = vectors.T @ (half * y)

    def trace(lam_: float) -> float:
        return float((1 / (1 + lam_ * values)).sum())

    def gcv(lam_: float) -> float:
        shrink = lam_ * values / (1 + lam_ * values)
        if cv:
            left = vectors @ (shrink * rotated) / half
            own = vectors**2 @ (1 / (1 + lam_ * values))
            return float((weight * (left / np.maximum(1 - own, 1e-9)) ** 2).mean())
        rest = 1 - (df_offset + penalty * trace(lam_)) / n
        return float((shrink * rotated) @ (shrink * rotated)) / rest**2 if rest > 1e-6 else np.inf

    if lam is not None:
        best = float(lam)
    else:
        grid = np.exp(np.linspace(-18, 12, 241))
        score = [abs(trace(g) - df) for g in grid] if df is not None else [gcv(g) for g in grid]
        k = int(np.argmin(score))
        near = np.exp(np.linspace(np.log(grid[max(k - 1, 0)]), np.log(grid[min(k + 1, 240)]), 61))
        best = near[int(np.argmin([abs(trace(g) - df) if df is not None else gcv(g) for g in near]))]
    g = vectors @ (rotated / (1 + best * values)) / half
    second = np.r_[0, np.linalg.solve(r, q.T @ g), 0]
    t = (x0 - lo) / span
    i = np.clip(np.searchsorted(z, t, "right") - 1, 0, n - 2)
    h, a, b = z[i + 1] - z[i], z[i + 1] - t, t - z[i]
    f = (a * g[i] + b * g[i + 1]) / h + ((a**3 / h - a * h) * second[i] + (b**3 / h - b * h) * second[i + 1]) / 6
    d = (g[i + 1] - g[i]) / h + ((h - 3 * a**2 / h) * second[i] + (3 * b**2 / h - h) * second[i + 1]) / 6
    return f, d / span


def _difference(x: np.ndarray, k: int) -> np.ndarray:
    """Divided differences of order k + 1."""
    d = np.eye(len(x))
    for j in range(k + 1):
        d = np.diff(d, axis=0)
        if j < k:
            d = d * ((j + 1) / (x[j + 1 :] - x[: len(x) - j - 1]))[:, None]
    return d


def _fused(v: np.ndarray, w: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - w, 0)


def _trend_fit(y: np.ndarray, d: np.ndarray, lams: np.ndarray, steps: int = 300) -> np.ndarray:
    """min 1/2 |y - b|^2 + lam |D b|_1 for each lam, by ADMM with warm starts."""
    gram, out = d.T @ d, np.empty((len(lams), len(y)))
    values, vectors = np.linalg.eigh(gram)
    b, z, u = y.copy(), d @ y, np.zeros(len(d))
    for i, lam in enumerate(lams):
        rho = max(lam, 1e-8)
        for _ in range(steps):
            b = vectors @ ((vectors.T @ (y + rho * d.T @ (z - u))) / (1 + rho * values))
            new = _fused(d @ b + u, lam / rho)
            u = u + d @ b - new
            moved, z = np.abs(new - z).max(initial=0), new
            if moved < 1e-7 * (1 + np.abs(z).max(initial=0)) and np.abs(d @ b - z).max(initial=0) < 1e-6:
                break
        out[i] = b
    return out


def trend_filter(x: np.ndarray, y: np.ndarray, x0: np.ndarray, params) -> np.ndarray:
    """Polynomial trend filter at x0; lambda by cross-validation, degrees of freedom, or as given."""
    z = (x - x[0]) / max(x[-1] - x[0], 1e-12) * (len(x) - 1)
    scale = np.abs(y).max() or 1.0
    y = y / scale
    d = _difference(z, params.k)
    if params.lam is not None:
        lams = np.sort(np.atleast_1d(np.asarray(params.lam, float)))[::-1]
    else:
        # at lambda_max the fit is one polynomial
        most = params.lambda_max or np.abs(np.linalg.lstsq(d.T, y - np.polyval(np.polyfit(z, y, params.k), z), rcond=None)[0]).max()
        least = params.lambda_min or most * params.lambda_min_ratio
        lams = np.exp(np.linspace(np.log(max(most, 1e-10)), np.log(max(least, 1e-12)), max(int(params.nlambda), 1)))
    if params.cv and len(lams) > 1:
        folds, errors = np.r_[0, np.arange(len(x) - 2) % params.nfolds + 1, 0], np.zeros((params.nfolds, len(lams)))
        for fold in range(1, params.nfolds + 1):
            held = folds == fold
            fits = _trend_fit(y[~held], _difference(z[~held], params.k), lams)
            for i, f in enumerate(fits):
                miss = y[held] - np.interp(z[held], z[~held], f)
                errors[fold - 1, i] = np.abs(miss).mean() if params.error_measure == "mae" else (miss**2).mean()
        mean = errors.mean(0)
        best = int(np.argmin(mean))
        if params.df == "1se":
            bound = mean[best] + errors[:, best].std(ddof=1) / np.sqrt(params.nfolds)
            best = int(np.flatnonzero(mean <= bound)[0])
        fit = _trend_fit(y, d, lams[: best + 1])[-1]
    else:
        fits = _trend_fit(y, d, lams)
        pick = 0
        if len(lams) > 1 and params.df is not None and not isinstance(params.df, str):
            knots = (np.abs(fits @ d.T) > 1e-5).sum(1) + params.k + 1
            pick = int(np.argmin(np.abs(knots - params.df)))
        fit = fits[pick]
    return np.interp(x0, x, fit) * scale


def _loess(y: np.ndarray, span: int, at: np.ndarray, degree: int, weight: np.ndarray) -> np.ndarray:
    """Local regression of y on 0..n-1 at the positions ``at`` (whole numbers), with tricube and given weights.

    The nearest points of all positions are taken side by side, some positions at a time, so that memory does not grow with both.
    """
    n, x = len(y), np.arange(len(y), dtype=float)
    q = min(span, n)
    near = [np.lib.stride_tricks.sliding_window_view(v, q) for v in (x, y, weight)]
    out = np.empty(len(at))
    for s in range(0, len(at), max(1, 1_000_000 // q)):
        t = at[s : s + max(1, 1_000_000 // q)].astype(float)
        lo = np.clip(t.astype(np.int64) - q // 2, 0, n - q)
        xs, ys, ws = (v[lo] for v in near)
        reach = np.maximum(np.abs(t - xs[:, 0]), np.abs(xs[:, -1] - t)) + max(span - n, 0) / 2
        far = np.abs(xs - t[:, None]) / np.maximum(reach, 1e-12)[:, None]
        w = np.where(far < 0.999, (1 - np.minimum(far, 1) ** 3) ** 3, 0) * ws
        total = w.sum(1)
        w = w / np.where(total > 0, total, 1)[:, None]
        fit = (w * ys).sum(1)
        if degree:
            mean = (w * xs).sum(1)
            off = xs - mean[:, None]
            var = (w * off**2).sum(1)
            slope = (w * off * ys).sum(1) / np.where(var > 0, var, 1)
            fit = np.where(var > 1e-9 * (n - 1) ** 2, fit + (t - mean) * slope, fit)
        out[s : s + len(t)] = np.where(total > 0, fit, ys.mean(1))
    return out


def _moving(y: np.ndarray, n: int) -> np.ndarray:
    return np.convolve(y, np.ones(n) / n, "valid")


def _odd(n: int) -> int:
    return int(n) + (int(n) % 2 == 0)


def stl(y: np.ndarray, period: int, seasonal: int | str, trend: int, inner: int = 1, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust seasonal-trend decomposition by local regression: seasonal, trend, remainder.

    With the seasonal window "periodic" each phase of the period has one value: means over a window of ten series, and the mean of
    these at the end.
    """
    n = len(y)
    if n < 2 * period:
        raise ValueError("a series needs at least two periods")
    periodic = seasonal == "periodic"
    degree, seasonal = (0, 10 * n + 1) if periodic else (1, max(3, _odd(seasonal)))
    trend, low = max(3, _odd(trend)), max(3, _odd(period))
    weight, t, s = np.ones(n), np.zeros(n), np.zeros(n)
    for loop in range(outer + 1):
        for _ in range(inner):
            d = y - t
            c = np.empty(n + 2 * period)
            for j in range(period):
                sub = d[j::period]
                at = np.arange(-1, len(sub) + 1)
                c[j :: period][: len(sub) + 2] = _loess(sub, seasonal, at, degree, weight[j::period])
            passed = _moving(_moving(_moving(c, period), period), 3)
            s = c[period : period + n] - _loess(passed, low, np.arange(n), 1, np.ones(n))
            t = _loess(y - s, trend, np.arange(n), 1, weight)
        if loop < outer:
            r = np.abs(y - s - t)
            h = 6 * np.median(r)
            # Remainders that are mere rounding say nothing about outliers.
            u = r / h if h > 1e-10 * np.abs(y).max() else np.zeros(n)
            weight = np.where(u <= 0.001, 1, np.where(u > 0.999, 0, (1 - np.minimum(u, 1) ** 2) ** 2))
    if periodic:
        phase = np.arange(n) % period
        s = (np.bincount(phase, s) / np.bincount(phase))[phase]
    return s, t, y - s - t
