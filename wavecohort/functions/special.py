"""Tail probabilities in numpy, for the small tables of test results. Published methods; see each function."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def normal_ppf(p):
    """Inverse of the normal distribution function by bisection and Newton steps."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = 1 - normal_sf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def gammainc_upper(a, x):
    """Regularised upper incomplete gamma function: power series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, 1e-300)) - _lgamma(a), -np.inf))
    term = total = 1 / a
    for n in range(1, 400):
        term = term * x / (a + n)
        total = total + term
    low = 1 - front * total
    b = x + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d
    for i in range(1, 400):
        an = -i * (i - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
        c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
        h = h * d * c
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, front * h))


def chi2_sf(x, df):
    return gammainc_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def betainc(a, b, x):
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones(z.shape), 1 / safe(1 - (p + q) * z / (p + 1))
    h = d
    for m in range(1, 300):
        e = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / safe(1 + e * d), safe(1 + e / c)
        h = h * d * c
        e = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / safe(1 + e * d), safe(1 + e / c)
        h = h * d * c
    got = np.where(z <= 0, 0.0, front * h)
    return np.where(flip, 1 - got, got)


def f_sf(x, d1, d2):
    x = np.asarray(x, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(x, 0)))


def t_two_sided(t, df):
    t = np.asarray(t, float)
    return betainc(np.asarray(df, float) / 2, 0.5, df / (df + t * t))


_ZX, _ZW = np.polynomial.legendre.leggauss(96)


def studentized_range_sf(q, k, df):
    """P(range of k normals / independent scale > q): a double integral by Gauss-Legendre."""
    q, k, df = np.broadcast_arrays(np.asarray(q, float), np.asarray(k, float), np.asarray(df, float))
    z = _ZX * 8
    zw = _ZW * 8 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = 1 - normal_sf(z)
    out = np.empty(q.shape)
    for i in np.ndindex(q.shape):
        if not np.isfinite(q[i]):
            out[i] = np.nan
            continue
        nu = df[i]
        half = min(0.9999, 8 / math.sqrt(2 * nu)) if nu > 32 else 0.9999
        lo, hi = max(1e-6 - 1, -half), 8 / math.sqrt(2 * nu) if nu > 2 else 11.0
        e = (_ZX + 1) / 2 * (hi - lo) + lo  # the scale less 1, so that nothing is lost however many degrees there are
        s = 1 + e
        log_density = (nu - 1) * np.log1p(e) - nu * e * (1 + e / 2)  # but for a constant
        weight = _ZW * np.exp(log_density - log_density.max())
        inner = np.array([k[i] * (zw * np.maximum(cdf - (1 - normal_sf(z - q[i] * u)), 0) ** (k[i] - 1)).sum() for u in s])
        out[i] = min(1.0, max(0.0, 1 - float((weight * inner).sum() / weight.sum())))
    return out


def mann_whitney_exact(u, n1, n2):
    """Two-sided exact p of the larger U without ties, from the counts of rank sums."""
    u, n1, n2 = float(u), int(n1), int(n2)
    counts = np.zeros((n1 + 1, n1 * n2 + 1))
    counts[0, 0] = 1
    for j in range(1, n1 + n2 + 1):
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            if shift <= n1 * n2:
                moved = np.zeros(n1 * n2 + 1)
                moved[shift:] = counts[i - 1, : n1 * n2 + 1 - shift]
                counts[i] += moved
    top = math.ceil(max(u, n1 * n2 - u))
    return min(1.0, 2 * counts[n1, top:].sum() / counts[n1].sum())


# Coefficients of the two outer weights in 1 / sqrt(n), without the constant term.
_LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157]
_SECOND = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981]


def shapiro_wilk(x):
    """W and p by Royston's approximation (1995) of values in memory; three at least."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    m = normal_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    mm = float(m @ m)
    poly = lambda c, v: float(np.polyval(c, v))
    a = np.empty(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        u, c = 1 / math.sqrt(n), m / math.sqrt(mm)
        last = poly([*_LAST, c[-1]], u)
        if n > 5:
            second = poly([*_SECOND, c[-2]], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    return w, shapiro_p(w, n)


def shapiro_from_sums(n, mm, mx, ss, first, second, before, last, m_before, m_last):
    """W of ``n`` sorted values from sums over them: ``mm`` of squared normal scores, ``mx`` of scores times values,
    ``ss`` of squared deviations, and the two values and scores at the ends."""
    if n < 3 or not ss > 0:
        return math.nan
    wide, inner = last - first, before - second
    if n == 3:
        return min(1.0, 0.5 * wide**2 / ss)
    u = 1 / math.sqrt(n)
    a1 = float(np.polyval([*_LAST, m_last / math.sqrt(mm)], u))
    a2 = float(np.polyval([*_SECOND, m_before / math.sqrt(mm)], u)) if n > 5 else None
    ends = [(a1, m_last, wide)] + ([(a2, m_before, inner)] if n > 5 else [])
    phi = (mm - 2 * sum(m * m for _, m, _ in ends)) / (1 - 2 * sum(a * a for a, _, _ in ends))
    ax = sum(a * x for a, _, x in ends) + (mx - sum(m * x for _, m, x in ends)) / math.sqrt(phi)
    return min(1.0, ax**2 / ss)


def shapiro_p(w, n):
    """p of W. Royston fitted it to 5000 values at most; beyond them it is an extrapolation."""
    if math.isnan(w):
        return math.nan
    poly = lambda c, v: float(np.polyval(c, v))
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if n <= 11:
        g = 0.459 * n - 2.273
        if w >= 1 or g - math.log(1 - w) <= 0:
            return 1.0 if w >= 1 else 0.0
        y = -math.log(g - math.log(1 - w))
        mu, sigma = poly([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(poly([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y = math.log(max(1 - w, 1e-300))
        mu, sigma = poly([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n)), math.exp(poly([0.0030302, -0.082676, -0.4803], math.log(n)))
    return float(normal_sf((y - mu) / sigma))
