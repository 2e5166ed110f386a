"""Distribution tails and small linear models in numpy, for rows that Spark has already reduced."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of a standard normal variable."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """The standard normal quantile, by Newton steps on the log scale from a tail approximation."""
    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(q))
        x = t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
        for _ in range(6):
            f = norm_sf(x)
            x = x + (f - q) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300) * np.where(f > 0, 1, 0)
        x = np.where(p == 0.5, 0.0, np.where((p <= 0) | (p >= 1), np.inf, x))
    return np.where(np.isnan(p), np.nan, np.where(p < 0.5, -x, x))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + k * d), safe(1 + k / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        near = np.where(low, front * _beta_fraction(a, b, np.where(low, x, 0.5)) / a, 1 - front * _beta_fraction(b, a, np.where(low, 0.5, 1 - x)) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, near))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(t) & (df > 0)
    out = np.full(t.shape, np.nan)
    out[ok] = beta_inc(df[ok] / 2, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) of a chi-square variable with whole degrees of freedom, by the recurrence from 1 or 2."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df))
    out = np.full(x.shape, np.nan)
    for k in np.unique(df):
        v = np.maximum(x[df == k], 0) / 2
        total = 2 * norm_sf(np.sqrt(2 * v)) if k % 2 else np.exp(-v)
        with np.errstate(divide="ignore"):
            for a in np.arange(1 if k % 2 == 0 else 0.5, k / 2, 1):
                total = total + np.exp(a * np.log(v) - v - math.lgamma(a + 1))
        out[df == k] = np.minimum(total, 1)
    return np.where(np.isnan(x), np.nan, out)


def _inverse(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of a stack of matrices, and which of them have one."""
    det = np.linalg.det(m)
    ok = np.isfinite(det) & (det != 0)
    return np.linalg.inv(np.where(ok[:, None, None], m, np.eye(m.shape[-1]))), ok


def irls(x: np.ndarray, n: np.ndarray, cases: np.ndarray, firth: bool = False, rounds: int = 25, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stack of grouped logistic regressions: coefficients, standard errors and which fits converged.

    x is (models, cells, terms), n and cases are (models, cells); cells of nobody count for
    nothing. A fit stops when its deviance changes by less than `tol` of itself. With `firth`,
    Jeffreys' prior penalises the score, which gives finite estimates for separated data.
    """
    beta, se = np.zeros((len(x), x.shape[-1])), np.full((len(x), x.shape[-1]), np.nan)
    before, live, good = np.full(len(x), np.inf), np.arange(len(x)), np.zeros(len(x), bool)

    def chances(z: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((z @ b[..., None])[..., 0], -30, 30)))

    def covariance(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _inverse((z * w[..., None]).transpose(0, 2, 1) @ z)

    for _ in range(rounds * (4 if firth else 1)):
        if not len(live):
            break
        z, m, c = x[live], n[live], cases[live]
        p = chances(z, beta[live])
        w = m * p * (1 - p)
        cov, ok = covariance(z, w)
        score = c - m * p
        if firth:
            score = score + w * ((z @ cov) * z).sum(-1) * (0.5 - p)
        step = (cov @ (z.transpose(0, 2, 1) @ score[..., None]))[..., 0]
        beta[live] += np.clip(step, -5, 5) if firth else step
        q = np.clip(chances(z, beta[live]), 1e-15, 1 - 1e-15)
        deviance = -2 * (c * np.log(q) + (m - c) * np.log(1 - q)).sum(-1)
        with np.errstate(invalid="ignore"):
            done = np.abs(step).max(-1) < 1e-8 if firth else np.abs(deviance - before[live]) < tol * (np.abs(deviance) + 0.1)
        before[live] = deviance
        done &= ok
        if done.any():
            cov, sound = covariance(z[done], (m * q * (1 - q))[done])
            with np.errstate(invalid="ignore"):
                se[live[done]] = np.sqrt(np.diagonal(cov, axis1=1, axis2=2))
            good[live[done]] = sound & np.isfinite(se[live[done]]).all(-1)
        live = live[ok & ~done]
    return np.where(good[:, None], beta, np.nan), np.where(good[:, None], se, np.nan), good


#: The first lift of a diagonal, how many times it may grow tenfold, and the least eigenvalue otherwise.
LIFT, LIFTS, LEAST_EIGENVALUE = 1e-6, 8, 1e-8


def positive_spectrum(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of positive definite matrices near a stack of symmetric ones.

    A diagonal lifted by x moves all eigenvalues by x, so the lowest one tells which lift is
    the first to be enough; where none is, low eigenvalues are raised.
    """
    value, vector = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
    lifts = LIFT * 10.0 ** np.arange(LIFTS)
    which = np.searchsorted(lifts, -value[:, 0], side="right")
    lifted = value + lifts[np.minimum(which, LIFTS - 1), None]
    return np.where((which < LIFTS)[:, None], lifted, np.maximum(value, LEAST_EIGENVALUE)), vector


def positive(m: np.ndarray) -> np.ndarray:
    """Positive definite matrices near a stack of symmetric ones."""
    value, vector = positive_spectrum(m)
    return (vector * value[:, None, :]) @ vector.transpose(0, 2, 1)


def ridge(s: np.ndarray, t: np.ndarray, yy: np.ndarray, n: np.ndarray, by: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, standard errors and residual sums of squares of a stack of (noisy) sums of products.

    Fixed values: a residual that noise made impossible is |yy|, 1e-6 at least, and an impossible error 1e6.
    """
    value, vector = positive_spectrum(s + by * np.eye(s.shape[-1]))
    inverse = (vector / value[:, None, :]) @ vector.transpose(0, 2, 1)
    beta = (inverse @ t[..., None])[..., 0]
    fitted = ((s @ beta[..., None])[..., 0] - 2 * t) * beta
    sse = yy + fitted.sum(-1)
    sse = np.where(np.isfinite(sse) & (sse > 0), sse, np.maximum(1e-6, np.abs(yy)))
    spread = np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 1e-12) * (sse / np.maximum(1, n - s.shape[-1]))[:, None]
    se = np.sqrt(spread)
    return beta, np.where(np.isfinite(se) & (se > 0), se, 1e6), sse
