"""Distribution families in numpy: cumulative functions, quantiles and mixtures, for pandas UDFs and driver-side targets.

Two readings of a specification differ on purpose: `generator` knows constant, lognormal, gamma, weibull(_min),
truncated_normal/truncnorm, beta and mixture; `validator` knows constant, uniform, normal, lognormal, gamma, beta and
mixture, reads fewer aliases, and takes any other family as a step at `value` (0 by default).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd

_ERF = np.vectorize(math.erf, otypes=[float])
_LGAMMA = math.lgamma


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(np.asarray(x, float) / math.sqrt(2)))


def gamma_cdf(x: np.ndarray, shape: float) -> np.ndarray:
    """Regularised lower incomplete gamma: a power series below shape + 1, a continued fraction above."""
    x = np.maximum(np.asarray(x, float), 0)
    out = np.zeros_like(x)
    low = (x > 0) & (x < shape + 1)
    v = x[low]
    term = np.full_like(v, 1 / shape)
    total = term.copy()
    for n in range(1, 1000):
        term = term * v / (shape + n)
        total += term
        if not len(term) or np.abs(term).max() < 1e-17 * max(1e-300, np.abs(total).min()):
            break
    with np.errstate(divide="ignore"):
        out[low] = total * np.exp(-v + shape * np.log(v) - _LGAMMA(shape))
    high = x >= shape + 1
    v = x[high]
    tiny = 1e-300
    b = v + 1 - shape
    c, d = np.full_like(v, 1 / tiny), 1 / b
    h = d.copy()
    for n in range(1, 1000):
        a = -n * (n - shape)
        b = b + 2
        d = 1 / np.where(np.abs(a * d + b) < tiny, tiny, a * d + b)
        c = np.where(np.abs(b + a / c) < tiny, tiny, b + a / c)
        step = c * d
        h = h * step
        if not len(step) or np.abs(step - 1).max() < 4e-16:
            break
    out[high] = 1 - h * np.exp(-v + shape * np.log(v) - _LGAMMA(shape))
    return out


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, mirrored where that converges faster."""
    x = np.clip(np.asarray(x, float), 0, 1)
    mirror = x > (a + 1) / (a + b + 2)
    out = np.empty_like(x)
    for flip, p, q in ((False, a, b), (True, b, a)):
        v = np.where(mirror, 1 - x, x)[mirror == flip]
        tiny = 1e-300
        c = np.ones_like(v)
        d = 1 - (p + q) * v / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for n in range(1, 2000):
            for f in (n * (q - n) * v / ((p + 2 * n - 1) * (p + 2 * n)), -(p + n) * (p + q + n) * v / ((p + 2 * n) * (p + 2 * n + 1))):
                d = 1 / np.where(np.abs(1 + f * d) < tiny, tiny, 1 + f * d)
                c = np.where(np.abs(1 + f / c) < tiny, tiny, 1 + f / c)
                step = c * d
                h = h * step
            if not len(step) or np.abs(step - 1).max() < 4e-16:
                break
        with np.errstate(divide="ignore"):
            front = np.exp(_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q) + p * np.log(v) + q * np.log1p(-v))
        got = np.where(v > 0, front * h / p, 0)
        out[mirror == flip] = 1 - got if flip else got
    return out


def inverted(cdf: Callable, levels: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quantiles by bisection of a bracket that is widened until it holds them; to the last bit of the bracket's middle."""
    q = np.asarray(levels, float)
    lo, hi = np.full_like(q, low), np.full_like(q, high)
    for _ in range(200):
        short = cdf(hi) < q
        if not short.any():
            break
        hi[short] = hi[short] * 2 + 1
    for _ in range(120):
        mid = (lo + hi) / 2
        under = cdf(mid) < q
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def _read(spec: dict, *names: str, default: float | None = None) -> float:
    for n in names:
        if spec.get(n) is not None:
            return float(spec[n])
    if default is None:
        raise ValueError(f"{spec.get('family')} needs one of {', '.join(names)}")
    return default


def _family(spec: dict, reading: str) -> tuple[Callable, float, float]:
    """(cdf, low, high): where quantiles are looked for to begin with."""
    family = spec.get("family", "constant")
    wide = reading == "generator"
    step = _read(spec, "value", default=0.0) if not wide or family == "constant" else 0.0
    loc = _read(spec, "loc", default=0.0) if wide or family == "beta" else 0.0
    if family == "constant" or (not wide and family in ("weibull", "weibull_min", "truncated_normal", "truncnorm")):
        return (lambda x: (np.asarray(x, float) >= step).astype(float)), step, step
    if family == "lognormal":
        sigma = _read(spec, "sigma")
        mu = math.log(_read(spec, "scale")) if wide and spec.get("scale") is not None else _read(spec, "mu", "mean") if wide else _read(spec, "mu")
        return (lambda x: np.where(np.asarray(x) > loc, normal_cdf((np.log(np.maximum(np.asarray(x, float) - loc, 1e-300)) - mu) / sigma), 0.0)), loc, loc + math.exp(mu + 6 * sigma)
    if family == "gamma":
        shape = _read(spec, "alpha", "shape", "k") if wide else _read(spec, "k", "shape")
        scale = _read(spec, "scale", "theta", default=1.0)
        return (lambda x: gamma_cdf((np.asarray(x, float) - loc) / scale, shape)), loc, loc + scale * (shape + 10 * math.sqrt(shape) + 10)
    if family == "beta":
        a, b = _read(spec, "alpha", "a"), _read(spec, "beta", "b")
        if spec.get("lower") is not None:
            loc = float(spec["lower"])
        upper = spec.get("upper") if spec.get("upper") is not None else spec.get("maximum")
        scale = float(upper) - loc if upper is not None else _read(spec, "scale", default=1.0) if wide else 1.0
        return (lambda x: beta_cdf((np.asarray(x, float) - loc) / scale, a, b)), loc, loc + scale
    if wide and family in ("weibull", "weibull_min"):
        shape, scale = _read(spec, "shape", "k", "c"), _read(spec, "scale", default=1.0)
        return (lambda x: -np.expm1(-(np.maximum((np.asarray(x, float) - loc) / scale, 0) ** shape))), loc, loc + scale * 4
    if wide and family in ("truncated_normal", "truncnorm"):
        mean, sigma, low, high = _read(spec, "mean", "mu", "loc"), _read(spec, "sigma", "std", "scale"), _read(spec, "low", "lower", "min"), _read(spec, "high", "upper", "max")
        a, b = (float(normal_cdf(np.array((v - mean) / sigma))) for v in (low, high))
        return (lambda x: np.clip((normal_cdf((np.clip(np.asarray(x, float), low, high) - mean) / sigma) - a) / (b - a), 0, 1)), low, high
    if not wide and family == "uniform":
        low, high = _read(spec, "low", "lower", "min"), _read(spec, "high", "upper", "max")
        return (lambda x: np.clip((np.asarray(x, float) - low) / (high - low), 0, 1)), low, high
    if not wide and family == "normal":
        mean, sigma = _read(spec, "mean", "mu"), _read(spec, "sigma", "std")
        return (lambda x: normal_cdf((np.asarray(x, float) - mean) / sigma)), mean - 40 * sigma, mean + 10 * sigma
    if wide:
        raise ValueError(f"unknown family {family!r}")
    return (lambda x: (np.asarray(x, float) >= step).astype(float)), step, step


def cdf(spec: dict, x: np.ndarray, reading: str = "generator") -> np.ndarray:
    """Share of a specification's values that are no larger than x; mixtures may nest."""
    if spec.get("family") == "mixture":
        parts = spec["components"]
        total = sum(float(c["weight"]) for c in parts)
        return sum(float(c["weight"]) / total * cdf(c, x, reading) for c in parts)
    return _family(spec, reading)[0](x)


def apportioned(weights: list[float], total: int) -> list[int]:
    """Whole numbers in proportion to the weights: the whole parts, then one each by remainder, the first on a tie."""
    share = np.asarray(weights, float) / sum(weights) * total
    base = np.floor(share).astype(int)
    first = np.lexsort((np.arange(len(base)), -(share - base)))[: total - int(base.sum())]
    base[first] += 1
    return base.tolist()


def quantile(spec: dict, levels: np.ndarray, reading: str = "generator") -> np.ndarray:
    levels = np.asarray(levels, float)
    if spec.get("family") == "mixture":
        return target_values(spec, len(levels), reading)
    f, low, high = _family(spec, reading)
    if low == high:
        return np.full_like(levels, low)
    return inverted(f, levels, low, high)


def target_values(spec: dict, n: int, reading: str = "generator") -> np.ndarray:
    """n values at the middles of n equal shares, sorted; a mixture's come from its components in apportioned numbers."""
    if spec.get("family") == "mixture":
        counts = apportioned([float(c["weight"]) for c in spec["components"]], n)
        return np.sort(np.concatenate([target_values(c, k, reading) for c, k in zip(spec["components"], counts, strict=True)] or [np.zeros(0)]))
    return quantile(spec, (np.arange(n) + 0.5) / n, reading)


def stratified_sample(spec: dict, n: int, rng: np.random.Generator) -> np.ndarray:
    """A random value in each of n equal shares, in random order."""
    if spec.get("family") == "mixture":
        counts = apportioned([float(c["weight"]) for c in spec["components"]], n)
        out = np.concatenate([stratified_sample(c, k, rng) for c, k in zip(spec["components"], counts, strict=True)] or [np.zeros(0)])
    else:
        out = quantile(spec, (np.arange(n) + rng.random(n)) / max(1, n))
    return rng.permutation(out)


def cdf_udf(spec: dict, reading: str = "generator"):
    """The cumulative function as a pandas UDF."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def f(x: pd.Series) -> pd.Series:
        return pd.Series(cdf(spec, x.to_numpy(float), reading))

    return f


def ks(samples: np.ndarray, spec: dict, reading: str = "generator") -> float:
    """Infinite without samples; to a constant 0 or 1."""
    x = np.sort(np.asarray(samples, float))
    n = len(x)
    if not n:
        return math.inf
    if spec.get("family") == "constant":
        return 0.0 if np.allclose(x, float(spec["value"])) else 1.0
    f = cdf(spec, x, reading)
    return float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))


def wasserstein(a: np.ndarray, b: np.ndarray) -> float:
    """Area between two samples' step functions."""
    a, b = np.sort(a), np.sort(b)
    every = np.sort(np.concatenate([a, b]))
    gaps = np.abs(np.searchsorted(a, every[:-1], "right") / len(a) - np.searchsorted(b, every[:-1], "right") / len(b))
    return float((gaps * np.diff(every)).sum())


def compared(samples: np.ndarray, spec: dict, ks_limit: float, distance_limit: float, reading: str = "generator") -> dict:
    """ks, normalised distance and passed. The generator divides by the target's range, the validator by its 5 to 95 per cent range."""
    x = np.asarray(samples, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return {"ks": math.inf, "distance": math.inf, "passed": False}
    target = target_values(spec, max(len(x), 512), reading)
    scale = float(np.ptp(target)) if reading == "generator" else float(np.quantile(target, 0.95) - np.quantile(target, 0.05))
    distance = wasserstein(x, target) / scale if scale > 0 else (0.0 if np.allclose(x, target[0]) else math.inf)
    k = ks(x, spec, reading)
    return {"ks": k, "distance": distance, "passed": bool(k <= ks_limit and distance <= distance_limit)}
