"""Statistical measures of the numeric matrix.

Moments, extremes, exact quantiles and Gram matrices are shared jobs of the dataset;
what is left here is arithmetic on a few numbers per column."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from facetry.functions import normality
from facetry.plans.data import NAN, Data, order_statistics
from facetry.plans.registry import measure


def _per_column(data: Data, of) -> list[tuple[str, float]]:
    return [(name, float(of(m))) for name, m in data.moments.items()]


def _pairs(data: Data, matrix: np.ndarray) -> list[tuple[str, float]]:
    names = data.numeric_names
    return [(f"{names[i]},{names[j]}", float(abs(matrix[i, j]))) for i in range(len(names)) for j in range(i)]


def canonical_correlations(data: Data) -> np.ndarray:
    """Singular values of the whitened cross covariance of columns and class indicators."""
    if data.d == 0 or len(data.classes) < 2:
        return np.zeros(0)
    total = data.n
    sxx = data.scatter / total
    share = np.array([n / total for _, n in data.classes])[1:]
    syy = np.diag(share) - np.outer(share, share)
    # class sums are centred by the overall means already
    sxy = np.array([data.gram[c][1] / total for c, _ in data.classes[1:]]).T

    def white(s: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(s)
        ok = values > 1e-10 * max(values.max(), 1e-300)
        return vectors[:, ok] / np.sqrt(values[ok])

    scale = np.sqrt(np.maximum(np.diag(sxx), 1e-300))
    found = np.linalg.svd(white(sxx / np.outer(scale, scale)).T @ (sxy / scale[:, None]) @ white(syy), compute_uv=False)
    found = np.clip(found[: min(len(data.classes) - 1, data.d)], 0, 1)
    return found[found > 1e-8]


def _eigenvalues(data: Data) -> np.ndarray:
    r = canonical_correlations(data) ** 2
    with np.errstate(divide="ignore"):
        return r / (1 - r)


@measure("statistical", supervised=True)
def can_cor(data: Data):
    """Canonical correlations of the numeric columns and the classes."""
    return [(str(k), float(v)) for k, v in enumerate(canonical_correlations(data))]


@measure("statistical", scalar=True, supervised=True)
def gravity(data: Data, norm_ord: float = 2):
    """Distance between the means of the largest and the smallest class."""
    sizes = [n for _, n in data.classes]
    most = sizes.index(max(sizes))
    rest = sizes[:most] + sizes[most + 1 :]
    least = rest.index(min(rest)) if rest else most
    least += least >= most and bool(rest)
    a, b = (np.array([m["mean"] for m in data.by_class[data.classes[k][0]]]) for k in (most, least))
    return float(np.linalg.norm(a - b, ord=norm_ord))


@measure("statistical")
def cor(data: Data):
    """Absolute correlation of each pair of columns."""
    s = np.sqrt(np.diag(data.scatter))
    with np.errstate(divide="ignore", invalid="ignore"):
        return _pairs(data, data.scatter / np.outer(s, s))


@measure("statistical")
def cov(data: Data, ddof: int = 1):
    """Absolute covariance of each pair of columns."""
    return _pairs(data, data.covariance(ddof))


@measure("statistical", scalar=True, supervised=True)
def nr_disc(data: Data):
    """Number of canonical correlations."""
    return len(canonical_correlations(data))


@measure("statistical")
def eigenvalues(data: Data, ddof: int = 1):
    """Eigenvalues of the covariance matrix, ascending."""
    return [(str(k), float(v)) for k, v in enumerate(np.linalg.eigvalsh(data.covariance(ddof)))]


@measure("statistical")
def g_mean(data: Data, allow_zeros: bool = True, epsilon: float = 1e-10):
    """Geometric mean of each column."""

    def of(m):
        if m["min"] < 0 or not allow_zeros and m["min"] <= epsilon:
            return NAN
        return 0.0 if m["min"] < epsilon else math.exp(m["log"])

    return _per_column(data, of)


@measure("statistical")
def h_mean(data: Data):
    """Harmonic mean of each column."""
    return _per_column(data, lambda m: NAN if m["min"] < 0 else 0.0 if m["min"] == 0 else m["n"] / m["inverse"])


@measure("statistical")
def iq_range(data: Data):
    """Distance of the quartiles of each column."""
    return [(c, q[1] - q[0]) for c, q in data.quantiles((0.25, 0.75)).items()]


@measure("statistical")
def kurtosis(data: Data, method: int = 3, bias: bool = True):
    """Excess kurtosis of each column."""
    return _per_column(data, lambda m: corrected_kurtosis(m["kurt"], m["n"], method, bias))


def corrected_kurtosis(g2: float, n: float, method: int, bias: bool) -> float:
    """Sample corrections of a population excess kurtosis."""
    if method not in (1, 2, 3):
        raise ValueError(f"kurtosis has no method {method}")
    if not bias and n > 3:
        g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    if method == 2 and n > 3:
        return ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
    return (g2 + 3) * (1 - 1 / n) ** 2 - 3 if method == 3 else g2


def corrected_skewness(g1: float, n: float, method: int, bias: bool) -> float:
    """Sample corrections of a population skewness."""
    if method not in (1, 2, 3):
        raise ValueError(f"skewness has no method {method}")
    if not bias and n > 2:
        g1 = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    if method == 2 and n != 2:
        return g1 * math.sqrt(n * (n - 1)) / (n - 2)
    return g1 * ((n - 1) / n) ** 1.5 if method == 3 else g1


@measure("statistical")
def mad(data: Data, factor: float = 1.4826):
    """Scaled median of absolute deviations from the median, by column."""
    middle = data.quantiles((0.5,))
    away = {c: F.abs(x - F.lit(middle[c][0])) for c, x in data.numeric_columns.items()}
    return [(c, factor * q[0]) for c, q in order_statistics(data.source, away, [0.5]).items()]


@measure("statistical", "max")
def max_(data: Data):
    """Maximum of each column."""
    return _per_column(data, lambda m: m["max"])


@measure("statistical")
def mean(data: Data):
    """Mean of each column."""
    return _per_column(data, lambda m: m["mean"])


@measure("statistical")
def median(data: Data):
    """Median of each column."""
    return [(c, q[0]) for c, q in data.quantiles((0.5,)).items()]


@measure("statistical", "min")
def min_(data: Data):
    """Minimum of each column."""
    return _per_column(data, lambda m: m["min"])


@measure("statistical", scalar=True)
def nr_cor_attr(data: Data, threshold: float = 0.5, normalize: bool = True):
    """Share of column pairs whose absolute correlation reaches the threshold."""
    values = [v for _, v in cor(data)]
    hits = sum(v >= threshold for v in values)
    return hits / len(values) if normalize and values else float(hits)


@measure("statistical", scalar=True)
def nr_norm(data: Data, method: str = "shapiro-wilk", threshold: float = 0.05, failure: str = "soft", max_samples: int = 5000):
    """Number of columns that pass a normality test on the first rows by id."""
    if method not in ("shapiro-wilk", "dagostino-pearson", "anderson-darling", "all"):
        raise ValueError(f"unknown normality test {method!r}")
    if failure not in ("soft", "hard"):
        raise ValueError(f"unknown failure mode {failure!r}")
    if max_samples <= 0:
        raise ValueError("max_samples must be positive")
    data.needs_id()
    first = data.matrix.select("_id", "x").orderBy("_id").limit(max_samples)
    x = np.array([r["x"] for r in first.collect()], float)  # at most max_samples rows
    tests = {"shapiro-wilk": lambda v: normality.shapiro_wilk(v) > threshold, "dagostino-pearson": lambda v: normality.dagostino(v) > threshold, "anderson-darling": normality.anderson_passes}
    passed = [[f(x[:, k]) for k in range(data.d)] for name, f in tests.items() if method in (name, "all")]
    return float(np.sum(np.any(passed, axis=0) if failure == "soft" else np.all(passed, axis=0)))


@measure("statistical", scalar=True)
def nr_outliers(data: Data, whis: float = 1.5):
    """Number of columns with a value beyond the whiskers."""
    out = 0
    for c, (low, high) in data.quantiles((0.25, 0.75)).items():
        reach = whis * (high - low)
        out += data.moments[c]["min"] < low - reach or data.moments[c]["max"] > high + reach
    return float(out)


@measure("statistical", "range")
def range_(data: Data):
    """Range of each column."""
    return _per_column(data, lambda m: m["max"] - m["min"])


@measure("statistical")
def sd(data: Data, ddof: int = 1):
    """Standard deviation of each column."""
    return _per_column(data, lambda m: math.sqrt(m["var"] * m["n"] / (m["n"] - ddof)) if m["n"] > ddof else NAN)


@measure("statistical", scalar=True, supervised=True)
def sd_ratio(data: Data, ddof: int = 1, compat: bool = False):
    """Homogeneity of the class covariances, from Box's M. ``compat`` pairs weights and
    matrices in reversed order with reversed rows."""
    d, n, k = data.d, data.n, len(data.classes)
    sizes = np.array([c for _, c in data.classes], float)
    if d == 0 or k < 2 or (sizes <= max(1, ddof)).any():
        return NAN
    matrices = []
    for c, m in data.classes:
        _, s, g = data.gram[c]
        matrices.append((g - np.outer(s, s) / m) / (m - ddof))
    if compat:
        matrices = [x[::-1] for x in matrices[::-1]]
    weights = sizes - 1
    pooled = sum(w * s for w, s in zip(weights, matrices, strict=True)) / (n - k)
    gamma = 1 - (2 * d**2 + 3 * d - 1) / (6 * (d + 1) * (k - 1)) * ((1 / weights).sum() - 1 / (n - k))
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.array([np.log(np.linalg.det(s)) for s in matrices])
        m = gamma * ((n - k) * np.log(np.linalg.det(pooled)) - weights @ logs)
    return NAN if not np.isfinite(m) else float(np.exp(m / (d * (n - k))))


@measure("statistical")
def skewness(data: Data, method: int = 3, bias: bool = True):
    """Skewness of each column."""
    return _per_column(data, lambda m: corrected_skewness(m["skew"], m["n"], method, bias))


@measure("statistical")
def sparsity(data: Data, normalize: bool = True):
    """Repetition of each attribute's values: rows over distinct values, less one."""
    scale = 1 / (data.n - 1) if normalize and data.n > 1 else 1.0
    return [(c, (data.n / data.distinct[c] - 1) * scale) for c in data.attributes]


@measure("statistical")
def t_mean(data: Data, pcut: float = 0.2):
    """Mean of each column without the lowest and highest ``pcut`` of its rows."""
    n, cut = data.n, int(pcut * data.n)
    if n - 2 * cut <= 0:
        return [(c, NAN) for c in data.numeric_names]
    span = n - 1 or 1
    ends = data.quantiles((cut / span, (n - 1 - cut) / span))
    aggs = []
    for k, c in enumerate(data.numeric_names):
        x, (low, high) = F.col(f"x{k}"), (ends[c][0], ends[c][1])
        aggs += [F.sum(F.when((x > low) & (x < high), x)).alias(f"s{k}"), F.count_if(x <= low).alias(f"l{k}"), F.count_if(x >= high).alias(f"h{k}")]
    row = data.N.agg(*aggs).first()
    out = []
    for k, c in enumerate(data.numeric_names):
        low, high = ends[c]
        if low == high:
            out.append((c, low))
            continue
        out.append((c, ((row[f"s{k}"] or 0.0) + low * (row[f"l{k}"] - cut) + high * (row[f"h{k}"] - cut)) / (n - 2 * cut)))
    return out


@measure("statistical")
def var(data: Data, ddof: int = 1):
    """Variance of each column."""
    return _per_column(data, lambda m: m["var"] * m["n"] / (m["n"] - ddof) if m["n"] > ddof else NAN)


@measure("statistical", scalar=True, supervised=True)
def w_lambda(data: Data):
    """Wilks' lambda."""
    return float(np.exp(-np.log1p(_eigenvalues(data)).sum()))


@measure("statistical", scalar=True, supervised=True)
def p_trace(data: Data):
    """Pillai's trace."""
    return float((canonical_correlations(data) ** 2).sum())


@measure("statistical", scalar=True, supervised=True)
def lh_trace(data: Data):
    """Lawley-Hotelling trace."""
    return float(_eigenvalues(data).sum())


@measure("statistical", scalar=True, supervised=True)
def roy_root(data: Data, criterion: str = "eigval"):
    """Roy's largest root, as eigenvalue or squared correlation."""
    if criterion not in ("eigval", "cancor"):
        raise ValueError(f"unknown criterion {criterion!r}")
    values = _eigenvalues(data) if criterion == "eigval" else canonical_correlations(data) ** 2
    return float(values.max()) if len(values) else NAN
