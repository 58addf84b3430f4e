"""Small numpy kernels: an exact classification tree and a linear support vector machine."""

from __future__ import annotations

import numpy as np


class Tree:
    """A classification tree on Gini impurity, grown to purity within the limits given:
    nodes in preorder as parallel arrays. Of equally good splits the first column and the
    lowest threshold win. ``weight`` is how many equal rows each row stands for."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, weight: np.ndarray | None = None) -> None:
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.depth: list[int] = []
        self.samples: list[int] = []
        self.counts: list[np.ndarray] = []
        self.impurity: list[float] = []
        self.n_features, self.n_classes = x.shape[1], classes
        weight = np.ones(len(y), np.int64) if weight is None else weight
        size = int(weight.sum())
        todo = [(np.arange(len(y)), 0, -1, False)]
        while todo:
            rows, depth, parent, is_right = todo.pop()
            node = len(self.feature)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            counts = np.bincount(y[rows], weight[rows], classes).astype(np.int64)
            n = int(counts.sum())
            self.counts.append(counts)
            self.samples.append(n)
            self.depth.append(depth)
            self.impurity.append(1 - ((counts / n) ** 2).sum())
            ended = (counts > 0).sum() < 2 or depth == max_depth or n < max(min_samples_split, 2 * min_samples_leaf)
            split = None if ended else _best_split(x[rows], y[rows], classes, weight[rows], min_samples_leaf, min_impurity_decrease * size)
            self.feature.append(split[0] if split else -1)
            self.threshold.append(split[1] if split else 0.0)
            self.left.append(-1)
            self.right.append(-1)
            if split:
                low = x[rows, split[0]] <= split[1]
                todo.append((rows[~low], depth + 1, node, True))
                todo.append((rows[low], depth + 1, node, False))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        while (on := np.flatnonzero(feature[at] >= 0)).size:
            f = feature[at[on]]
            at[on] = np.where(x[on, f] <= threshold[at[on]], left[at[on]], right[at[on]])
        return np.array([c.argmax() for c in self.counts])[at]

    def importances(self) -> np.ndarray:
        out = np.zeros(self.n_features)
        for k, f in enumerate(self.feature):
            if f >= 0:
                a, b = self.left[k], self.right[k]
                out[f] += self.samples[k] * self.impurity[k] - self.samples[a] * self.impurity[a] - self.samples[b] * self.impurity[b]
        return out / out.sum() if out.sum() > 0 else out


def _best_split(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, least_rows: int = 1, least_fall: float = 0.0) -> tuple[int, float] | None:
    """Column and threshold, leaving ``least_rows`` on either side; the impurity times rows
    falls by at least ``least_fall``."""
    n, best = int(weight.sum()), None
    hot = np.eye(classes)[y] * weight[:, None]
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cut = np.flatnonzero(v[1:] - v[:-1] > 1e-7)
        upto = weight[order].cumsum()
        cut = cut[(upto[cut] >= least_rows) & (n - upto[cut] >= least_rows)]
        if not cut.size:
            continue
        m = upto[cut][:, None]
        upto = hot[order].cumsum(0)
        left, total = upto[cut], upto[-1]
        gain = ((left**2) / m).sum(1) + (((total - left) ** 2) / (n - m)).sum(1)
        k = int(gain.argmax())
        if best is None or gain[k] > best[0] + 1e-9:
            middle = (v[cut[k]] + v[cut[k] + 1]) / 2
            best = (gain[k], f, v[cut[k]] if middle == v[cut[k] + 1] else middle)
    if best and best[0] - (np.bincount(y, weight) ** 2).sum() / n < least_fall - 1e-9:
        return None
    return best[1:] if best else None


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 2.0, tol: float = 1e-9, max_iter: int = 100_000) -> np.ndarray:
    """Weights (the last for a constant column) of a hinge-loss machine; ``y`` is -1 or 1.

    A primal-dual interior point on the dual: its Hessian is diagonal but for a part of the
    columns' rank, so a step is one pass over the rows and a system of as many unknowns as
    columns, and some tens of steps reach the one optimum, whatever the rows' number.
    Ends at a relative gap of ``tol``, or after ``max_iter`` steps."""
    v = np.hstack([x, np.ones((len(x), 1))]) * y[:, None]
    n, d = v.shape
    alpha = np.full(n, c / 2)
    z, u = np.ones(n), np.ones(n)
    for _ in range(min(max_iter, 500)):
        w = v.T @ alpha
        slope, room = v @ w - 1, c - alpha
        gap = alpha @ z + room @ u
        residual = slope - z + u
        if gap <= tol * (1 + abs(0.5 * w @ w - alpha.sum())) and np.abs(residual).max() <= 1e-6:
            break
        scale = 1 / (z / alpha + u / room)
        inner = np.eye(d) + v.T @ (v * scale[:, None])

        def step(mu, away=0.0, off=0.0):
            right = -slope + (mu - away) / alpha - (mu - off) / room  # noqa: B023
            b = scale * right  # noqa: B023
            move = b - scale * (v @ np.linalg.solve(inner, v.T @ b))  # noqa: B023
            return move, (mu - away - z * move) / alpha - z, (mu - off + u * move) / room - u  # noqa: B023

        def longest(move, dz, du):
            return min(1.0, *(0.9995 * float((-value / change)[change < 0].min(initial=np.inf)) for value, change in ((alpha, move), (room, -move), (z, dz), (u, du))))  # noqa: B023

        # a step to the boundary tells how far to aim, and what it misses
        move, dz, du = step(0.0)
        far = longest(move, dz, du)
        aimed = (alpha + far * move) @ (z + far * dz) + (room - far * move) @ (u + far * du)
        mu = (aimed / gap) ** 3 * gap / (2 * n)
        move, dz, du = step(mu, move * dz, -move * du)
        far = longest(move, dz, du)
        alpha, z, u = alpha + far * move, z + far * dz, u + far * du
        alpha = np.clip(alpha, 1e-300, c * (1 - 1e-16))
    return v.T @ alpha


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns with mean 0 and variance 1, and what was taken off and divided by."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1.0, sd)
    return (x - mean) / sd, mean, sd
